"""What each quality filter removes, in every order of five filters.

Duplicates are found by sorting: rows are range-partitioned by text fingerprint and doc_id (a row
number splits rows that repeat both), sorted inside a range by fingerprint, full text and doc_id, and
each row is compared with its predecessor. A group of copies may so lie in many ranges. Only the
first and the last fingerprint of a range can go on in another one: the leaders of these carry a
SHA-256 of their text, and the least doc_id of each such text, two for each range at most, settles them.

Each document then is a mask of the filters it fails. Masks are merged into counters of a part: how
many documents pass every set of filters (32 sets, and the same for documents labelled good and
toxic). These add up, and all 600 rows of a part are differences of them.

Filters: A under 200 words; B distinct words under half of them; C capitals A-Z above 2 % of the
code points; D any of ``#$%&*|``; E the text of a smaller doc_id.

Defined cases: a null text is empty; rows without a doc_id are no copies and make none, as neither
is smaller; rows that repeat doc_id and text fail E together or not at all; null and empty sources are
one part; a doc_id labelled several times is good or toxic if any label says so; null labels say nothing;
empty documents give an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, settings, text_or_empty

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))


def text_mask(raw: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = raw.split()
    code_points = len(raw.translate(None, _CONTINUED))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * code_points) << 2
        | (len(raw.translate(None, MARKS)) < len(raw)) << 3
    )


def _scan(schema: pa.Schema):
    """Masks of one sorted range; ``edge`` is set on the leaders that other ranges may know copies of."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = fp = text = least = None
        leaders: list[tuple] = []  # of the present fingerprint: rows that copy nothing in this range
        began = False
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("fp", "text", "doc_id", "part"))
            for now, raw, doc_id, part in zip(*columns):
                if not began or now != fp:
                    out += _settled(leaders, began and fp == first)
                    leaders, text = [], None
                    first, fp, began = (first if began else now), now, True
                same = text is not None and raw == text
                if not same:
                    text, least, mask = raw, doc_id, text_mask(raw)
                if same and doc_id is not None and least is not None and least < doc_id:
                    out.append((doc_id, part, mask | COPY, None))
                elif doc_id is None:
                    out.append((doc_id, part, mask, None))
                else:
                    leaders.append((doc_id, part, mask, text))
            yield _batch(out, schema)
        yield _batch(_settled(leaders, True), schema)

    return rows


def _settled(leaders: list[tuple], edge: bool) -> list[tuple]:
    return [(i, p, m, hashlib.sha256(t).digest() if edge else None) for i, p, m, t in leaders]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and failure mask of every row."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text_or_empty().cast("binary").alias("text"),
    )
    kind = rows.schema["doc_id"].dataType
    by_id = F.col("doc_id").asc_nulls_last()
    ranged = (
        rows.withColumn("fp", F.xxhash64("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange("fp", by_id, "row")
        .sortWithinPartitions("fp", "text", by_id)
        .drop("row")
    )
    fields = [T.StructField("doc_id", kind), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("edge", T.BinaryType())]
    schema = pa.schema([pa.field(f.name, t) for f, t in zip(fields, (_arrow(kind), pa.string(), pa.int32(), pa.binary()))])
    with settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "512"}):
        found = materialize(ranged.mapInArrow(_scan(schema), T.StructType(fields)), "audit-masks")
    leaders = found.filter("edge IS NOT NULL")
    # Two texts for each range at most: a bound on what is broadcast.
    least = leaders.groupBy("edge").agg(F.min("doc_id").alias("least"))
    copied = F.when(F.col("doc_id") > F.col("least"), F.lit(COPY)).otherwise(0)
    settled = leaders.join(F.broadcast(least), "edge").select("doc_id", "part", F.col("mask").bitwiseOR(copied).alias("mask"))
    return found.filter("edge IS NULL").select("doc_id", "part", "mask").unionAll(settled)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def counters(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, how many documents pass each set of filters: all, good and toxic ones."""
    said = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        *[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "bad"))]
    )
    joined = masked.join(said, masked["doc_id"] == said["labelled"], "left")
    merged = joined.groupBy("part", "mask", "good", "bad").agg(F.count("*").alias("n"))

    n = F.col("n")
    every = merged.select("*", F.explode(F.sequence(F.lit(0), F.lit(SETS - 1))).alias("set"))
    passes = F.col("mask").bitwiseAND(F.col("set")) == 0

    def passed(whom: Column) -> Column:
        return F.coalesce(F.sum(F.when(passes & whom, n)), F.lit(0).cast("long"))

    sums = every.groupBy("part", "set").agg(
        passed(F.lit(True)).alias("all"), passed(F.col("good")).alias("good"), passed(F.col("bad")).alias("bad")
    )
    # 32 entries for each part, by set.
    by_set = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("set", "all", "good", "bad"))).alias("sets"))
    return by_set.select("part", *[F.col(f"sets.{c}").alias(c) for c in ("all", "good", "bad")])


def _orders() -> str:
    """The 600 steps: their order, filter and the sets before and after, as one JSON array."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            name = "".join(FILTERS[i] for i in order)
            out.append({"filter_order": name, "step": k + 1, "f": f, "was": before, "now": before | 1 << f})
            before |= 1 << f
    return json.dumps(out)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step."""
    full, filters = SETS - 1, F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))
    # Of the orders in which just the filters of a set come before one: how many there are, by the set's size.
    orders = F.array(*[F.lit(math.factorial(k) * math.factorial(len(FILTERS) - 1 - k)).cast("long") for k in range(len(FILTERS))])

    def at(column: str, s: str | Column) -> Column:
        return F.get(column, F.col(s) if isinstance(s, str) else s)

    def bit(f: Column) -> Column:
        return F.element_at(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), f + 1)

    def removals(f: Column) -> Column:
        def add(total: Column, s: Column) -> Column:
            here = F.get(orders, F.bit_count(s)) * (at("all", s) - at("all", s.bitwiseOR(bit(f))))
            return total + F.when(s.bitwiseAND(bit(f)) == 0, here).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(full)), F.lit(0).cast("long"), add)

    shapley = F.transform(filters, removals)
    alone = F.transform(filters, lambda f: at("all", F.lit(full) - bit(f)) - at("all", F.lit(full)))
    failing = F.transform(filters, lambda f: at("all", F.lit(0)) - at("all", bit(f)))
    parts = counters(masks(docs), labels).select("*", shapley.alias("shapley"), alone.alias("alone"), failing.alias("failing"))
    kind = "array<struct<filter_order:string,step:int,f:int,was:int,now:int>>"
    steps = parts.select("*", F.inline(F.from_json(F.lit(_orders()), kind)))
    removed = at("all", "was") - at("all", "now")
    return steps.select(
        "part",
        "filter_order",
        "step",
        at("all", "now").alias("kept"),
        removed.alias("removed"),
        (at("failing", "f") - removed).alias("redundant"),
        at("alone", "f").alias("unique_fails"),
        (at("good", "was") - at("good", "now")).alias("good_lost"),
        (at("bad", "was") - at("bad", "now")).alias("toxic_lost"),
        at("shapley", "f").alias("shapley"),
    )

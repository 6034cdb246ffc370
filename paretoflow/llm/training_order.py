"""Training-order materialisation of token sequences in fixed-stride shards.

Every document becomes sequences of ``length`` token ids (the last one padded). All sequences
are numbered, and a keyed Feistel permutation with cycle-walking gives each number its slot in
the training order: no sort by random keys, no table of the order, and the same key gives the
same order again. Rows are range-partitioned by shard, so a task writes whole shards in turn;
each shard holds its sequences as equal strides of one binary value, and the reader finds slot
s at shard s // per_shard, byte (s % per_shard) * stride.

Defined cases: a null or empty text is only the end id; repeated rows and ties are sequences of
their own; very long documents give many sequences; an empty table gives no shard; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, text_or_empty
from .tokens import encoder, vocabulary_path

LENGTH = 512
PER_SHARD = 1024
PAD_ID = 0
END_ID = 1
ROUNDS = 4


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function (the finalizer of splitmix64)."""
    x = x + np.uint64(key % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(values: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The permutation of range(n) (or its inverse) at ``values``.

    The network permutes the smallest even number of bits that holds n; results outside
    range(n) walk on, at most four steps on average.
    """
    half = np.uint64(max(1, -(-max(1, n - 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [key * ROUNDS + r + 1 for r in range(ROUNDS)]
    out = np.asarray(values, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mixed(left, k) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, k) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """doc_id, part and ids (``length`` little-endian unsigned 16-bit ids) of each sequence."""
    arrow_rows(docs.sparkSession)
    path = vocabulary or vocabulary_path()
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = np.array([*encode(text), END_ID], "<u2")
                whole = np.full(-(-len(ids) // length) * length, PAD_ID, "<u2")
                whole[: len(ids)] = ids
                rows += [(doc_id, k, len(ids), x.tobytes()) for k, x in enumerate(whole.reshape(-1, length))]
            out = pd.DataFrame(rows, columns=["doc_id", "part", "doc_tokens", "ids"])
            out["doc_id"] = out["doc_id"].astype(b["doc_id"].dtype)
            yield out

    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(
        cut, f"doc_id {kind}, part long, doc_tokens long, ids binary"
    )


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows, written once, with a gapless number from 0, and how many there are.

    Partitions are counted, and the running sum over partitions (not rows) gives each its first
    number.
    """
    kept = materialize(rows.withColumn("_id", F.monotonically_increasing_id()), "order-rows")
    part = F.shiftright("_id", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    firsts = materialize(counts.withColumn("_first", before), "order-firsts")
    n = firsts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    number = F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each task that wrote: a bound that the number of tasks proves.
    out = kept.withColumn("_part", part).join(F.broadcast(firsts.drop("_n")), "_part").withColumn("number", number)
    return out.drop("_id", "_part", "_first"), n


def slot(number: Column, n: int, key: int) -> Column:
    @F.pandas_udf("long")
    def permuted(values: pd.Series) -> pd.Series:
        return pd.Series(feistel(values.to_numpy(), n, key))

    return permuted(number)


def shards(rows: DataFrame, n: int, key: int = 20240229, per_shard: int = PER_SHARD, length: int = LENGTH) -> DataFrame:
    """One row per shard: shard, first_slot, n_sequences, stride, data, doc_ids.

    A task holds one shard at a time.
    """
    kind = dict(rows.dtypes)["doc_id"]
    stride = 2 * length
    placed = rows.select("doc_id", "ids", slot(F.col("number"), n, key).alias("slot")).withColumn(
        "shard", F.floor(F.col("slot") / per_shard).cast("long")
    )
    n_shards = -(-n // per_shard)
    tasks = max(1, min(n_shards, -(-n * stride // (32 << 20))))

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            rows = pd.concat(held)
            held.clear()
            return pd.DataFrame(
                {
                    "shard": [rows["shard"].iloc[0]],
                    "first_slot": [rows["slot"].iloc[0]],
                    "n_sequences": [len(rows)],
                    "stride": [stride],
                    "data": [b"".join(rows["ids"])],
                    "doc_ids": [[None if pd.isna(x) else x for x in rows["doc_id"]]],
                }
            )

        for b in batches:
            for _, part in b.groupby("shard", sort=False):
                if held and held[-1]["shard"].iloc[0] != part["shard"].iloc[0]:
                    yield done()
                held.append(part)
        if held:
            yield done()

    ranged = placed.repartitionByRange(tasks, "shard").sortWithinPartitions("slot")
    return ranged.mapInPandas(
        written,
        f"shard long, first_slot long, n_sequences long, stride long, data binary, doc_ids array<{kind}>",
    )


def materialise(docs: DataFrame, key: int = 20240229, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards of ``docs`` into the shared folder and return the written table."""
    rows, n = numbered(sequences(docs, length))
    return materialize(shards(rows, n, key, per_shard, length), "order-shards")


def resume(table: DataFrame, at: int, per_shard: int = PER_SHARD) -> DataFrame:
    """slot and ids from slot ``at`` on, in order; earlier shards are not read."""
    part = table.filter(F.col("shard") >= at // per_shard)
    slots = part.select("first_slot", "stride", "data", F.explode(F.sequence(F.lit(0), F.col("n_sequences") - 1)).alias("k"))
    return (
        slots.select(
            (F.col("first_slot") + F.col("k")).alias("slot"),
            F.expr("substring(data, CAST(k * stride + 1 AS INT), CAST(stride AS INT))").alias("ids"),
        )
        .filter(F.col("slot") >= at)
        .orderBy("slot")
    )

"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Each source gets a target number of words (:func:`targets`). A document is taken as often as
the whole-number part of target / source size says, and once more if its hash lies under its
source's threshold. Thresholds come from histograms of words by (source, hash bucket): sum,
find the bucket where the budget ends, and refine only that one, 14 + 14 + 32 bits deep. No
documents are sorted. What is left of a budget where a document did not fit is spent the same
way on later documents of at most that size (``passes`` times).

Defined cases: a null text has size 0; the null source is a source, the last one; documents
are ranked by a hash of id and text, so fully repeated rows tie and are taken or left
together; an empty table gives an empty result; further columns are kept by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST = 3
HASH_BITS = 60
LEVELS = (14, 14, 32)


def key_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of MD5 over the id and the MD5 of the text."""
    one = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(text_or_empty(text)))
    return F.conv(F.substring(F.md5(one), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h of each document: all that mixing needs of it."""
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        key_hash().alias("h"),
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add whole and extra budgets and target to (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn. They share the sum of sizes;
    none gets more than three times its size, and what it cannot take is shared again. In
    order of size / weight the capped sources come first, so one running sum finds them. The
    windows run over sources, not over documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    by_need = Window.orderBy((F.col("source_size") * F.lit(10) / F.col("w")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    big = "decimal(38,0)"
    cap = F.col("source_size") * MOST
    out = (
        sources.withColumn("w", weight.cast("long"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum(cap).over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn(
            "capped",
            cap.cast(big) * F.col("w_left").cast(big) <= F.col("w").cast(big) * (F.col("total") - F.col("before")).cast(big),
        )
        .withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), cap)).over(everything), F.lit(0)))
        .withColumn("w_open", F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything))
    )
    share = F.col("w") * F.col("left")
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(share.cast("double") / F.col("w_open").cast("double"))
    whole = F.when(F.col("capped"), F.lit(MOST).cast("long")).otherwise(
        F.expr("CAST(w * left AS DECIMAL(38,0)) div (CAST(w_open AS DECIMAL(38,0)) * source_size)")
    )
    return (
        out.withColumn("target", target)
        .withColumn("whole", whole)
        .withColumn("extra", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "extra")
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For (source, budget): used words and bound, so that rows with h < bound fill it.

    ``rows`` has source, h, size. The bound is null if a source's rows all fit.
    """
    state = budgets.select(
        "source", "budget", F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("prefix"),
        F.lit(False).alias("ended"),
    )
    low = HASH_BITS
    for bits in LEVELS:
        above, low = low, low - bits
        s, r = state.alias("s"), rows.alias("r")
        inside = r.join(
            s,
            F.col("s.source").eqNullSafe(F.col("r.source"))
            & ~F.col("s.ended")
            & (F.shiftright("r.h", above) == F.col("s.prefix")),
        )
        hist = inside.groupBy("r.source", F.shiftright("r.h", low).alias("bucket")).agg(F.sum("r.size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket")
        b, s2 = hist.withColumn("upto", F.sum("words").over(upto)).alias("b"), state.alias("s2")
        cut = (
            b.join(s2, F.col("s2.source").eqNullSafe(F.col("b.source")))
            .withColumn("over", F.col("s2.used") + F.col("b.upto") > F.col("s2.budget"))
            .groupBy("s2.source")
            .agg(
                F.min(F.when(F.col("over"), F.col("b.bucket"))).alias("first_over"),
                F.max(F.when(~F.col("over"), F.col("b.upto"))).alias("under"),
            )
            .alias("c")
        )
        s3 = state.alias("s3")
        state = materialize(
            s3.join(cut, F.col("s3.source").eqNullSafe(F.col("c.source")), "left").select(
                F.col("s3.source").alias("source"),
                "budget",
                (F.col("used") + F.coalesce("under", F.lit(0))).cast("long").alias("used"),
                F.coalesce("first_over", F.col("prefix")).cast("long").alias("prefix"),
                (F.col("ended") | F.col("first_over").isNull()).alias("ended"),
            ),
            "mix-level",
        )
    return state.select("source", "budget", "used", F.when(~F.col("ended"), F.col("prefix")).alias("bound"))


def plan(rows: DataFrame, passes: int = 4) -> DataFrame:
    """Per source: source_size, target, whole, and the (bound, fits) of each pass."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialize(targets(sources), "mix-sources")
    budget, bounds = F.col("extra"), []
    # A row is open to a pass if it comes after the last bound and fits what is left.
    state = plan.select("source", budget.alias("budget"), F.lit(-1).cast("long").alias("after"), F.col("extra").alias("fits"))
    for k in range(passes):
        r, s = rows.alias("r"), state.alias("s")
        open_rows = r.join(
            s,
            F.col("s.source").eqNullSafe(F.col("r.source")) & (F.col("r.h") > F.col("s.after")) & (F.col("r.size") <= F.col("s.fits")),
        ).select("r.source", "r.h", "r.size") if k else rows.select("source", "h", "size")
        found = thresholds(open_rows, state.select("source", "budget"))
        f = found.alias("f")
        step = s.join(f, F.col("s.source").eqNullSafe(F.col("f.source"))).select(
            F.col("s.source").alias("source"),
            "after",
            F.col("fits") if k else F.lit(2**62).cast("long").alias("fits"),
            F.coalesce("bound", F.lit(2**HASH_BITS)).cast("long").alias("bound"),
            (F.col("f.budget") - F.col("f.used")).alias("left"),
        )
        step = materialize(step, "mix-pass")
        bounds.append(step.select("source", F.struct("after", "bound", "fits").alias(f"pass{k}")))
        state = step.select("source", F.col("left").alias("budget"), F.col("bound").alias("after"), F.col("left").alias("fits"))
    out = plan
    for b in bounds:
        right = b.withColumnRenamed("source", "b_source")
        out = out.join(right, F.col("source").eqNullSafe(F.col("b_source"))).drop("b_source")
    chosen = F.array(*[F.col(f"pass{k}") for k in range(passes)])
    return materialize(out.select("source", "source_size", "target", "whole", chosen.alias("passes")), "mix-plan")


def counted(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with source, size, h) plus source_size, target and the number of copies."""
    p, r = plan.alias("p"), rows.alias("r")
    once_more = F.exists(
        "p.passes",
        lambda x: (F.col("r.h") > x["after"]) & (F.col("r.h") < x["bound"]) & (F.col("r.size") <= x["fits"]),
    )
    return r.join(p, F.col("p.source").eqNullSafe(F.col("r.source"))).select(
        "r.*", "p.source_size", "p.target", F.least(F.col("p.whole") + once_more.cast("long"), F.lit(MOST)).alias("copies")
    )


def mix(docs: DataFrame, passes: int = 4) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with its own columns.

    A document without words stays as often as its source is taken as a whole.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size")
    rows = docs.select(whole, F.col("source").cast("string").alias("source"), size, key_hash().alias("h"))
    narrow = materialize(rows.select("source", "size", "h"), "mix-sizes")
    taken = counted(rows, plan(narrow, passes))
    return taken.select("row.*", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )

"""Estimates from paired and repeated measurements: deltas, error rates, islands, bootstraps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired_delta(items: DataFrame, keys: Sequence[str], anchor: Column, candidate: Column, weight: Column) -> DataFrame:
    """Weighted mean of candidate less anchor, as numerator and denominator and their ratio."""
    return items.groupBy(*keys).agg(
        F.sum(weight * (candidate - anchor)).alias("weighted_delta"), F.sum(weight).alias("weight")
    ).withColumn("delta", F.round(F.try_divide(F.col("weighted_delta").cast("double"), F.col("weight").cast("double")), 6))


def paired_interval(anchor: Column, delta: Column, low: Column, high: Column, error: Column, floor: float = 0.0, ceiling: float = 100.0) -> tuple[Column, Column, Column]:
    """Anchor plus delta, with its bounds widened by the validation error and clipped to the scale."""
    clip = lambda c: F.least(F.greatest(c, F.lit(floor)), F.lit(ceiling))
    return clip(anchor + delta), clip(anchor + low - error), clip(anchor + high + error)


def corpus_error_rate(rows: DataFrame, keys: Sequence[str], errors: Column, words: Column) -> DataFrame:
    """Errors over reference words, summed before they are divided."""
    return rows.groupBy(*keys).agg(F.sum(errors).alias("errors"), F.sum(words).alias("words")).withColumn(
        "rate", F.round(F.try_divide(F.col("errors").cast("double"), F.col("words").cast("double")), 6)
    )


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Runs of rows where ``flag`` holds: start, end and length, in positions from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = df.select(*keys, *order, flag.alias("_on"), (F.row_number().over(w) - 1).alias("_i"))
    runs = placed.filter("_on").withColumn("_k", F.col("_i") - F.row_number().over(w))
    return runs.groupBy(*keys, "_k").agg(
        F.min("_i").cast("long").alias("run_start"), F.max("_i").cast("long").alias("run_end"), F.count(F.lit(1)).alias("run_length")
    ).drop("_k")


def bootstrap(strata: DataFrame, keys: Sequence[str], sums: Sequence[str], unit: str, draws: int, seed: int) -> DataFrame:
    """Poisson bootstrap: per draw, sums over units that come 0, 1, 2, ... times.

    How often a unit comes in a draw follows from a hash of (seed, draw, unit), so draws are shared
    between candidates, no table of draws is joined and a rerun gives the same result. Rows are
    multiplied by ``draws`` inside a task and summed there before the shuffle.
    """
    # Fixed value: the distribution function of Poisson(1) up to 7.
    upto = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759, 0.999989751)
    each = strata.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = draw(F.lit(1 << 30), F.lit(seed), F.col("draw"), F.col(unit)).cast("double") / float(1 << 30)
    times = sum((F.when(u >= p, 1).otherwise(0) for p in upto), F.lit(0))
    return each.withColumn("_t", times).groupBy(*keys, "draw").agg(*[F.sum(F.col(s) * F.col("_t")).alias(s) for s in sums])


def conditional_ratios(df: DataFrame, keys: Sequence[str], ratios: dict[str, tuple[Column, Column]]) -> DataFrame:
    """100 * count(both) / count(given) for each name; null where nothing is given."""
    return df.groupBy(*keys).agg(
        *[F.round(F.try_divide(100 * F.count_if(hit & given).cast("double"), F.count_if(given).cast("double")), 6).alias(n) for n, (hit, given) in ratios.items()]
    )


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """struct<substitutions, deletions, insertions, reference_words> of the best alignment of two texts' words.

    Words are runs of anything but white space. Of alignments with as few errors the one with most
    substitutions counts. A null text has no words.
    """

    @F.pandas_udf("substitutions long, deletions long, insertions long, reference_words long")
    def align(references: pd.Series, hypotheses: pd.Series) -> pd.DataFrame:
        rows = [aligned((a or "").split(), (b or "").split()) for a, b in zip(references, hypotheses)]
        return pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions", "reference_words"])

    return align(F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit("")))


def aligned(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int, int]:
    """Substitutions, deletions, insertions and words of the reference, a row of the distance table at a time."""
    names: dict[str, int] = {}
    a, b = (np.array([names.setdefault(w, len(names)) for w in words], np.int64) for words in (reference, hypothesis))
    # Errors first, then gaps: one number orders both, and a gap pair never replaces a substitution.
    error = len(a) + len(b) + 1
    gap = error + 1
    steps = np.arange(len(b) + 1) * gap
    row = steps.copy()
    for i, word in enumerate(a, 1):
        best = np.minimum(row[1:] + gap, row[:-1] + np.where(b == word, 0, error))
        best = np.concatenate([[i * gap], best])
        # Insertions run along the row: a running minimum once their own cost is taken out.
        row = np.minimum.accumulate(best - steps) + steps
    errors, gaps = divmod(int(row[-1]), error)
    insertions = (gaps - (len(a) - len(b))) // 2
    deletions = gaps - insertions
    return errors - gaps, deletions, insertions, len(a)


def draw(n: Column, *parts: Column) -> Column:
    """A whole number below ``n`` that only depends on ``parts``: 32 bits of an MD5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n)


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """Rows with their place from 0 within a group, and the group's size."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return df.withColumn(name, F.row_number().over(w.orderBy(order)) - 1).withColumn(f"{name}s", F.count(F.lit(1)).over(w))


def _slots(spark, draws: int) -> DataFrame:
    return spark.range(draws).withColumnRenamed("id", "draw")


def _upto(n: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)


def two_stage_bootstrap(items: DataFrame, run: str, item: str, sums: Sequence[str], draws: int, seed: int) -> DataFrame:
    """draw and sums of a bootstrap that draws runs, then items inside each drawn run.

    Rows grow with draws times items and are spread by draw. Runs are few; what a task holds is one
    run's numbers.
    """
    runs = numbered(items.groupBy(run).agg(F.count(F.lit(1)).alias("items")), [], run, "run_no").withColumnRenamed("run_nos", "runs")
    cells = numbered(items, [run], item, "item_no").join(runs.select(run, "run_no"), run)
    one = runs.agg(F.max("runs").alias("runs"))
    chosen = _slots(items.sparkSession, draws).crossJoin(F.broadcast(one)).withColumn("slot", F.explode(_upto("runs")))
    chosen = chosen.withColumn("run_no", draw(F.col("runs"), F.lit(seed), F.lit("run"), F.col("draw"), F.col("slot")))
    inside = chosen.join(runs.select("run_no", "items"), "run_no").withColumn("place", F.explode(_upto("items")))
    inside = inside.withColumn("item_no", draw(F.col("items"), F.lit(seed), F.lit("item"), F.col("draw"), F.col("slot"), F.col("place")))
    found = inside.join(cells.select("run_no", "item_no", *sums), ["run_no", "item_no"])
    return found.groupBy("draw").agg(*[F.sum(s).alias(s) for s in sums])


def crossed_bootstrap(cells: DataFrame, first: str, second: str, sums: Sequence[str], draws: int, seed: int) -> DataFrame:
    """draw and sums over the same drawn rows and columns of a full grid, so that paired columns stay paired."""
    rows = numbered(cells.select(first).distinct(), [], first, "row_no")
    columns = numbered(cells.select(second).distinct(), [], second, "column_no")
    placed = cells.join(rows, first).join(columns, second)
    one = rows.agg(F.max("row_nos").alias("rows")).crossJoin(columns.agg(F.max("column_nos").alias("columns")))
    at = lambda n, kind, slot: draw(F.col(n), F.lit(seed), F.lit(kind), F.col("draw"), F.col(slot))
    drawn = _slots(cells.sparkSession, draws).crossJoin(F.broadcast(one))
    grid = drawn.withColumn("i", F.explode(_upto("rows"))).withColumn("j", F.explode(_upto("columns")))
    grid = grid.withColumn("row_no", at("rows", "row", "i")).withColumn("column_no", at("columns", "column", "j"))
    found = grid.join(placed.select("row_no", "column_no", *sums), ["row_no", "column_no"])
    return found.groupBy("draw").agg(*[F.sum(s).alias(s) for s in sums])


def stratified_bootstrap(items: DataFrame, stratum: str, item: str, offering: str, sums: Sequence[str], draws: int, seed: int) -> DataFrame:
    """draw, offering and sums of items drawn within their stratum, the same ones for every offering."""
    distinct = numbered(items.select(stratum, item).distinct(), [stratum], item, "item_no")
    sizes = distinct.groupBy(stratum).agg(F.count(F.lit(1)).alias("items"))
    slots = _slots(items.sparkSession, draws).crossJoin(sizes).withColumn("slot", F.explode(_upto("items")))
    slots = slots.withColumn("item_no", draw(F.col("items"), F.lit(seed), F.col(stratum), F.col("draw"), F.col("slot")))
    drawn = slots.groupBy("draw", stratum, "item_no").agg(F.count(F.lit(1)).alias("times"))
    found = drawn.join(distinct.select(stratum, item, "item_no"), [stratum, "item_no"]).join(items, [stratum, item])
    return found.groupBy("draw", offering).agg(*[F.sum(F.col(s) * F.col("times")).alias(s) for s in sums])


def interval(draws: DataFrame, value: Column, keys: Sequence[str] = ()) -> DataFrame:
    """95 % percentile interval of a value over draws, and the share of draws below zero."""
    return draws.groupBy(*keys).agg(
        F.percentile(value, 0.025).alias("lower"), F.percentile(value, 0.975).alias("upper"), F.avg((value < 0).cast("double")).alias("below_zero")
    )


class GridError(ValueError):
    """Two grids do not match cell by cell."""


def paired_grid(candidate: DataFrame, reference: DataFrame, keys: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Cells of two grids side by side, columns of the first with ``c_`` and of the second with ``r_``.

    Every cell must stand in both, once, with equal ``same`` columns, and the grid must be full.
    """
    marked = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys])
    for df in (candidate, reference):
        if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise GridError("a cell is repeated")
    both = marked(candidate, "c").withColumn("_c", F.lit(1)).join(marked(reference, "r").withColumn("_r", F.lit(1)), list(keys), "full_outer")
    bad = F.col("_c").isNull() | F.col("_r").isNull()
    for c in same:
        bad = bad | ~F.col(f"c_{c}").eqNullSafe(F.col(f"r_{c}"))
    counts = candidate.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(k).alias(k) for k in keys]).first()
    full = 1
    for k in keys:
        full *= counts[k]
    if counts["n"] != full or both.filter(bad).limit(1).count():
        raise GridError("the grids are not full and equal")
    return both.drop("_c", "_r")

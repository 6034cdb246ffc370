"""Ranges of values cut at quantiles: what lets a sorted computation of one large group run in many tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of values at most.
RANGES = 1024


def same(a: str, b: str, columns: Sequence[str]) -> Column:
    """Rows ``a`` and ``b`` agree on all columns; nulls agree with nulls."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(True))


def _range(value: Column, cuts: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``: every 32nd cut first, then 32 of them."""
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(32), F.greatest(F.size(cuts), F.lit(32)), F.lit(32)), lambda k: F.get(cuts, k - 1)), lambda c: c <= value))
    fine = lambda k: k * 32 + F.size(F.filter(F.slice(cuts, k * 32 + 1, F.lit(32)), lambda c: c <= value))
    return F.transform(F.array(coarse), fine)[0]


def ranged(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """``_range``: the number of the range of ``column`` that a row lies in, of up to ``n`` cut at quantiles.

    By default there are as many as the session has shuffle partitions.
    """
    n = n or min(RANGES, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    value = F.col(f"`{column}`").cast("double")
    # One row of at most ``n`` numbers.
    cuts = df.agg(F.percentile_approx(value, F.lit([k / n for k in range(1, n)]), 20 * n).alias("_cuts"))
    distinct = cuts.select(F.coalesce(F.array_distinct("_cuts"), F.array().cast("array<double>")).alias("_cuts"))
    return df.crossJoin(F.broadcast(distinct)).withColumn("_range", F.coalesce(_range(value, F.col("_cuts")), F.lit(-1))).drop("_cuts")

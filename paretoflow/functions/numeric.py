"""Numeric Column helpers: complete sums, exact quantiles, intervals, tolerances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import ranged, same

METER, MONEY = "decimal(38,9)", "decimal(38,12)"
#: 97.5 % point of the standard normal distribution.
Z95 = 1.959963984540054


def sum_complete(value: Column | str) -> Column:
    """The sum, or null as soon as one value is unknown."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def mean_complete(value: Column | str) -> Column:
    """Equal-weight mean of all values, or null as soon as one is unknown."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c) / F.count(c))


def ratio(numerator: Column, denominator: Column, places: int = 6) -> Column:
    """Rounded double ratio; null for a zero denominator."""
    d = denominator.cast("double")
    return F.round(F.try_divide(numerator.cast("double"), d), places)


def quantile_type7(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, str], scale: str = "decimal(18,9)"
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, in decimals.

    One row per group with a column for each entry of ``probabilities`` (name: decimal text) and
    ``samples``. Nulls are skipped. Equal values are counted together, and counts by range of values say which range
    holds an order statistic; only these ranges are sorted, so no task sorts a group, however large.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast(scale).alias("_x"))
    values = ranged(known.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")), "_x")
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum("_c").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = values.groupBy(*keys, "_range").agg(F.sum("_c").alias("_c")).withColumn("_before", before).withColumn("_n", F.sum("_c").over(group))
    places = {}
    for name, p in probabilities.items():
        at = F.lit(p).cast("decimal(9,6)") * (F.col("_n") - 1)
        low = F.floor(at).cast("long")
        places[name] = (low, F.least(low + 1, F.col("_n") - 1), (at - low).cast("decimal(9,6)"))
    asked = F.array(*[c for low, high, _ in places.values() for c in (low, high)])
    wanted = counts.filter(F.exists(asked, lambda i: (i >= F.col("_before")) & (i < F.col("_before") + F.col("_c")))).drop("_c")
    inside = values.alias("v").join(wanted.alias("w"), same("v", "w", [*keys, "_range"])).select(
        *[F.col(f"v.{k}").alias(k) for k in keys], F.col("v._range").alias("_range"), "v._x", "v._c", "w._before", "w._n"
    )
    upto = Window.partitionBy(*keys, "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.withColumn("_end", F.col("_before") + F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
    aggregates = [F.max("_n").alias("samples")]
    for name, (low, high, fraction) in places.items():
        for end, i in (("lo", low), ("hi", high)):
            aggregates.append(F.max(F.when((F.col("_start") <= i) & (i < F.col("_end")), F.col("_x"))).alias(f"_{name}_{end}"))
        aggregates.append(F.max(fraction).alias(f"_{name}_f"))
    found = placed.groupBy(*keys).agg(*aggregates)
    interpolated = [
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).cast(scale).alias(n)
        for n in probabilities
    ]
    return found.select(*keys, *interpolated, "samples")


def median_clamped(values: Column) -> Column:
    """Median of an array: the middle, or the lower middle plus half the gap."""
    s, n = F.array_sort(values), F.size(values)
    lo = F.element_at(s, (F.floor((n - 1) / 2) + 1).cast("int"))
    hi = F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, F.least(F.greatest(lo + (hi - lo) / 2, lo), hi))


def wilson(passed: Column, attempted: Column) -> tuple[Column, Column]:
    """The 95 % Wilson score interval in percent, with exact ends at none and all."""
    n, k = attempted.cast("double"), passed.cast("double")
    p, z2 = k / n, Z95 * Z95
    centre, spread = p + z2 / (2 * n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    low = F.when(k == 0, 0.0).otherwise(100 * (centre - spread) / scale)
    high = F.when(k == n, 100.0).otherwise(100 * (centre + spread) / scale)
    return F.when(n > 0, low), F.when(n > 0, high)


def recover_successes(rate: Column, n: Column, places: int = 4) -> Column:
    """The one whole number k with k / n rounding to ``rate``, or null if there is none or several.

    ``rate`` is a decimal of ``places`` places.
    """
    half = F.lit(5 * 10 ** -(places + 1)).cast(f"decimal(18,{places + 1})")
    r = rate.cast(f"decimal(18,{places + 1})")
    low, high = F.ceil((r - half) * n), F.floor((r + half) * n)
    return F.when((low == high) & (low >= 0) & (low <= n), low)


def close(left: Column, right: Column, tolerance: float = 1e-9) -> Column:
    """|a - b| within ``tolerance`` of the larger magnitude, which counts as 1 at least."""
    return F.abs(left - right) <= F.greatest(F.abs(left), F.abs(right), F.lit(1.0)) * tolerance


def age_hours(earlier: Column, now: Column) -> Column:
    """Exact age in hours as a decimal, from microseconds."""
    micros = F.unix_micros(now) - F.unix_micros(earlier)
    return (micros.cast("decimal(20,0)") / F.lit(3_600_000_000).cast("decimal(11,0)")).cast("decimal(30,12)")


def softmax(values: Column) -> Column:
    """Stable softmax of an array."""
    top = F.array_max(values)
    powers = F.transform(values, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def brier(probabilities: Column, expected: Column) -> Column:
    """Mean squared error of a probability array against a 0/1 array."""
    errors = F.zip_with(probabilities, expected, lambda p, e: (p - e) * (p - e))
    return F.aggregate(errors, F.lit(0.0), lambda a, x: a + x) / F.size(errors)

"""Measurements on own hardware: comparable records, samples, checks, memory and counters.

A record is one configuration under one workload; records of one catalog share the workload exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import median_clamped


class LocalError(ValueError):
    """Records cannot stand in one catalog."""


# Fixed value: what describes how a record was taken, not what was asked for.
NOT_COMPARED = ("decode_rate_source", "finish_reasons", "time_to_first_token_source", "construction_input_tokens", "token_count_url")


def comparison_position(position: Column) -> Column:
    """The part of a workload's position that must agree, as sorted entries."""
    return F.array_sort(F.map_entries(F.map_filter(position, lambda k, _: ~k.isin(*NOT_COMPARED))))


def is_uncached(cache_state: Column, cache_hits: Column) -> Column:
    """Cache disabled, or a miss whose hit counts (an array) are all zero; a miss without counts does not do."""
    return F.coalesce((cache_state == "disabled") | ((cache_state == "miss") & F.forall(cache_hits, lambda v: v == 0)), F.lit(False))


def percent(passed: Column, total: Column) -> Column:
    """Checks passed of all, in exact decimals; null without a check."""
    return F.try_divide(F.lit(100) * passed.cast("decimal(19,0)"), total.cast("decimal(19,0)")).cast("decimal(38,12)")


def reuse_percent(hit_tokens: Column, input_tokens: Column) -> Column:
    """Share of the input that came from the cache, for each sample of an array."""
    return F.transform(hit_tokens, lambda v: F.try_divide(F.lit(100.0) * v.cast("double"), input_tokens.cast("double")))


def sampled(values: Column) -> Column:
    """Observation of an array of samples: median, least and greatest, and how many."""
    return F.struct(median_clamped(values).alias("value"), F.array_min(values).alias("lower"), F.array_max(values).alias("upper"), F.size(values).cast("long").alias("sample_count"))


def incomparable(records: DataFrame, identity: Sequence[str], uncached: bool = False) -> DataFrame:
    """One row of what forbids one catalog: workload positions, repeated measurements and offerings, cached records.

    records: measurement_id, offering_id, position (map), cache_state, cache_hits (array), and the columns of ``identity``.
    """
    whole = F.struct(*identity, comparison_position(F.col("position")).alias("position"), *([] if uncached else ["cache_state"]))
    return records.agg(
        F.count_distinct(whole).alias("positions"),
        (F.count(F.lit(1)) - F.count_distinct("measurement_id")).alias("repeated_measurements"),
        (F.count(F.lit(1)) - F.count_distinct("offering_id")).alias("repeated_offerings"),
        F.count_if(~is_uncached(F.col("cache_state"), F.col("cache_hits"))).alias("cached"),
    )


def local_signals(records: DataFrame, identity: Sequence[str], uncached: bool = False) -> DataFrame:
    """Signals of comparable records: offering_id, signal, value, lower, upper, sample_count.

    Besides the columns of :func:`incomparable`: metrics map<string, array<double>>, input_tokens, and
    checks map<string, struct<passed long, total long>>.
    """
    found = incomparable(records, identity, uncached).first()
    if found["positions"] > 1:
        raise LocalError("records describe different workload positions")
    if found["repeated_measurements"] or found["repeated_offerings"]:
        raise LocalError("a measurement or an offering is repeated")
    if uncached and found["cached"]:
        raise LocalError("the uncached cohort has a cached record")
    series = records.select("offering_id", F.explode("metrics").alias("name", "values")).select("offering_id", F.concat(F.lit("local_"), "name").alias("signal"), sampled(F.col("values")).alias("o"))
    reuse = records.filter(F.size("cache_hits") > 0).select("offering_id", F.lit("local_prefix_cache_reuse_percent").alias("signal"), sampled(reuse_percent(F.col("cache_hits"), F.col("input_tokens"))).alias("o"))
    checks = records.select("offering_id", F.explode("checks").alias("name", "c")).select("offering_id", "name", "c.*").filter("total > 0")
    share = percent(F.col("passed"), F.col("total")).cast("double")
    null = F.lit(None).cast("double")
    of_checks = checks.select(
        "offering_id", F.concat(F.lit("local_"), "name", F.lit("_success_percent")).alias("signal"),
        F.struct(share.alias("value"), null.alias("lower"), null.alias("upper"), F.col("total").alias("sample_count")).alias("o"),
    )
    return series.unionByName(reuse).unionByName(of_checks).select("offering_id", "signal", "o.*")


def memory_summary(samples: DataFrame, keys: Sequence[str], score: Column | None = None) -> DataFrame:
    """Peaks of a memory capture: of each part on its own, and the parts at the moment of the combined peak.

    samples: elapsed, host, device, combined (null where the sample is incomplete). Of equal peaks the earliest counts.
    With a ``score`` (null where the sample is incomplete) the parts are those of the sample that scores highest.
    """
    height = F.col("combined") if score is None else score
    peak = F.max_by(F.struct("elapsed", "host", "device"), F.struct(height.alias("height"), (-F.col("elapsed")).alias("early")))
    complete = F.count("combined")
    found = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), complete.alias("complete_samples"), F.max("host").alias("peak_host"), F.max("device").alias("peak_device"),
        F.max("combined").alias("peak_combined"), F.when(complete > 0, peak).alias("p"),
    )
    return found.select(*keys, "samples", "complete_samples", "peak_host", "peak_device", "peak_combined", F.col("p.elapsed").alias("at_elapsed"), F.col("p.host").alias("host_at_peak"), F.col("p.device").alias("device_at_peak"))


def memory_bundle(repetitions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Peak over repetitions with its range, null as soon as one repetition is not eligible.

    repetitions: peak (null if not eligible), samples, observed_at.
    """
    whole = F.count("peak") == F.count(F.lit(1))
    of = lambda c: F.when(whole, c)
    return repetitions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.count("peak").alias("eligible_runs"), of(F.max("peak")).alias("value"), of(F.min("peak")).alias("lower"),
        of(F.max("peak")).alias("upper"), of(F.sum("samples")).alias("sample_count"), of(F.max("observed_at")).alias("observed_at"),
    )


def counter_deltas(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean acceptance of requests whose counter advanced by just one each; ``advanced`` is false for the others' groups.

    requests: before (null before the first), after, acceptance (0 to 1).
    """
    step = F.col("after") - F.coalesce("before", F.lit(0)) == 1
    good = F.coalesce(step & F.col("acceptance").between(0, 1), F.lit(False))
    return requests.groupBy(*keys).agg(F.bool_and(good).alias("advanced"), F.when(F.bool_and(good), F.avg(100 * F.col("acceptance"))).alias("acceptance_percent"))


def swap_delta(before: Column, after: Column) -> Column:
    """An aggregate: greatest growth of a group's swap, null as soon as one reading is missing."""
    delta = after - before
    return F.when(F.count(delta) == F.count(F.lit(1)), F.max(delta))


def machine_ratios(slow: DataFrame, fast: DataFrame, keys: Sequence[str], latency: str) -> DataFrame:
    """Speedup of one machine over another, artifact by artifact; both must have the same artifacts."""
    a, b = slow.select(*keys, F.col(latency).alias("slow")), fast.select(*keys, F.col(latency).alias("fast"))
    both = a.join(b, list(keys), "full_outer")
    if both.filter("slow IS NULL OR fast IS NULL").limit(1).count():
        raise LocalError("the machines did not measure the same artifacts")
    return both.withColumn("speedup", F.try_divide(F.col("slow").cast("double"), F.col("fast").cast("double")))


def family_coverage(cells: DataFrame) -> DataFrame:
    """Frontier coverage of model families, most covered first.

    cells: model_id, frontier_id, status (exact, near, evaluated or rejected), a row for each offering. A
    family's cell counts once, by its best offering.
    """
    order = F.when(F.col("status") == "exact", 3).when(F.col("status") == "near", 2).when(F.col("status") == "evaluated", 1).otherwise(0)
    best = cells.groupBy("model_id", "frontier_id").agg(F.max(order).alias("best"))
    found = best.groupBy("model_id").agg(
        F.count_if(F.col("best") >= 2).alias("coverage"), F.count_if(F.col("best") == 3).alias("exact"),
        F.count_if(F.col("best") >= 1).alias("evaluated"), F.count_if(F.col("best") == 0).alias("rejected_only"), F.count(F.lit(1)).alias("attempted"),
    )
    return found.orderBy(F.col("coverage").desc(), F.col("exact").desc(), "model_id")

"""Request traces to signals: validation, guards, two-level aggregation, latency, derived rates.

A trace row is a request, a model call, an attempt or a whole work unit. Rows roll up to work
units and those to offerings; one unknown meter makes a total unknown, at both levels.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import METER, MONEY, quantile_type7, sum_complete
from ..functions.text import has_forbidden_text

# The trace columns, by kind, in the order of the format.
TEXTS = ("workload_id", "workload_version", "work_unit_id", "offering_id", "request_id", "attempt_id")
PROVENANCE = ("adapter_id", "adapter_version", "upstream_system", "upstream_version", "upstream_commit", "collector_id", "collector_version")
METERS = (
    "input_uncached_tokens", "input_cache_read_tokens", "input_cache_write_tokens", "input_cache_write_5m_tokens",
    "input_cache_write_1h_tokens", "cache_storage_token_hours", "input_total_tokens", "output_tokens", "reasoning_tokens",
    "output_total_tokens", "tool_calls", "web_search_calls", "sandbox_seconds",
)
COSTS = ("other_cost_usd", "estimated_total_cost_usd", "provider_reported_total_cost_usd", "billed_total_cost_usd", "provider_marginal_cost_usd")
LATENCIES = ("ttft_ms", "output_tokens_per_second")
SCOPES = ("request", "model_call", "attempt", "work_unit")
UNIT = ("workload_id", "workload_version", "offering_id", "work_unit_id")
OFFERING = UNIT[:3]

SCHEMA = T.StructType(
    [T.StructField("schema_version", T.StringType()), T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in (*TEXTS, "observation_unit")]
    + [T.StructField(c, T.LongType()) for c in ("model_request_count", "attempt_count")]
    + [T.StructField(c, T.StringType()) for c in PROVENANCE]
    + [T.StructField("work_unit_success", T.DecimalType(18, 9))]
    + [T.StructField(c, T.DecimalType(38, 9)) for c in METERS]
    + [T.StructField(c, T.DecimalType(38, 12)) for c in COSTS]
    + [T.StructField(c, T.DecimalType(38, 9)) for c in LATENCIES]
)


class TraceError(ValueError):
    """A guard found rows that must not be aggregated. The text never echoes their values."""


def scope() -> Column:
    return F.coalesce("observation_unit", F.lit("request"))


#: Fixed value: meters that only a model call can fill.
TOKENS = (
    "input_uncached_tokens", "input_cache_read_tokens", "input_cache_write_tokens", "input_cache_write_5m_tokens",
    "input_cache_write_1h_tokens", "input_total_tokens", "output_tokens", "reasoning_tokens", "output_total_tokens",
)
#: Fixed value: the largest count that every JSON reader holds exactly.
MAX_COUNT = 2**53 - 1


def row_problem() -> Column:
    """The first rule that a row breaks, or null. Absent columns count as unknown only if the frame has them as nulls."""
    c = F.col
    some = lambda conditions: reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in conditions])
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    total = lambda *names: reduce(lambda a, b: a + b, [zero(n) for n in names])
    known = lambda *names: reduce(lambda a, b: a & b, [c(n).isNotNull() for n in names])
    producer = reduce(lambda a, b: a + b, [c(n).isNotNull().cast("int") for n in PROVENANCE[:5]])
    used = some([c(n) != 0 for n in TOKENS])
    generic, tiers = "input_cache_write_tokens", ("input_cache_write_5m_tokens", "input_cache_write_1h_tokens")
    read = ("input_uncached_tokens", "input_cache_read_tokens")
    input_parts = total(*read, generic, *tiers)
    whole_input = known("input_total_tokens", *read) & (known(generic) | known(*tiers))
    checks = [
        (some([c(n).isNull() | (F.trim(c(n)) == "") for n in TEXTS]), "text_missing"),
        (some([has_forbidden_text(c(n)) for n in (*TEXTS, "observation_unit", *PROVENANCE)]), "forbidden_text"),
        (~scope().isin(*SCOPES), "unknown_scope"),
        (c("timestamp").isNull(), "timestamp_missing"),
        (c("work_unit_success").isNull() | ~c("work_unit_success").between(0, 1), "success_out_of_range"),
        (some([c(n) < 0 for n in (*METERS, *COSTS, *LATENCIES)]), "negative_meter"),
        (some([~c(n).between(0, MAX_COUNT) for n in ("model_request_count", "attempt_count")]), "count_out_of_range"),
        ((scope() == "request") & (c("model_request_count") != 1), "request_counts_requests"),
        ((scope() != "work_unit") & c("attempt_count").isNotNull(), "attempts_outside_work_unit"),
        ((scope() != "request") & (c("ttft_ms").isNotNull() | c("output_tokens_per_second").isNotNull()), "timing_outside_request"),
        (~producer.isin(0, 5), "partial_provenance"),
        (c("collector_id").isNull() != c("collector_version").isNull(), "partial_collector"),
        (c("collector_id").isNotNull() & c("adapter_id").isNull(), "collector_without_producer"),
        (c("upstream_commit").isNotNull() & ~c("upstream_commit").rlike("^[0-9a-f]{40}$"), "commit_malformed"),
        ((c("model_request_count") == 0) & used, "tokens_without_requests"),
        ((c("attempt_count") == 0) & (used | (zero("model_request_count") > 0)), "use_without_attempts"),
        (c(generic).isNotNull() & (c(tiers[0]).isNotNull() | c(tiers[1]).isNotNull()), "two_cache_write_forms"),
        (c("input_total_tokens") < input_parts, "input_total_below_parts"),
        (whole_input & (c("input_total_tokens") != input_parts), "input_total_differs"),
        (c("output_total_tokens") < total("output_tokens", "reasoning_tokens"), "output_total_below_parts"),
        (known("output_total_tokens", "output_tokens", "reasoning_tokens") & (c("output_total_tokens") != total("output_tokens", "reasoning_tokens")), "output_total_differs"),
    ]
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(why)) for bad, why in checks])


def outside_workload(df: DataFrame, workload_id: str, workload_version: str) -> int:
    """How many rows belong to another workload or version; they must be none before an aggregation."""
    same = F.col("workload_id").eqNullSafe(workload_id) & F.col("workload_version").eqNullSafe(workload_version)
    return df.filter(~same).count()


def guard_counts(df: DataFrame) -> DataFrame:
    """One row: how many rows or groups break each guard. One pass by rows, three by groups."""
    rows = df.withColumn("_scope", scope())
    identity = F.struct(*PROVENANCE)
    units = rows.groupBy("workload_id", "workload_version", "work_unit_id").agg(
        F.count_distinct("offering_id").alias("offerings"),
        F.count_distinct("_scope").alias("scopes"),
        F.max(F.col("_scope") == "work_unit").alias("whole"),
        F.count(F.lit(1)).alias("n"),
        F.min("work_unit_success").alias("low"),
        F.max("work_unit_success").alias("high"),
        F.count("adapter_id").alias("adapters"),
    )
    by_unit = units.agg(
        F.count_if(F.col("offerings") != 1).alias("multi_offering"),
        F.count_if((F.col("scopes") > 1) | (F.col("whole") & (F.col("n") > 1))).alias("mixed_scope"),
        F.count_if(F.col("low") != F.col("high")).alias("inconsistent_outcome"),
        F.count_if(~F.col("adapters").isin(0) & (F.col("adapters") != F.col("n"))).alias("partial_provenance"),
    )
    attempts = rows.filter("_scope = 'attempt'").groupBy(*UNIT, "attempt_id").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_attempts"))
    requests = rows.groupBy("offering_id", "request_id").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_requests"))
    drift = rows.filter("adapter_id IS NOT NULL").groupBy("offering_id").agg(F.count_distinct(identity).alias("k")).agg(
        F.count_if(F.col("k") > 1).alias("provenance_drift")
    )
    invalid = rows.agg(F.count(row_problem()).alias("invalid_rows"))
    # Each side is a single row.
    return invalid.crossJoin(by_unit).crossJoin(attempts).crossJoin(requests).crossJoin(drift)


def check(df: DataFrame) -> None:
    """Raise TraceError for the first guard that is broken."""
    found = guard_counts(df).first().asDict()
    for name in ("invalid_rows", "multi_offering", "mixed_scope", "duplicate_attempts", "inconsistent_outcome", "duplicate_requests", "partial_provenance", "provenance_drift"):
        if found[name]:
            raise TraceError(name)


def request_count() -> Column:
    """Requests count one each; an aggregate row brings its count, and one without makes it unknown."""
    is_request = F.col("_scope") == "request"
    known = F.count_if(~is_request & F.col("model_request_count").isNull()) == 0
    return F.when(known, F.sum(F.when(is_request, F.lit(1)).otherwise(F.col("model_request_count"))))


def attempt_count() -> Column:
    return F.when(F.max("_scope") == "work_unit", F.max("attempt_count")).otherwise(F.count_distinct("attempt_id"))


def cache_writes() -> Column:
    """Cache writes are known if every row has just one of the two forms: the total, or both retention tiers."""
    total, short, long_ = (F.col(f"input_cache_write{s}_tokens") for s in ("", "_5m", "_1h"))
    generic = total.isNotNull() & short.isNull() & long_.isNull()
    tiers = total.isNull() & short.isNotNull() & long_.isNotNull()
    value = F.when(generic, total).when(tiers, short + long_)
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def work_units(df: DataFrame, meters: Sequence[str] = (*METERS, *COSTS)) -> DataFrame:
    rows = df.withColumn("_scope", scope())
    return rows.groupBy(*UNIT).agg(
        request_count().cast("long").alias("request_count"),
        attempt_count().cast("long").alias("attempt_count"),
        F.max("work_unit_success").alias("success"),
        F.max("timestamp").alias("observed_at"),
        *([cache_writes().alias("complete_cache_write_tokens")] if "input_cache_write_tokens" in meters else []),
        *[sum_complete(m).alias(m) for m in meters],
    )


def offerings(units: DataFrame, meters: Sequence[str] = (*METERS, *COSTS)) -> DataFrame:
    """Totals per offering; the grouping keys are a prefix of the work units' keys."""
    return units.groupBy(*OFFERING).agg(
        F.count(F.lit(1)).alias("work_unit_count"),
        F.sum("success").alias("success_count"),
        sum_complete("request_count").alias("request_count"),
        sum_complete("attempt_count").alias("attempt_count"),
        F.max("observed_at").alias("observed_at"),
        *([sum_complete("complete_cache_write_tokens").alias("complete_cache_write_tokens")] if "input_cache_write_tokens" in meters else []),
        *[sum_complete(m).alias(m) for m in meters],
    )


def latency(df: DataFrame, column: str = "ttft_ms") -> DataFrame:
    """Exact median and 95 % quantile of known values, and how many there are."""
    return quantile_type7(df, OFFERING, column, {f"{column}_p50": "0.5", f"{column}_p95": "0.95"})


def rates(totals: DataFrame, meters: Sequence[str]) -> DataFrame:
    """Long table (offering, signal, value): per work unit, per success, success and cache hit rate.

    A signal without a value is left out: nothing per success at zero successes.
    """
    units, wins = F.col("work_unit_count").cast("double"), F.col("success_count").cast("double")
    pairs: list[tuple[str, Column]] = [("success_rate", F.try_divide(wins, units))]
    for m in (*meters, "request_count"):
        x = F.col(m).cast("double")
        pairs += [(f"{m}_per_work_unit", F.try_divide(x, units)), (f"{m}_per_success", F.try_divide(x, wins))]
    if {"input_cache_read_tokens", "input_uncached_tokens", "input_cache_write_tokens"} <= set(meters):
        # All of the input must be known: uncached, read from the cache, and written to it in either form.
        hits, fresh, written = (F.col(c).cast("double") for c in ("input_cache_read_tokens", "input_uncached_tokens", "complete_cache_write_tokens"))
        pairs.append(("observed_cache_hit_rate", F.try_divide(hits, hits + fresh + written)))
    entries = F.array(*[F.struct(F.lit(n).alias("signal"), v.alias("value")) for n, v in pairs])
    return totals.select(*OFFERING, F.explode(entries).alias("e")).select(*OFFERING, "e.signal", "e.value").filter("value IS NOT NULL")


# What the quantities of a signal's name are counted in.
QUANTITY_UNITS = {m: "tokens" for m in METERS if m.endswith("tokens")} | {
    "request_count": "requests", "attempt_count": "attempts", "cache_storage_token_hours": "token_hours", "tool_calls": "calls",
    "web_search_calls": "calls", "sandbox_seconds": "seconds",
} | {c: "USD" for c in COSTS}


def unit_of(signal: Column) -> Column:
    """The unit of an aggregated signal, or null for a name that is none."""
    quantity = F.regexp_extract(signal, r"^(.*)_per_(work_unit|success)$", 1)
    per = F.regexp_extract(signal, r"^(.*)_per_(work_unit|success)$", 2)
    table = F.create_map(*[F.lit(x) for pair in QUANTITY_UNITS.items() for x in pair])
    return (
        F.when(signal.isin("success_rate", "observed_cache_hit_rate"), "ratio")
        .when(signal.startswith("ttft_"), "milliseconds")
        .when(signal == "output_tokens_per_second_p50", "tokens/second")
        .when(signal.isin("work_unit_count", "successful_work_units"), "work_units")
        .when(per != "", F.concat(F.try_element_at(table, quantity), F.lit("/"), per))
    )


def provenance(df: DataFrame) -> DataFrame:
    """Distinct producers, in order, missing parts first."""
    return df.select(*PROVENANCE).distinct().orderBy(*[F.asc_nulls_first(c) for c in PROVENANCE])


def enrich(catalog: DataFrame, summary: DataFrame, key: str = "offering_id") -> DataFrame:
    """Catalog rows with their trace summary; summaries of unknown offerings are refused."""
    if summary.join(catalog, key, "left_anti").limit(1).count():
        raise TraceError("summary of an unknown offering")
    return catalog.join(summary, key, "left")


def legacy_zeros(df: DataFrame, meters: Sequence[str]) -> DataFrame:
    """First trace version: an absent meter is zero."""
    return df.withColumns({m: F.coalesce(F.col(m), F.lit(0).cast(METER)) for m in meters})


def money(value: Column) -> Column:
    return value.cast(MONEY)

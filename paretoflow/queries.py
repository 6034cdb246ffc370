"""Registered queries over the shared tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import formula, numeric, text
from .operators import admission, catalogs, estimates, frontier, history, traces
from .operators.frontier import Axis
from .plans.tables import MONEY, OFFERINGS, TRACES, offerings, table
from .plans.tables import traces as trace_rows
from .sources import imports
from .streaming import monotonic, run
from .streaming import traces as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


COST, QUALITY = Axis("cost", "min"), Axis("quality", "max")
POINT = "(a.cost <= b.cost AND a.quality >= b.quality AND (a.cost < b.cost OR a.quality > b.quality))"
MEMBERS = f"SELECT b.* FROM {OFFERINGS} b WHERE NOT EXISTS (SELECT 1 FROM {OFFERINGS} a WHERE a.offering_id <> b.offering_id AND {POINT})"


@query(f"SELECT offering_id, cost, quality FROM ({MEMBERS})")
def frontier_members_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.members(offerings(spark, sf_dir), "offering_id", [COST, QUALITY]).select("offering_id", "cost", "quality")


@query(
    f"""SELECT b.offering_id, count(a.offering_id) AS dominators, coalesce(min(a.offering_id), -1) AS first_dominator,
  coalesce(string_agg(CAST(a.offering_id AS VARCHAR), ',' ORDER BY a.offering_id), '') AS dominated_by
  FROM {OFFERINGS} b LEFT JOIN {OFFERINGS} a ON a.offering_id <> b.offering_id AND {POINT} GROUP BY b.offering_id"""
)
def frontier_dominated_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frontier.dominated_by(offerings(spark, sf_dir), "offering_id", [COST, QUALITY])
    return found.select(
        "offering_id",
        F.size("dominated_by").cast("long").alias("dominators"),
        F.coalesce(F.array_min("dominated_by"), F.lit(-1)).alias("first_dominator"),
        F.array_join(F.col("dominated_by").cast("array<string>"), ",").alias("dominated_by"),
    )


EPSILON = [Axis("cost", "min", "0.5", "0.02"), Axis("quality", "max", "0.5", "0.02")]
_TOL = "(CAST(0.5 AS DECIMAL(18,9)) + CAST(0.02 AS DECIMAL(9,6)) * greatest(abs(a.{0}), abs(b.{0})))"
_EPS = f"""(a.cost <= b.cost + {_TOL.format('cost')} AND a.quality >= b.quality - {_TOL.format('quality')}
  AND (a.cost < b.cost - {_TOL.format('cost')} OR a.quality > b.quality + {_TOL.format('quality')}))"""


@query(f"SELECT b.offering_id, b.cost, b.quality FROM {OFFERINGS} b WHERE NOT EXISTS (SELECT 1 FROM {OFFERINGS} a WHERE a.offering_id <> b.offering_id AND {_EPS})")
def frontier_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = offerings(spark, sf_dir).select("offering_id", "cost", "quality")
    return frontier.members(narrow, "offering_id", EPSILON)


ROBUST = [Axis("cost", "min", lower="cost_low", upper="cost_high"), Axis("quality", "max", lower="quality_low", upper="quality_high")]
_BOUNDS = f"""(SELECT offering_id, cost * 0.999 AS cost_low, cost * 1.001 AS cost_high, quality * 0.999 AS quality_low,
  quality * 1.001 AS quality_high FROM {OFFERINGS})"""


@query(
    f"""SELECT b.offering_id FROM {_BOUNDS} b WHERE NOT EXISTS (SELECT 1 FROM {_BOUNDS} a WHERE a.offering_id <> b.offering_id
  AND a.cost_high <= b.cost_low AND a.quality_low >= b.quality_high AND (a.cost_high < b.cost_low OR a.quality_low > b.quality_high))"""
)
def frontier_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda x: F.lit(x).cast("decimal(4,3)")
    bounded = offerings(spark, sf_dir).select(
        "offering_id",
        (F.col("cost") * d("0.999")).alias("cost_low"), (F.col("cost") * d("1.001")).alias("cost_high"),
        (F.col("quality") * d("0.999")).alias("quality_low"), (F.col("quality") * d("1.001")).alias("quality_high"),
    ).withColumns({"cost": F.col("cost_low"), "quality": F.col("quality_low")})
    return frontier.members(bounded, "offering_id", ROBUST, robust=True).select("offering_id")


@query(
    f"""SELECT b.region, b.offering_id, b.cost, b.quality FROM {OFFERINGS} b WHERE NOT EXISTS (SELECT 1 FROM {OFFERINGS} a
  WHERE a.region = b.region AND a.offering_id <> b.offering_id AND {POINT})"""
)
def frontier_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frontier.members(offerings(spark, sf_dir), "offering_id", [COST, QUALITY], within=["region"])
    return found.select("region", "offering_id", "cost", "quality")


@query(
    """SELECT b.p_partkey, b.p_brand FROM part b WHERE NOT EXISTS (SELECT 1 FROM part a WHERE a.p_brand = b.p_brand
  AND a.p_partkey <> b.p_partkey AND a.p_retailprice <= b.p_retailprice AND a.p_size >= b.p_size
  AND (a.p_retailprice < b.p_retailprice OR a.p_size > b.p_size))"""
)
def window_frontier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return frontier.members(parts, "p_partkey", [Axis("p_retailprice", "min"), Axis("p_size", "max")], within=["p_brand"]).select("p_partkey", "p_brand")


@query(f"SELECT offering_id, row_number() OVER (ORDER BY cost, quality DESC, offering_id) AS rank FROM ({MEMBERS})")
def rank_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frontier.members(offerings(spark, sf_dir), "offering_id", [COST, QUALITY])
    return frontier.ranked(found, "offering_id", [COST, QUALITY]).select("offering_id", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT offering_id, row_number() OVER (ORDER BY quality DESC, cost, offering_id) AS place FROM (SELECT * FROM {OFFERINGS} ORDER BY quality DESC, cost, offering_id LIMIT 5)")
def selection_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.select_top(offerings(spark, sf_dir), "offering_id", [QUALITY, COST], 5).select("offering_id", F.col("place").cast("long").alias("place"))


@query(
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY cost, quality DESC, offering_id) AS n FROM {OFFERINGS})
SELECT offering_id, region, row_number() OVER (ORDER BY cost, quality DESC, offering_id) AS place
  FROM (SELECT * FROM p WHERE n <= 2 ORDER BY cost, quality DESC, offering_id LIMIT 6)"""
)
def selection_provider_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frontier.select_top(offerings(spark, sf_dir), "offering_id", [COST, QUALITY], 6, "region", 2)
    return found.select("offering_id", "region", F.col("place").cast("long").alias("place"))


_REL = "CAST({0} AS DOUBLE) / CAST(greatest(abs({1}), abs({2})) AS DOUBLE)"
_WORSE = f"greatest(0.0, {_REL.format('(a.cost - b.cost)', 'a.cost', 'b.cost')}, {_REL.format('(b.quality - a.quality)', 'a.quality', 'b.quality')})"
_BETTER = f"greatest(0.0, {_REL.format('(b.cost - a.cost)', 'a.cost', 'b.cost')}, {_REL.format('(a.quality - b.quality)', 'a.quality', 'b.quality')})"


# By the definition: tolerances from 0 on at which some other point dominates, as far as their intervals connect.
@query(
    f"""WITH o AS MATERIALIZED (SELECT * FROM {OFFERINGS}),
i AS (SELECT b.offering_id, {_WORSE} AS low, {_BETTER} AS high FROM o b JOIN o a ON a.offering_id <> b.offering_id),
l AS (SELECT offering_id, list({{'low': low, 'high': high}} ORDER BY low) AS all_of FROM i WHERE low < high GROUP BY 1)
SELECT o.offering_id, round(coalesce(list_reduce(list_prepend({{'low': 0.0::DOUBLE, 'high': 0.0::DOUBLE}}, all_of),
  lambda r, x: {{'low': 0.0::DOUBLE, 'high': CASE WHEN x.low - r.high <= 1e-14 THEN greatest(r.high, x.high) ELSE r.high END}}).high, 0), 9) AS epsilon FROM o LEFT JOIN l USING (offering_id)"""
)
def proximity_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frontier.proximity(offerings(spark, sf_dir), "offering_id", [COST, QUALITY])
    return found.select("offering_id", F.round("epsilon", 9).alias("epsilon"))


@query(
    """SELECT s_suppkey, CASE WHEN n_name NOT IN ('NATION_1', 'FRANCE', 'GERMANY', 'CHINA') THEN 'provider_not_allowed' ELSE '' END AS provider_reason,
  CASE WHEN r_name NOT IN ('ASIA', 'EUROPE') THEN 'region_not_allowed' ELSE '' END AS region_reason,
  CASE WHEN s_acctbal <= 0 THEN 'missing_capability:solvent' ELSE '' END AS capability_reason,
  CAST((n_name NOT IN ('NATION_1', 'FRANCE', 'GERMANY', 'CHINA'))::INT + (r_name NOT IN ('ASIA', 'EUROPE'))::INT + (s_acctbal <= 0)::INT AS BIGINT) AS n_reasons
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    able = F.filter(F.array(F.when(F.col("s_acctbal") > 0, "solvent")), lambda x: x.isNotNull())
    why = admission.eligibility(
        F.col("n_name"), F.col("r_name"), able, ["NATION_1", "FRANCE", "GERMANY", "CHINA"], ["ASIA", "EUROPE"], ["solvent"]
    )
    has = lambda reason: F.when(F.array_contains("why", reason), reason).otherwise("")
    return rows.withColumn("why", why).select(
        "s_suppkey",
        has("provider_not_allowed").alias("provider_reason"),
        has("region_not_allowed").alias("region_reason"),
        has("missing_capability:solvent").alias("capability_reason"),
        F.size("why").cast("long").alias("n_reasons"),
    )


@query(
    f"""SELECT offering_id, CASE WHEN region = 'AFRICA' THEN 'region_not_allowed' WHEN cost > 2500000 AND quality < 1000 THEN 'cost:above_maximum|quality:below_minimum'
  WHEN cost > 2500000 THEN 'cost:above_maximum' WHEN quality < 1000 THEN 'quality:below_minimum'
  WHEN balance < 0 THEN 'balance:below_minimum' ELSE '' END AS reasons FROM {OFFERINGS}"""
)
def staged_thresholds_and_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.array_compact(F.array(
        admission.gate_reason(F.col("cost"), F.col("cost"), F.col("cost"), None, "2500000", False, "cost"),
        admission.gate_reason(F.col("quality"), F.col("quality"), F.col("quality"), "1000", None, False, "quality"),
    ))
    region = admission.reasons((F.col("region") == "AFRICA", "region_not_allowed"))
    gate = F.array_compact(F.array(admission.gate_reason(F.col("balance"), F.col("balance"), F.col("balance"), "0", None, False, "balance")))
    return offerings(spark, sf_dir).select("offering_id", F.array_join(admission.staged(region, one, gate), "|").alias("reasons"))


@query(
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderpriority = '5-LOW' THEN 'tier_not_accepted' END,
  CASE WHEN o_orderstatus = 'P' THEN 'source_missing' END,
  CASE WHEN epoch_us(TIMESTAMP '1998-01-01') - epoch_us(CAST(o_orderdate AS TIMESTAMP)) < -300000000 THEN 'observed_at_in_future' END,
  CASE WHEN epoch_us(TIMESTAMP '1998-01-01') - epoch_us(CAST(o_orderdate AS TIMESTAMP)) > 17520 * 3600000000 THEN 'stale' END,
  CASE WHEN o_custkey % 50 < 5 THEN 'too_few_samples' END, 'admitted') AS reason FROM orders"""
)
def admission_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = admission.Requirements(tiers=("measured",), max_age_hours=17520, minimum_samples=5)
    tier = F.when(F.col("o_orderpriority") == "5-LOW", "estimated").otherwise("measured")
    reason = admission.observation_reason(
        need, F.lit("1998-01-01 00:00:00").cast("timestamp"), tier, F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
        F.col("o_orderdate").cast("timestamp"), F.pmod("o_custkey", F.lit(50)), F.lit(None), F.lit(None),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(reason, F.lit("admitted")).alias("reason"))


@query(
    """WITH a AS (SELECT c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'lower:missing' WHEN c_acctbal * 0.9 < 500 THEN 'balance:below_minimum' ELSE 'passed' END AS gate FROM customer)
SELECT c_mktsegment, replace(gate, 'lower:missing', 'balance:missing') AS gate, count(*) AS n FROM a GROUP BY ALL"""
)
def gate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") * 0.9)
    gate = admission.gate_reason(F.col("c_acctbal"), low, F.col("c_acctbal"), "500", None, True, "balance")
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment", F.coalesce(gate, F.lit("passed")).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH p(frontier_id, mode) AS (VALUES ('a', 'require_quality'), ('b', 'allow_catalog_only'), ('c', 'allow_vendor_reported'), ('d', 'mark_unverified'))
SELECT CAST(s_suppkey AS BIGINT) AS offering_id, frontier_id,
  CASE WHEN s_acctbal > 5000 OR mode = 'allow_catalog_only' OR (mode = 'allow_vendor_reported' AND s_acctbal > 0) THEN 'admit'
    WHEN mode = 'mark_unverified' THEN 'admit_unverified' ELSE 'hold' END AS decision,
  CASE WHEN s_acctbal > 5000 THEN 'quality_evidence' WHEN mode = 'allow_catalog_only' THEN 'catalog_only_allowed'
    WHEN mode = 'allow_vendor_reported' AND s_acctbal > 0 THEN 'vendor_reported_allowed' WHEN mode = 'mark_unverified' THEN 'unverified'
    ELSE 'quality_required' END AS reason,
  CASE WHEN s_acctbal <= 5000 AND (mode IN ('allow_catalog_only', 'mark_unverified') OR (mode = 'allow_vendor_reported' AND s_acctbal > 0)) THEN 'provisional' END AS marker
  FROM supplier CROSS JOIN p"""
)
def frontier_admission_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = spark.sql("SELECT * FROM VALUES ('a', 'require_quality'), ('b', 'allow_catalog_only'), ('c', 'allow_vendor_reported'), ('d', 'mark_unverified') AS t(frontier_id, mode)")
    found = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("offering_id"), (F.col("s_acctbal") > 5000).alias("has_quality"), (F.col("s_acctbal") > 0).alias("vendor_reported")
    )
    return admission.frontier_admissions(found, policies)


# Traces

_UNITS = f"""(SELECT workload_id, workload_version, offering_id, work_unit_id,
  CAST(sum(CASE WHEN observation_unit = 'request' THEN 1 ELSE model_request_count END) AS BIGINT) AS request_count,
  count(DISTINCT attempt_id) AS attempt_count, max(work_unit_success) AS success, max(timestamp) AS observed_at,
  CASE WHEN count(meter) = count(*) THEN sum(meter) END AS meter, sum(spend) AS spend FROM {TRACES} GROUP BY ALL)"""
_OFFERINGS = f"""(SELECT workload_id, workload_version, offering_id, count(*) AS work_unit_count, sum(success) AS success_count,
  CAST(sum(request_count) AS BIGINT) AS request_count, CAST(sum(attempt_count) AS BIGINT) AS attempt_count, max(observed_at) AS observed_at,
  CASE WHEN count(meter) = count(*) THEN sum(meter) END AS meter, sum(spend) AS spend FROM {_UNITS} GROUP BY ALL)"""
TRACE_METERS = ("meter", "spend")


@query(
    f"SELECT offering_id, work_unit_id, request_count, attempt_count, CAST(success AS DOUBLE) AS success, CAST(meter AS DOUBLE) AS meter, CAST(spend AS DOUBLE) AS spend, epoch_us(observed_at) AS observed_us FROM {_UNITS}"
)
def trace_work_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.work_units(trace_rows(spark, sf_dir), TRACE_METERS).select(
        "offering_id", "work_unit_id", "request_count", "attempt_count",
        *[F.col(c).cast("double").alias(c) for c in ("success", *TRACE_METERS)],
        F.unix_micros("observed_at").alias("observed_us"),
    )


@query(
    f"SELECT offering_id, work_unit_count, CAST(success_count AS DOUBLE) AS success_count, request_count, attempt_count, CAST(meter AS DOUBLE) AS meter, CAST(spend AS DOUBLE) AS spend, epoch_us(observed_at) AS observed_us FROM {_OFFERINGS}"
)
def trace_offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = traces.work_units(trace_rows(spark, sf_dir), TRACE_METERS)
    return traces.offerings(units, TRACE_METERS).select(
        "offering_id", "work_unit_count", F.col("success_count").cast("double").alias("success_count"), "request_count", "attempt_count",
        *[F.col(c).cast("double").alias(c) for c in TRACE_METERS],
        F.unix_micros("observed_at").alias("observed_us"),
    )


@query(f"SELECT event_type, CAST(CASE WHEN count(meter) = count(*) THEN sum(meter) END AS DOUBLE) AS complete, CAST(sum(meter) AS DOUBLE) AS partial, count(*) AS n FROM {TRACES} GROUP BY event_type")
def trace_sum_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_rows(spark, sf_dir).groupBy("event_type").agg(
        numeric.sum_complete("meter").cast("double").alias("complete"), F.sum("meter").cast("double").alias("partial"), F.count(F.lit(1)).alias("n")
    )


@query(f"SELECT offering_id, count(DISTINCT attempt_id) AS attempts, count(DISTINCT work_unit_id) AS work_units FROM {TRACES} GROUP BY offering_id")
def trace_attempts_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace_rows(spark, sf_dir)
    # Two plain aggregations over a shared prefix of keys instead of an expanded distinct count.
    return rows.groupBy("offering_id").agg(F.count_distinct("attempt_id").alias("attempts"), F.count_distinct("work_unit_id").alias("work_units"))


_T7 = """(max(x) FILTER (WHERE i = CAST(floor({p} * (n - 1)) AS BIGINT)) + (max(x) FILTER (WHERE i = least(CAST(floor({p} * (n - 1)) AS BIGINT) + 1, n - 1))
  - max(x) FILTER (WHERE i = CAST(floor({p} * (n - 1)) AS BIGINT))) * max({p} * (n - 1) - floor({p} * (n - 1))))"""


@query(
    f"""WITH r AS (SELECT offering_id, ttft_ms AS x, row_number() OVER (PARTITION BY offering_id ORDER BY ttft_ms) - 1 AS i,
  count(*) OVER (PARTITION BY offering_id) AS n FROM {TRACES} WHERE ttft_ms IS NOT NULL)
SELECT offering_id, round(CAST({_T7.format(p='CAST(0.5 AS DECIMAL(9,6))')} AS DOUBLE), 6) AS p50,
  round(CAST({_T7.format(p='CAST(0.95 AS DECIMAL(9,6))')} AS DOUBLE), 6) AS p95, max(n) AS samples FROM r GROUP BY offering_id"""
)
def trace_latency_type7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traces.latency(trace_rows(spark, sf_dir))
    return found.select("offering_id", *[F.round(F.col(f"ttft_ms_{p}").cast("double"), 6).alias(p) for p in ("p50", "p95")], "samples")


@query(
    f"""WITH t AS (SELECT offering_id, CAST(work_unit_count AS DOUBLE) AS u, CAST(success_count AS DOUBLE) AS w, CAST(spend AS DOUBLE) AS s, CAST(request_count AS DOUBLE) AS r FROM {_OFFERINGS}),
e AS (SELECT offering_id, 'success_rate' AS signal, w / u AS value FROM t UNION ALL SELECT offering_id, 'spend_per_work_unit', s / u FROM t
  UNION ALL SELECT offering_id, 'spend_per_success', CASE WHEN w <> 0 THEN s / w END FROM t UNION ALL SELECT offering_id, 'request_count_per_work_unit', r / u FROM t
  UNION ALL SELECT offering_id, 'request_count_per_success', CASE WHEN w <> 0 THEN r / w END FROM t)
SELECT offering_id, signal, round(value, 6) AS value FROM e WHERE value IS NOT NULL"""
)
def trace_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = traces.offerings(traces.work_units(trace_rows(spark, sf_dir), ["spend"]), ["spend"])
    return traces.rates(totals, ["spend"]).select("offering_id", "signal", F.round("value", 6).alias("value"))


_FULL = """(SELECT 'w' AS workload_id, '1' AS workload_version, 'off-' || (user_id % 16 + (event_id % 97 = 0)::INT) AS offering_id, user_id || ':' || day(ts) AS work_unit_id,
  CASE WHEN event_id % 89 = 0 THEN '' WHEN event_id % 83 = 0 THEN '7' ELSE CAST(event_id AS VARCHAR) END AS request_id, user_id || ':' || day(ts) || ':' || hour(ts) AS attempt_id,
  CASE WHEN user_id % 3 = 0 THEN 'attempt' WHEN event_id % 79 = 0 THEN 'page' WHEN event_id % 73 = 0 THEN 'work_unit' ELSE 'request' END AS unit,
  CASE WHEN event_id % 71 = 0 THEN 2 END AS attempt_count, CASE WHEN event_id % 67 = 0 THEN 1.5 WHEN (user_id + day(ts)) % 3 <> 0 OR event_id % 61 = 0 THEN 1 ELSE 0 END AS success,
  CASE WHEN event_type <> 'error' THEN 'a' END AS adapter_id, CASE WHEN event_id % 59 = 0 OR event_type = 'error' THEN NULL ELSE '1' END AS adapter_version,
  round(value, 2) - CASE WHEN event_id % 53 = 0 THEN 100000 ELSE 0 END AS spend, CASE WHEN event_id % 47 = 0 THEN 5 END AS input_total, event_id % 10 AS uncached, event_id % 43 = 0 AS both_forms, event_type FROM events)"""
_VERDICT = """CASE WHEN request_id = '' THEN 'text_missing' WHEN unit = 'page' THEN 'unknown_scope' WHEN success NOT BETWEEN 0 AND 1 THEN 'success_out_of_range' WHEN spend < 0 THEN 'negative_meter'
  WHEN unit <> 'work_unit' AND attempt_count IS NOT NULL THEN 'attempts_outside_work_unit' WHEN adapter_id IS NOT NULL AND adapter_version IS NULL THEN 'partial_provenance'
  WHEN both_forms THEN 'two_cache_write_forms' WHEN input_total < uncached THEN 'input_total_below_parts' END"""


def _full_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces of every column, some of which break each rule."""
    e, u = F.col("event_id"), F.col("user_id")
    at = F.col("ts").cast("timestamp")
    day = F.dayofmonth(at)
    unit = F.concat_ws(":", u.cast("string"), day.cast("string"))
    known = F.when(F.col("event_type") != "error", "a")
    whole = F.when((e % 59 != 0) & (F.col("event_type") != "error"), "1")
    rows = table(spark, sf_dir, "events").select(
        at.alias("timestamp"), F.lit("w").alias("workload_id"), F.lit("1").alias("workload_version"), unit.alias("work_unit_id"),
        F.concat(F.lit("off-"), (u % 16 + F.when(e % 97 == 0, 1).otherwise(0)).cast("string")).alias("offering_id"),
        F.when(e % 89 == 0, "").when(e % 83 == 0, "7").otherwise(e.cast("string")).alias("request_id"), F.concat_ws(":", unit, F.hour(at).cast("string")).alias("attempt_id"),
        F.when(u % 3 == 0, "attempt").when(e % 79 == 0, "page").when(e % 73 == 0, "work_unit").otherwise("request").alias("observation_unit"),
        F.when(e % 71 == 0, 2).alias("attempt_count"), F.when(e % 67 == 0, 1.5).when(((u + day) % 3 != 0) | (e % 61 == 0), 1.0).otherwise(0.0).alias("work_unit_success"),
        known.alias("adapter_id"), whole.alias("adapter_version"), known.alias("upstream_system"), known.alias("upstream_version"),
        F.when(known.isNotNull(), "0" * 40).alias("upstream_commit"), (F.round("value", 2) - F.when(e % 53 == 0, 100000).otherwise(0)).alias("other_cost_usd"),
        F.when(e % 47 == 0, 5).alias("input_total_tokens"), (e % 10).alias("input_uncached_tokens"), F.when(e % 43 == 0, 1).alias("input_cache_write_tokens"),
        F.when(e % 43 == 0, 1).alias("input_cache_write_5m_tokens"),
    )
    return imports.as_traces(rows)


@query(
    f"""WITH t AS (SELECT *, {_VERDICT} AS bad FROM {_FULL}), u AS (SELECT work_unit_id, count(DISTINCT offering_id) AS o, count(DISTINCT unit) AS s, bool_or(unit = 'work_unit') AS w, count(*) AS n, min(success) AS lo,
  max(success) AS hi, count(adapter_id) AS a FROM t GROUP BY work_unit_id),
q AS (SELECT offering_id, request_id, count(*) AS n FROM t GROUP BY ALL), d AS (SELECT offering_id, work_unit_id, attempt_id, count(*) AS n FROM t WHERE unit = 'attempt' GROUP BY ALL),
p AS (SELECT offering_id, count(DISTINCT coalesce(adapter_version, '-')) AS k FROM t WHERE adapter_id IS NOT NULL GROUP BY 1)
SELECT count(*) FILTER (WHERE o <> 1) AS multi_offering, count(*) FILTER (WHERE s > 1 OR (w AND n > 1)) AS mixed_scope, count(*) FILTER (WHERE lo <> hi) AS inconsistent_outcome, count(*) FILTER (WHERE a NOT IN (0, n)) AS partial_provenance,
  (SELECT count(*) FROM q WHERE n > 1) AS duplicate_requests, (SELECT count(*) FROM d WHERE n > 1) AS duplicate_attempts, (SELECT count(*) FROM p WHERE k > 1) AS provenance_drift, (SELECT count(bad) FROM t) AS invalid_rows FROM u"""
)
def trace_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.guard_counts(_full_traces(spark, sf_dir))


@query(f"SELECT coalesce({_VERDICT}, 'valid') AS verdict, count(*) AS n FROM {_FULL} GROUP BY 1")
def trace_row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full_traces(spark, sf_dir).groupBy(F.coalesce(traces.row_problem(), F.lit("valid")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_events, coalesce(spend, 0) AS spend FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM events GROUP BY user_id) ON user_id = c_custkey")
def trace_enrich_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast(MONEY)).cast("double").alias("spend")
    )
    found = traces.enrich(table(spark, sf_dir, "customer").select("c_custkey"), summary, "c_custkey")
    return found.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_events"), F.coalesce("spend", F.lit(0.0)).alias("spend"))


@query("SELECT event_type, epoch_us(max(ts)) AS watermark_us FROM events GROUP BY event_type")
def watermark_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = catalogs.watermarks(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts")
    return marks.select("event_type", F.unix_micros("watermark").alias("watermark_us"))


# Catalogs

_CATALOGS = """(SELECT 'n' || s_nationkey AS offering_id, 'balance' AS signal, CAST(max(s_acctbal) AS DECIMAL(18,2)) AS value, 'usd' AS unit FROM supplier GROUP BY 1
  UNION ALL SELECT 'n' || c_nationkey, 'balance', CAST(max(c_acctbal) AS DECIMAL(18,2)), 'usd' FROM customer GROUP BY 1
  UNION ALL SELECT 'n' || c_nationkey, 'customers', CAST(count(*) AS DECIMAL(18,2)), 'count' FROM customer GROUP BY 1)"""


def _catalogs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    name = lambda k: F.concat(F.lit("n"), F.col(k).cast("string")).alias("offering_id")
    shape = lambda df, signal, unit: df.select("offering_id", F.lit(signal).alias("signal"), F.col("value").cast(MONEY).alias("value"), F.lit(unit).alias("unit"))
    return [
        shape(s.groupBy(name("s_nationkey")).agg(F.max("s_acctbal").alias("value")), "balance", "usd"),
        shape(c.groupBy(name("c_nationkey")).agg(F.max("c_acctbal").alias("value")), "balance", "usd"),
        shape(c.groupBy(name("c_nationkey")).agg(F.count(F.lit(1)).alias("value")), "customers", "count"),
    ]


@query(f"SELECT offering_id, signal, count(*) AS sources, count(DISTINCT value) > 1 AS conflict, CAST(min(value) AS DOUBLE) AS value, min(unit) AS unit FROM {_CATALOGS} GROUP BY 1, 2")
def compose_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.compose(_catalogs(spark, sf_dir)).withColumn("value", F.col("value").cast("double"))


@query(
    """SELECT 'part-' || (p_partkey + 1) AS offering_id, 'sold' AS signal, CAST(q AS DOUBLE) AS value FROM part JOIN
  (SELECT l_partkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
  WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'part-' || p_partkey, 'price', p_retailprice FROM part"""
)
def enrich_cross_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("part-"), c.cast("string"))
    base = part.select(name(F.col("p_partkey")).alias("offering_id"), F.lit("price").alias("signal"), F.col("p_retailprice").alias("value"))
    sold = li.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("value")).select(
        name(F.col("l_partkey")).alias("offering_id"), F.lit("sold").alias("signal"), "value"
    )
    later = part.select((F.col("p_partkey") - 1).alias("p_partkey"))
    pairs = li.select(F.col("l_partkey").alias("p_partkey")).distinct().join(later, "p_partkey", "left_semi")
    mapping = pairs.select(name(F.col("p_partkey")).alias("source_id"), name(F.col("p_partkey") + 1).alias("target_id"))
    return catalogs.enrich_across(base, sold, mapping, ["sold"])


@query(
    """WITH e AS (SELECT doc_id AS row_id, source AS subject_sha256, n_chars > 0 AS valid FROM documents),
r AS (SELECT doc_id * 2 AS row_id, 'src' || ((doc_id * 2) % 20) AS subject_sha256, CASE WHEN toxic = 1 THEN 'mutable_alias' WHEN doc_id % 7 = 0 THEN 'unknown_route' ELSE 'reviewed' END AS status,
  CASE WHEN doc_id % 5 <> 0 THEN doc_id % 100000 - doc_id % 3 END AS offering_id, quality = 1 AS allowed FROM labels),
d AS (SELECT *, offering_id IS NOT NULL AND count(*) OVER (PARTITION BY offering_id) > 1 AS duplicate FROM r)
SELECT coalesce(e.row_id, d.row_id) AS row_id, CASE WHEN e.row_id IS NULL THEN 'missing_required_row' WHEN e.subject_sha256 <> d.subject_sha256 THEN 'identity_drift'
  WHEN NOT e.valid THEN 'invalid_result' WHEN d.status = 'mutable_alias' THEN 'mutable_alias' WHEN d.status = 'unknown_route' THEN 'unknown_route'
  WHEN d.row_id IS NULL OR d.offering_id IS NULL THEN 'unmapped' WHEN d.duplicate THEN 'duplicate_target' WHEN NOT d.allowed THEN 'license_blocked' ELSE 'mapped' END AS outcome,
  d.offering_id FROM e FULL OUTER JOIN d ON e.row_id = d.row_id"""
)
def reconcile_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("subject_sha256"), (F.col("n_chars") > 0).alias("valid"))
    k = F.col("doc_id")
    status = F.when(F.col("toxic") == 1, "mutable_alias").when(k % 7 == 0, "unknown_route").otherwise("reviewed")
    reviewed = table(spark, sf_dir, "labels").select(
        (k * 2).alias("row_id"), F.concat(F.lit("src"), (k * 2 % 20).cast("string")).alias("subject_sha256"), status.alias("status"),
        F.when(k % 5 != 0, k % 100000 - k % 3).alias("offering_id"), (F.col("quality") == 1).alias("allowed"),
    )
    return catalogs.reconcile(evidence, reviewed)


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) > 1 AS duplicate FROM orders")
def duplicate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.concat_ws("|", F.col("o_custkey").cast("string"), F.to_date("o_orderdate").cast("string"))
    return catalogs.with_duplicates(table(spark, sf_dir, "orders").withColumn("target", target), "target").select("o_orderkey", "duplicate")


@query(
    """WITH e AS (SELECT o_custkey AS candidate, o_orderpriority AS component, min(epoch_us(CAST(o_orderdate AS TIMESTAMP))) AS deadline FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY ALL),
p AS (SELECT candidate, count(*) AS measured, count(*) FILTER (WHERE component = '1-URGENT') AS required_measured, min(deadline) AS deadline FROM e GROUP BY candidate)
SELECT c_custkey AS candidate, coalesce(measured, 0) AS measured, coalesce(required_measured, 0) AS required_measured, deadline,
  coalesce(required_measured, 0) = 1 AND coalesce(measured, 0) >= 2 AS eligible FROM customer LEFT JOIN p ON candidate = c_custkey"""
)
def portfolio_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("candidate"), F.col("o_orderpriority").alias("component")).agg(
        F.min(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("deadline")
    )
    candidates = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate"))
    return catalogs.portfolio(rows, candidates, ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["1-URGENT"], 2)


@query(
    """WITH m AS (SELECT b.*, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_size DESC, p_partkey) AS rank FROM part b WHERE NOT EXISTS
  (SELECT 1 FROM part a WHERE a.p_type = b.p_type AND a.p_partkey <> b.p_partkey AND a.p_retailprice <= b.p_retailprice AND a.p_size >= b.p_size
  AND (a.p_retailprice < b.p_retailprice OR a.p_size > b.p_size)))
SELECT p_brand, min(rank) AS best_rank, count(*) AS members FROM m GROUP BY p_brand"""
)
def model_view_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = [Axis("p_retailprice", "min"), Axis("p_size", "max")]
    found = frontier.ranked(frontier.members(table(spark, sf_dir, "part"), "p_partkey", axes, within=["p_type"]), "p_partkey", axes, ["p_type"])
    return catalogs.best_available(found, "p_brand").withColumn("best_rank", F.col("best_rank").cast("long"))


@query(
    """WITH v AS (SELECT p_brand, p_type AS environment, CAST(max(p_size) AS DECIMAL(18,2)) AS value FROM part WHERE p_size > 5 GROUP BY ALL),
panel AS (SELECT b.p_brand, t.environment FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_type AS environment FROM part) t)
SELECT p_brand, count(*) AS environments, CASE WHEN count(value) = count(*) THEN round(CAST(sum(value) AS DOUBLE) / count(*), 6) END AS value
  FROM panel LEFT JOIN v USING (p_brand, environment) GROUP BY p_brand"""
)
def model_view_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    found = part.filter("p_size > 5").groupBy("p_brand", F.col("p_type").alias("environment")).agg(F.max("p_size").cast("double").alias("value"))
    # The panel is a policy: its brands and types are few by definition.
    panel = part.select("p_brand").distinct().crossJoin(part.select(F.col("p_type").alias("environment")).distinct())
    return catalogs.balanced(found, "p_brand", panel, ["value"]).withColumn("value", F.round("value", 6))


@query(
    """WITH y AS (SELECT year(l_shipdate) AS y, l_suppkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS cost, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quality FROM lineitem GROUP BY ALL),
m AS (SELECT b.* FROM y b WHERE y IN (1995, 1996) AND NOT EXISTS (SELECT 1 FROM y a WHERE a.y = b.y AND a.k <> b.k AND a.cost <= b.cost AND a.quality >= b.quality AND (a.cost < b.cost OR a.quality > b.quality))),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY cost, quality DESC, k) AS rank FROM m)
SELECT coalesce(p.k, c.k) AS offering_id, CASE WHEN p.k IS NULL THEN 'entered' WHEN c.k IS NULL THEN 'removed' WHEN p.rank <> c.rank THEN 'moved'
  WHEN p.cost <> c.cost OR p.quality <> c.quality THEN 'changed' ELSE 'same' END AS change, p.rank AS rank_before, c.rank AS rank_now
  FROM (SELECT * FROM r WHERE y = 1995) p FULL OUTER JOIN (SELECT * FROM r WHERE y = 1996) c ON p.k = c.k"""
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("y"), F.col("l_suppkey").alias("offering_id")).agg(
        F.sum(F.col("l_extendedprice").cast(MONEY)).alias("cost"), F.sum(F.col("l_quantity").cast(MONEY)).alias("quality")
    ).filter("y IN (1995, 1996)")
    found = frontier.ranked(frontier.members(rows, "offering_id", [COST, QUALITY], within=["y"]), "offering_id", [COST, QUALITY], ["y"])
    found = found.withColumn("rank", F.col("rank").cast("long"))
    return history.diff(found.filter("y = 1995"), found.filter("y = 1996"), "offering_id", ["cost", "quality"])


@query(
    """WITH m AS (SELECT o_orderstatus, date_trunc('month', o_orderdate) AS month, max(o_orderpriority) AS view FROM orders WHERE o_totalprice > 450000 GROUP BY ALL),
l AS (SELECT *, lag(view) OVER (PARTITION BY o_orderstatus ORDER BY month) AS before FROM m)
SELECT o_orderstatus, epoch_us(CAST(month AS TIMESTAMP)) AS month_us, view FROM l WHERE before IS NULL OR before <> view"""
)
def semantic_change_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").filter("o_totalprice > 450000").groupBy(
        "o_orderstatus", F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("month")
    ).agg(F.max("o_orderpriority").alias("view"))
    return history.meaningful(months, ["o_orderstatus"], "month", "view").select("o_orderstatus", F.unix_micros("month").alias("month_us"), "view")


@query(
    """SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS line, l_quantity AS size, l_returnflag = 'N' AS passed, attempts FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS attempts,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_returnflag = 'N') DESC, l_quantity DESC, l_shipdate DESC, l_orderkey * 8 + l_linenumber DESC) AS n FROM lineitem) WHERE n = 1"""
)
def capacity_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), F.col("l_quantity").alias("size"),
        (F.col("l_returnflag") == "N").alias("passed"), "l_shipdate",
    )
    return catalogs.arg_max_capacity(rows, "l_suppkey", "passed", "size", "l_shipdate", "line")


# Estimates

@query(
    """SELECT lang, CAST(sum(CAST(n_chars AS BIGINT) * (toxic - quality)) AS BIGINT) AS weighted_delta, CAST(sum(n_chars) AS BIGINT) AS weight,
  round(CAST(sum(n_chars * (toxic - quality)) AS DOUBLE) / CASE WHEN sum(n_chars) <> 0 THEN CAST(sum(n_chars) AS DOUBLE) END, 6) AS delta
  FROM labels JOIN documents USING (doc_id) GROUP BY lang"""
)
def paired_weighted_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    items = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return estimates.paired_delta(items, ["lang"], F.col("quality"), F.col("toxic"), F.col("n_chars"))


_Z = numeric.Z95
_WILSON = f"""round(CASE WHEN k = 0 THEN 0 ELSE 100 * (k / n + {_Z * _Z} / (2 * n) - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z * _Z} / (4 * n * n))) / (1 + {_Z * _Z} / n) END, 6) AS low,
  round(CASE WHEN k = n THEN 100 ELSE 100 * (k / n + {_Z * _Z} / (2 * n) + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z * _Z} / (4 * n * n))) / (1 + {_Z * _Z} / n) END, 6) AS high"""


@query(f"WITH g AS (SELECT toxic, CAST(sum(quality) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY toxic) SELECT toxic, {_WILSON} FROM g")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "labels").groupBy("toxic").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = numeric.wilson(F.col("k"), F.col("n"))
    return g.select("toxic", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    """WITH g AS (SELECT doc_id % 37 AS g, sum(quality) AS k, count(*) AS n FROM labels GROUP BY 1),
r AS (SELECT g, k, n, CAST(round(CAST(k AS DOUBLE) / n, 4) AS DECIMAL(18,4)) AS rate FROM g)
SELECT g, CAST(k AS BIGINT) AS k, CASE WHEN ceil((rate - 0.00005) * n) = floor((rate + 0.00005) * n) THEN CAST(ceil((rate - 0.00005) * n) AS BIGINT) END AS recovered FROM r"""
)
def success_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 37).alias("g")).agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    rate = F.round(F.col("k").cast("double") / F.col("n"), 4).cast("decimal(18,4)")
    return g.select("g", "k", numeric.recover_successes(rate, F.col("n")).cast("long").alias("recovered"))


@query(
    """SELECT lang, round(100.0 * CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE quality = 1), 0), 6) AS clean_of_good,
  round(100.0 * CAST(count(*) FILTER (WHERE toxic = 1 AND n_chars > 1000) AS DOUBLE) / nullif(count(*) FILTER (WHERE toxic = 1), 0), 6) AS long_of_toxic
  FROM labels JOIN documents USING (doc_id) GROUP BY lang"""
)
def conditional_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return estimates.conditional_ratios(rows, ["lang"], {"clean_of_good": (~toxic, good), "long_of_toxic": (F.col("n_chars") > 1000, toxic)})


@query(
    """WITH p AS (SELECT user_id, event_type <> 'error' AND value > 10 AS on_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM p WHERE on_)
SELECT user_id, min(i) AS run_start, max(i) AS run_end, count(*) AS run_length FROM g GROUP BY user_id, k"""
)
def pause_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return estimates.islands(events, ["user_id"], ["ts", "event_id"], (F.col("event_type") != "error") & (F.col("value") > 10))


_POISSON = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759, 0.999989751)


@query(
    f"""WITH u AS (SELECT toxic, quality, d.draw, (CAST('0x' || substr(md5('7:' || d.draw || ':' || doc_id), 1, 8) AS BIGINT) % {1 << 30}) / {1 << 30}.0 AS u FROM labels, range(200) d(draw)),
t AS (SELECT toxic, draw, quality, {' + '.join(f'CASE WHEN u >= {p} THEN 1 ELSE 0 END' for p in _POISSON)} AS times FROM u),
s AS (SELECT toxic, draw, CAST(sum(quality * times) AS DOUBLE) / nullif(sum(times), 0) AS rate FROM t GROUP BY ALL)
SELECT toxic, round(quantile_cont(rate, 0.025), 9) AS low, round(quantile_cont(rate, 0.975), 9) AS high, count(*) AS draws FROM s GROUP BY toxic"""
)
def bootstrap_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("one", F.lit(1))
    found = estimates.bootstrap(rows, ["toxic"], ["quality", "one"], "doc_id", draws=200, seed=7)
    rate = F.try_divide(F.col("quality").cast("double"), F.col("one").cast("double"))
    return found.groupBy("toxic").agg(F.round(F.percentile(rate, 0.025), 9).alias("low"), F.round(F.percentile(rate, 0.975), 9).alias("high"), F.count(F.lit(1)).alias("draws"))


# Formulas and functions

_FORMULA = "signals.price * (1 - signals.discount) * (1 + signals.tax) / max(signals.quantity, workload.unit)"


@query(
    """SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax) / greatest(l_quantity, 1.0)), 2) AS cost
  FROM lineitem GROUP BY l_suppkey"""
)
def formula_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {"signals.price": "l_extendedprice", "signals.discount": "l_discount", "signals.tax": "l_tax", "signals.quantity": "l_quantity"}
    lookup = lambda p: F.lit(1.0) if p == "workload.unit" else F.col(paths[p])
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(formula.approximate(_FORMULA, lookup)), 2).alias("cost"))


#: Fixed-point text of a number of at most 12 places.
PLAIN = "rtrim(rtrim(CAST(CAST({} AS DECIMAL(38,12)) AS VARCHAR), '0'), '.')"
_CENTS = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS HUGEINT)"


def _digits34(numerator: str, denominator: str) -> str:
    """SQL text of the 34 digits, half to even, of a quotient of whole numbers that is at least 1."""
    return f"""(SELECT rtrim(rtrim(substr(CAST(q AS VARCHAR), 1, d) || '.' || substr(CAST(q AS VARCHAR), d + 1), '0'), '.') FROM (
    SELECT d, whole + CASE WHEN 2 * rest > den OR (2 * rest = den AND whole % 2 = 1) THEN 1 ELSE 0 END AS q FROM (
    SELECT d, den, num // den AS whole, num % den AS rest FROM (
    SELECT length(CAST(a // b AS VARCHAR)) AS d, b AS den, a * CAST('1' || repeat('0', CAST(34 - length(CAST(a // b AS VARCHAR)) AS INT)) AS HUGEINT) AS num FROM (
    SELECT {numerator} AS a, CAST({denominator} AS HUGEINT) AS b)))))"""


@query(
    f"""SELECT o_orderkey, {PLAIN.format("greatest(1000, least(CAST(o_totalprice AS DECIMAL(18,2)), 300000))")} AS clamped, round(sqrt(o_totalprice), 6) AS root,
  {PLAIN.format("CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END")} AS chosen,
  CAST((CAST(o_orderkey AS HUGEINT) + 9007199254740993) * (o_custkey % 10) * (o_custkey % 10) AS VARCHAR) AS large,
  {_digits34(f"{_CENTS} + 100 * o_custkey + 200", "300")} AS mean_of_three, round(ln(o_totalprice), 6) AS logged,
  CASE WHEN o_custkey % 4 <> 0 THEN {_digits34(_CENTS, "100 * greatest(o_custkey % 4, 1)")} END AS divided,
  {PLAIN.format("CAST(o_totalprice AS DECIMAL(18,2)) % 7")} AS remainder FROM orders"""
)
def formula_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {"signals.total": F.col("o_totalprice").cast(MONEY), "signals.customer": F.col("o_custkey"), "signals.order": F.col("o_orderkey"), "metadata.gap": F.lit(None)}
    f = lambda t: formula.exact(t, paths.__getitem__)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        f("clamp(signals.total, 1000, 300000)").alias("clamped"),
        F.round(f("sqrt(signals.total)").cast("double"), 6).alias("root"),
        f("if(signals.customer % 3 == 0, 1, coalesce(metadata.gap, signals.total))").alias("chosen"),
        f("(signals.order + 9007199254740993) * (signals.customer % 10)^2").alias("large"),
        f("mean(signals.total, signals.customer, 2)").alias("mean_of_three"),
        F.round(f("log(signals.total)").cast("double"), 6).alias("logged"),
        f("signals.total / (signals.customer % 4)").alias("divided"),
        f("signals.total % 7").alias("remainder"),
    )


@query(
    """WITH b AS (SELECT o_orderkey // 2 AS k, CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN o_custkey % 5 = 0 THEN 'included' WHEN o_custkey % 5 = 1 AND o_orderpriority LIKE '1%' THEN 'estimated'
    WHEN o_custkey % 5 = 2 AND o_orderpriority LIKE '2%' THEN 'included' ELSE 'provider_reported' END AS basis, o_custkey % 7 <> 0 AS priced FROM orders),
g AS (SELECT k, list_sort(list(DISTINCT basis)) AS seen, bool_and(priced) AS priced FROM b GROUP BY k)
SELECT k AS pair, CASE WHEN list_contains(seen, 'unknown') OR NOT priced THEN 'unknown' WHEN seen = ['included'] THEN 'included' WHEN seen = ['provider_reported'] THEN 'provider_reported'
  WHEN NOT list_contains(seen, 'included') THEN 'estimated' ELSE 'unknown' END AS basis FROM g"""
)
def cost_basis_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = F.col("o_orderpriority"), F.col("o_custkey")
    basis = (
        F.when(F.col("o_orderstatus") == "P", "unknown").when(k % 5 == 0, "included").when((k % 5 == 1) & p.startswith("1"), "estimated")
        .when((k % 5 == 2) & p.startswith("2"), "included").otherwise("provider_reported")
    )
    amount = F.when(k % 7 != 0, F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 2).cast("long").alias("pair")).agg(catalogs.combined_basis(basis, amount).alias("basis"))


@query(
    """SELECT DISTINCT s.s_suppkey, t.p_type FROM supplier s CROSS JOIN (SELECT DISTINCT p_type FROM part) t
WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s.s_suppkey AND p_type = t.p_type AND l_returnflag = 'N' AND p_size > 40 AND l_quantity > 45)"""
)
def set_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    # Required cells: every supplier by the few types of the policy.
    required = table(spark, sf_dir, "supplier").select("s_suppkey").crossJoin(part.select("p_type").distinct())
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N' AND l_quantity > 45")
    done = li.join(part.filter("p_size > 40"), li.l_partkey == part.p_partkey).select(F.col("l_suppkey").alias("s_suppkey"), "p_type")
    return catalogs.missing_coverage(required, done, ["s_suppkey", "p_type"])


@query(
    """SELECT p_partkey, CASE WHEN p_size % 6 < 5 THEN '''' || t ELSE t END AS cell, sha256(length(p_name) || ':' || p_name || ',' || length(p_brand) || ':' || p_brand) AS digest,
  rtrim(rtrim(CAST(CAST(p_retailprice AS DECIMAL(18,4)) AS VARCHAR), '0'), '.') AS price
  FROM (SELECT *, CASE p_size % 6 WHEN 0 THEN '=' || p_name WHEN 1 THEN ' +' || p_name WHEN 2 THEN '@' || p_name WHEN 3 THEN '-' || p_name WHEN 4 THEN chr(9) || '=' || p_name ELSE p_name END AS t FROM part)"""
)
def safe_cells_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 6
    sign = F.when(k == 0, "=").when(k == 1, " +").when(k == 2, "@").when(k == 3, "-").when(k == 4, "\t=").otherwise("")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.spreadsheet_safe(F.concat(sign, "p_name")).alias("cell"),
        text.content_hash([F.col("p_name"), F.col("p_brand")]).alias("digest"),
        text.canonical_number(F.col("p_retailprice").cast("decimal(18,4)")).alias("price"),
    )


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type")
def json_props_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k BIGINT").getField("k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("most"))


@query("SELECT url, CAST(page_id AS BIGINT) AS page_id, regexp_matches(url, '^https://[^/?#@\\s]+(/[^?#\\s]*)?$') AS is_public FROM pages")
def public_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", "page_id", text.is_public_url(F.col("url")).alias("is_public"))


@query("SELECT l_orderkey % 100 AS g, round(median(CAST(l_quantity AS DOUBLE)), 6) AS middle FROM lineitem GROUP BY 1")
def sample_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A hundred groups, each of bounded share; the exact order statistic comes from a window.
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("g"), F.col("l_quantity"))
    return numeric.quantile_type7(rows, ["g"], "l_quantity", {"middle": "0.5"}).select("g", F.round(F.col("middle").cast("double"), 6).alias("middle"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def last_writer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


# Imports

@query(
    """WITH s AS (SELECT l_suppkey AS alias, l_returnflag AS section, count(*) AS tasks, count(*) FILTER (WHERE l_discount > 0.05) AS successes, sum(CAST(l_tax AS DECIMAL(18,2))) AS cost FROM lineitem GROUP BY ALL),
o AS (SELECT l_suppkey AS alias, count(*) AS tasks, count(*) FILTER (WHERE l_discount > 0.05) + CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END AS successes, sum(CAST(l_tax AS DECIMAL(18,2))) AS cost FROM lineitem GROUP BY l_suppkey),
p AS (SELECT alias, sum(tasks) AS tasks, sum(successes) AS successes, sum(cost) AS cost FROM s GROUP BY alias)
SELECT alias FROM o JOIN p USING (alias) WHERE o.tasks <> p.tasks OR o.successes <> p.successes OR abs(o.cost - p.cost) > 0.00005"""
)
def import_section_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    sums = [F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("l_discount") > 0.05).alias("successes"), F.sum(F.col("l_tax").cast(MONEY)).alias("cost")]
    alias = F.col("l_suppkey").alias("alias")
    parts = li.groupBy(F.col("l_returnflag").alias("section"), alias).agg(*sums)
    wrong = F.when(F.col("alias") % 9 == 0, 1).otherwise(0)
    overall = li.groupBy(alias).agg(*sums).select(F.lit("overall").alias("section"), "alias", "tasks", (F.col("successes") + wrong).alias("successes"), "cost")
    return imports.section_totals(parts.unionByName(overall))


@query(
    """WITH t AS (SELECT o_custkey AS name, count(DISTINCT o_orderkey) AS tasks, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s, count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS known, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT name, round(CAST(s AS DOUBLE) / 10, 4) AS average, tasks = 10 AS complete, CASE WHEN known = n THEN CAST(s AS DOUBLE) END AS total_cost FROM t"""
)
def import_task_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast(MONEY)
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("name"), F.lit(0.0).alias("reported"), F.col("o_orderkey").alias("task"), price.alias("score"),
        F.when(F.col("o_orderstatus") != "P", price).alias("cost"),
    )
    found = imports.task_averages(rows, 10)
    return found.select("name", F.round("average", 4).alias("average"), "complete", F.col("total_cost").cast("double").alias("total_cost"))


@query(
    """SELECT lang AS run, count(*) AS n, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 6) AS accuracy,
  round(100.0 * count(*) FILTER (WHERE n_chars > 500) / count(*), 6) AS coverage,
  round(100.0 * count(*) FILTER (WHERE quality = 1 AND n_chars > 500) / nullif(count(*) FILTER (WHERE n_chars > 500), 0), 6) AS autonomous_accuracy,
  round(100.0 * count(*) FILTER (WHERE quality = 1 AND toxic = 1 AND n_chars % 2 = 0) / nullif(count(*) FILTER (WHERE toxic = 1 AND n_chars % 2 = 0), 0), 6) AS rescue,
  round(100.0 * count(*) FILTER (WHERE quality <> 1 AND toxic = 1 AND n_chars % 2 = 1) / nullif(count(*) FILTER (WHERE toxic = 1 AND n_chars % 2 = 1), 0), 6) AS override_harm,
  round(median(CAST(n_chars AS DOUBLE)), 6) AS p50 FROM labels JOIN documents USING (doc_id) GROUP BY lang"""
)
def import_decision_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("lang").alias("run"), F.col("doc_id").alias("case"), (F.col("quality") == 1).alias("correct"), (n > 500).alias("answered"),
        (F.col("toxic") == 1).alias("overridden"), (n % 2 == 1).alias("base_correct"), n.alias("latency_ms"),
    )
    shares = ("accuracy", "coverage", "autonomous_accuracy", "rescue", "override_harm")
    return imports.decision_signals(rows).select("run", "n", *[F.round(c, 6).alias(c) for c in shares], F.round(F.col("p50").cast("double"), 6).alias("p50"))


@query(
    """SELECT c_custkey AS offering_id, CASE WHEN s_acctbal IS NULL THEN 'price_missing' WHEN s_acctbal < 0 THEN 'tiered_price' END AS reason
  FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey"""
)
def import_price_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    mapping = c.select(F.col("c_custkey").alias("offering_id"), F.lit("p").alias("provider_id"), F.col("c_custkey").alias("model_id"))
    tiers = F.when(F.col("s_acctbal") < 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>"))
    prices = s.select(F.lit("p").alias("provider_id"), F.col("s_suppkey").alias("model_id"), F.col("s_acctbal").alias("input"), F.col("s_acctbal").alias("output"), tiers.alias("tiers"))
    return imports.with_prices(c.select(F.col("c_custkey").alias("offering_id")), mapping, prices).select("offering_id", "reason")


@query(
    """WITH l AS (SELECT l_orderkey AS session_id, count(DISTINCT l_returnflag) AS routes, sum(CAST(l_quantity AS BIGINT)) AS q, sum(l_linenumber) AS n,
  bool_or(l_returnflag = 'R') AS unknown, bool_or(l_returnflag = 'A') AS estimated FROM lineitem GROUP BY 1)
SELECT o_orderkey AS session_id, CASE WHEN routes IS NOT NULL THEN CASE WHEN unknown OR (estimated AND routes > 1) THEN 'unknown' WHEN estimated THEN 'estimated' ELSE 'included' END END AS basis,
  CASE WHEN routes IS NULL THEN 'no_ledger' WHEN routes > 1 THEN 'several_routes' ELSE '' END AS first_reason, CAST(n AS BIGINT) AS lines
  FROM orders LEFT JOIN l ON session_id = o_orderkey"""
)
def import_ledger_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    ledger = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), flag.alias("route"), F.col("l_quantity").cast("bigint").alias("input_tokens"),
        F.col("l_linenumber").cast("bigint").alias("output_tokens"), F.lit(1.0).alias("cost"),
        F.when(flag == "R", "unknown").when(flag == "A", "estimated").otherwise("included").alias("basis"),
    )
    totals = ledger.groupBy("session_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id")).join(totals, "session_id", "left")
    found = imports.ledger_sessions(sessions, ledger)
    first = F.when(F.array_contains("reasons", "no_ledger"), "no_ledger").otherwise(F.coalesce(F.get("reasons", F.lit(0)), F.lit("")))
    return found.join(sessions.select("session_id", F.col("output_tokens").alias("lines")), "session_id").select("session_id", "basis", first.alias("first_reason"), "lines")


@query(
    """WITH k AS (SELECT conv_id, string_agg(CASE WHEN turn = 0 THEN 't' WHEN turn = 1 THEN 'u' WHEN role = 'assistant' AND turn = m THEN 'c' WHEN turn = m THEN 'f' ELSE 'i' END, '' ORDER BY turn) AS kinds
  FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY conv_id)
SELECT conv_id, CASE WHEN regexp_full_match(kinds, 'tui*c') THEN 'complete' WHEN regexp_full_match(kinds, 'tui*f') THEN 'failed'
  WHEN regexp_full_match(kinds, 'tui*') THEN 'turn' WHEN kinds = 't' THEN 'thread' ELSE 'invalid' END AS state FROM k"""
)
def import_turn_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("m"))
    kind = (
        F.when(F.col("turn") == 0, "thread.started").when(F.col("turn") == 1, "turn.started")
        .when((F.col("role") == "assistant") & (F.col("turn") == F.col("m")), "turn.completed").when(F.col("turn") == F.col("m"), "turn.failed").otherwise("item.x")
    )
    usage = F.struct(*[F.lit(0).alias(c) for c in ("input", "cached", "cache_write", "output", "reasoning")])
    events = rows.join(last, "conv_id").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), kind.alias("type"), usage.alias("usage"))
    return imports.turn_states(events).select(F.col("file").alias("conv_id"), "state")


@query(
    """WITH p AS (SELECT c_nationkey AS row_id, max(c_mktsegment) AS subject, max(c_acctbal) > 9000 AS result, count(*) AS raw FROM customer GROUP BY 1),
c AS (SELECT s_nationkey AS row_id, CASE WHEN s_nationkey % 3 = 0 THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS subject, max(s_acctbal) > 9000 AS result, count(*) AS raw FROM supplier GROUP BY ALL)
SELECT coalesce(p.row_id, c.row_id) AS row_id, CASE WHEN p.row_id IS NULL THEN 'added' WHEN c.row_id IS NULL THEN 'removed' WHEN p.subject <> c.subject THEN 'subject'
  WHEN p.result <> c.result THEN 'result' ELSE 'raw_only' END AS change FROM p FULL OUTER JOIN c ON p.row_id = c.row_id
  WHERE p.row_id IS NULL OR c.row_id IS NULL OR p.subject <> c.subject OR p.result <> c.result OR p.raw <> c.raw"""
)
def feed_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("row_id")).agg(
        F.max("c_mktsegment").alias("subject"), (F.max("c_acctbal") > 9000).alias("result"), F.count(F.lit(1)).alias("raw")
    )
    c = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("row_id")).agg((F.max("s_acctbal") > 9000).alias("result"), F.count(F.lit(1)).alias("raw"))
    return imports.feed_change(p, c.withColumn("subject", F.when(F.col("row_id") % 3 == 0, "MACHINERY").otherwise("HOUSEHOLD")))


@query("SELECT 'off-' || (user_id % 16) AS offering_id, count(DISTINCT user_id || ':' || CAST(ts AS DATE)) AS requests, count(*) AS rows_in FROM events GROUP BY 1")
def streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's requests of one day are one request, repeated within the watermark's delay."""
    # A folder is a stream's source; the file is picked by name.
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    offering = F.concat(F.lit("off-"), F.pmod("user_id", F.lit(16)).cast("string")).alias("offering_id")
    day = F.col("ts").cast("timestamp").cast("date").cast("timestamp")
    rows = events.select(offering, F.concat_ws(":", F.col("user_id").cast("string"), day.cast("string")).alias("request_id"), day.alias("timestamp"))
    kept = run.drained(streams.deduplicated(rows, "1 day"), "streaming-dedup")
    before = table(spark, sf_dir, "events").groupBy(offering).agg(F.count(F.lit(1)).alias("rows_in"))
    return kept.groupBy("offering_id").agg(F.count(F.lit(1)).alias("requests")).join(before, "offering_id")


_STEP = """SELECT k, moment, digest, CASE WHEN moment < (SELECT kept FROM kept x WHERE x.k = b.k) THEN 'rolled_back' WHEN moment = (SELECT kept FROM kept x WHERE x.k = b.k)
  THEN CASE WHEN digest = (SELECT held FROM kept x WHERE x.k = b.k) THEN 'repeated' ELSE 'equivocal' END WHEN i = 1 THEN 'accepted' WHEN digest = least_digest THEN 'repeated' ELSE 'equivocal' END AS verdict FROM b"""


@query(
    f"""WITH u AS (SELECT o_custkey AS k, date_trunc('quarter', o_orderdate) AS moment, o_orderpriority AS digest, o_orderkey % 3 = 0 AS late FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY k, moment, late ORDER BY digest) AS i, min(digest) OVER (PARTITION BY k, moment, late) AS least_digest FROM u),
kept AS (SELECT k, max(moment) AS kept, arg_max(least_digest, moment) AS held FROM n WHERE NOT late GROUP BY k), b AS (SELECT * FROM n WHERE late),
v AS (SELECT k, moment, digest, CASE WHEN i = 1 THEN 'accepted' WHEN digest = least_digest THEN 'repeated' ELSE 'equivocal' END AS verdict FROM n WHERE NOT late UNION ALL {_STEP})
SELECT CAST(k AS VARCHAR) AS customer, verdict, count(*) AS updates, max(moment) AS newest, min(digest) AS least_content FROM v GROUP BY ALL"""
)
def monotonic_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as updates of their customers; every third one arrives in a second micro-batch, late or not."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").cast("string").alias("customer"), F.date_trunc("quarter", "o_orderdate").cast("timestamp").alias("at"), F.col("o_orderpriority").alias("content"), "o_orderkey")
    late = F.col("o_orderkey") % 3 == 0
    told = run.drained_in_steps([rows.filter(~late), rows.filter(late)], lambda s: monotonic.followed(s, "customer", "at", "content"), "monotonic-updates")
    return told.groupBy("customer", "verdict").agg(F.count(F.lit(1)).alias("updates"), F.max("at").alias("newest"), F.min("content").alias("least_content"))


@query(
    """WITH h AS (SELECT DISTINCT o_custkey AS model, o_orderpriority AS env FROM orders), r AS (SELECT DISTINCT o_orderstatus AS policy, o_orderpriority AS env FROM orders
  WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority < '4') OR (o_orderstatus = 'P' AND o_orderpriority >= '3')),
s AS (SELECT model, list_sort(list(env)) AS held FROM h GROUP BY model), p AS (SELECT policy, list_sort(list(env)) AS required FROM r GROUP BY policy)
SELECT policy, model, len(held) AS held, len(required) AS required, len(list_intersect(held, required)) AS shared,
  CASE WHEN held = required THEN 'exact' WHEN list_has_all(required, held) THEN 'too_few' WHEN list_has_all(held, required) THEN 'too_many' ELSE 'different' END AS verdict
FROM s, p WHERE len(list_intersect(held, required)) > 0"""
)
def exact_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as models that ran in the priorities of their orders, held against three policies."""
    orders = table(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = orders.select(F.col("o_custkey").alias("model"), priority.alias("env"))
    asked = (status == "F") | ((status == "O") & (priority < "4")) | ((status == "P") & (priority >= "3"))
    return catalogs.exact_environments(rows, orders.filter(asked).select(status.alias("policy"), priority.alias("env")), "model", "env", "policy")

"""The shared tables in the roles that the queries give them: offerings and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as offerings: cost (sum and range of prices), quality (sum and range of quantities)."""
    price, quantity = F.col("l_extendedprice").cast(MONEY), F.col("l_quantity").cast(MONEY)
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("offering_id")).agg(
        F.sum(price).alias("cost"), F.min(price).alias("cost_low"), F.max(price).alias("cost_high"),
        F.sum(quantity).alias("quality"), F.min(quantity).alias("quality_low"), F.max(quantity).alias("quality_high"),
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("l_returnflag") == "N").alias("kept"),
    )
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    places = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return sums.join(places, sums.offering_id == F.col("s_suppkey")).select(
        *sums.columns, F.col("n_name").alias("provider"), F.col("r_name").alias("region"), F.col("s_acctbal").cast(MONEY).alias("balance")
    )


OFFERINGS = """(SELECT l_suppkey AS offering_id, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS cost,
  min(CAST(l_extendedprice AS DECIMAL(18,2))) AS cost_low, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS cost_high,
  sum(CAST(l_quantity AS DECIMAL(18,2))) AS quality, min(CAST(l_quantity AS DECIMAL(18,2))) AS quality_low,
  max(CAST(l_quantity AS DECIMAL(18,2))) AS quality_high, count(*) AS samples,
  count(*) FILTER (WHERE l_returnflag = 'N') AS kept, any_value(n_name) AS provider, any_value(r_name) AS region,
  any_value(CAST(s_acctbal AS DECIMAL(18,2))) AS balance
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY l_suppkey)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request traces: 16 offerings, a work unit per user and day, an attempt per hour."""
    day, hour = F.dayofmonth("ts"), F.hour("ts")
    unit = F.concat_ws(":", F.col("user_id").cast("string"), day.cast("string"))
    return table(spark, sf_dir, "events").select(
        F.lit("w").alias("workload_id"),
        F.lit("1").alias("workload_version"),
        F.concat(F.lit("off-"), F.pmod("user_id", F.lit(16)).cast("string")).alias("offering_id"),
        unit.alias("work_unit_id"),
        F.col("event_id").cast("string").alias("request_id"),
        F.concat_ws(":", unit, hour.cast("string")).alias("attempt_id"),
        F.when(F.col("event_type") == "view", "model_call").otherwise("request").alias("observation_unit"),
        F.when(F.col("event_type") == "view", F.lit(2)).cast("long").alias("model_request_count"),
        F.lit(None).cast("long").alias("attempt_count"),
        F.when(F.pmod(F.col("user_id") + day, F.lit(3)) != 0, 1).otherwise(0).cast("decimal(18,9)").alias("work_unit_success"),
        F.when(F.col("event_type") != "error", F.col("value").cast(MONEY)).alias("meter"),
        F.col("value").cast(MONEY).alias("spend"),
        F.when(F.col("event_type") == "click", F.col("value").cast("decimal(18,9)")).alias("ttft_ms"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("event_type"),
    )


TRACES = """(SELECT 'w' AS workload_id, '1' AS workload_version, 'off-' || (user_id % 16) AS offering_id,
  user_id || ':' || day(ts) AS work_unit_id, CAST(event_id AS VARCHAR) AS request_id,
  user_id || ':' || day(ts) || ':' || hour(ts) AS attempt_id,
  CASE WHEN event_type = 'view' THEN 'model_call' ELSE 'request' END AS observation_unit,
  CASE WHEN event_type = 'view' THEN 2 END AS model_request_count,
  CASE WHEN (user_id + day(ts)) % 3 <> 0 THEN 1 ELSE 0 END AS work_unit_success,
  CASE WHEN event_type <> 'error' THEN CAST(value AS DECIMAL(18,2)) END AS meter, CAST(value AS DECIMAL(18,2)) AS spend,
  CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,9)) END AS ttft_ms, ts AS timestamp, event_type FROM events)"""

"""Sources: catalogs, traces, evidence and measurements from JSON, JSON Lines, Parquet, XML and CSV.

Every reader passes an explicit schema and fails on rows that do not fit; numbers that must be
exact are read as text and cast to decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.traces import LATENCIES, METERS, SCHEMA, COSTS, TraceError

# The nested shapes of the catalog format. Decimals arrive as text.
SOURCE = "struct<id:string,version:string,url:string,terms_url:string,license:string,methodology:string,raw_sha256:string,retrieved_at:timestamp>"
OBSERVATION = f"struct<value:string,unit:string,evidence_tier:string,lower:string,upper:string,sample_count:bigint,observed_at:timestamp,source:{SOURCE}>"
OFFERING_KEY = "struct<offering_id:string,model_id:string,provider:string,endpoint:string,billing_mode:string,region:string,service_tier:string,quantization:string,reasoning_effort:string,agent_harness:string,capabilities:array<string>>"
CATALOG = (
    "schema_version string, workload struct<id:string,version:string,unit:string>, "
    f"offerings array<struct<offering:{OFFERING_KEY},signals:map<string,{OBSERVATION}>,metadata:map<string,string>,default_source:{SOURCE}>>"
)
EXACT = "decimal(38,12)"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Long table of an observation catalog: one row per (offering, signal).

    A signal without a source takes its offering's default source.
    """
    raw = spark.read.schema(CATALOG).json(path, multiLine=True, mode="FAILFAST")
    items = raw.select("workload", F.explode("offerings").alias("o"))
    rows = items.select("workload", "o.offering", "o.metadata", "o.default_source", F.explode("o.signals").alias("signal", "s"))
    return rows.select(
        F.col("workload.id").alias("workload_id"),
        F.col("workload.version").alias("workload_version"),
        F.col("workload.unit").alias("workload_unit"),
        "offering.*",
        "metadata",
        "signal",
        *[F.col(f"s.{c}").cast(EXACT).alias(c) for c in ("value", "lower", "upper")],
        "s.unit",
        "s.evidence_tier",
        "s.sample_count",
        "s.observed_at",
        F.coalesce("s.source", "default_source").alias("source"),
    )


def source_conflicts(catalog: DataFrame) -> DataFrame:
    """Source ids that appear with different descriptors."""
    return catalog.filter("source IS NOT NULL").groupBy(F.col("source.id").alias("source_id")).agg(
        F.count_distinct(F.to_json("source")).alias("descriptors")
    ).filter("descriptors > 1")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Canonical traces from a Parquet or JSON Lines path, by suffix.

    Parquet: unknown columns, floating-point meters and timestamps without a zone are refused.
    """
    if not path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(SCHEMA).json(path, mode="FAILFAST")
    raw = spark.read.parquet(path)
    known = {f.name: f.dataType for f in SCHEMA.fields}
    for f in raw.schema.fields:
        if f.name not in known:
            raise TraceError("unknown column")
        if f.name in (*METERS, *COSTS, *LATENCIES) and isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            raise TraceError("floating-point meter")
        if f.name == "timestamp" and not isinstance(f.dataType, T.TimestampType):
            raise TraceError("timestamp without a zone")
    own = set(raw.columns)
    return raw.select(*[(F.col(n) if n in own else F.lit(None)).cast(t).alias(n) for n, t in known.items()])


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of an RSS (item) or Atom (entry) file, with a hashed id."""
    fields = "title string, link string, guid string, id string, pubDate string, updated string"
    rows = spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST").schema(fields).load(path)
    name = F.coalesce("guid", "id", "link", "title")
    return rows.select(F.concat(F.lit("feed:"), F.substring(F.sha2(name, 256), 1, 16)).alias("offering_id"), "title", "link", F.coalesce("pubDate", "updated").alias("published"))


def read_model_list(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Offerings of a JSON model list ({"data": [{id, context_length, pricing}]}), as facts."""
    schema = "data array<struct<id:string,context_length:bigint,pricing:struct<prompt:string,completion:string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST").select(F.explode("data").alias("m"))
    rows = rows.filter(F.col("m.id").rlike(pattern)) if pattern else rows
    price = lambda c: F.col(f"m.pricing.{c}").try_cast("decimal(38,18)").alias(f"{c}_price")
    return rows.select(F.col("m.id").alias("offering_id"), F.col("m.context_length").alias("context_length"), price("prompt"), price("completion"))


def read_context_bench(spark: SparkSession, path: str, context_tokens: int | None = None) -> DataFrame:
    """The row of the largest context of a context benchmark CSV, or that of one context."""
    schema = "ctx_tokens bigint, prefill_tokens bigint, prefill_tps double, gen_tokens bigint, gen_tps double, gen_first_ms double, gen_steady_tokens bigint, gen_steady_tps double, kvcache_bytes bigint"
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    if context_tokens is not None:
        return rows.filter(F.col("ctx_tokens") == context_tokens)
    return rows.agg(F.max_by(F.struct("*"), "ctx_tokens").alias("r")).select("r.*")


def read_speed_text(spark: SparkSession, path: str) -> DataFrame:
    """Tokens per second from text logs with ``Prompt: n tokens, x tokens-per-sec`` lines."""
    pattern = r"(Prompt|Generation): ([0-9]+) tokens, ([0-9.]+) tokens-per-sec"
    rows = spark.read.text(path).filter(F.col("value").rlike(pattern))
    part = lambda k, kind: F.regexp_extract("value", pattern, k).cast(kind)
    return rows.select(F.lower(part(1, "string")).alias("phase"), part(2, "bigint").alias("tokens"), part(3, "double").alias("tokens_per_second"))

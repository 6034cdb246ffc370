"""Structured Streaming over traces: duplicates out, windows of totals, monotonic selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of (offering_id, request_id) that arrive within the watermark's delay.

    State is bounded by the delay; a batch run over the whole table finds later repeats.
    """
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["offering_id", "request_id"])


def windowed_totals(stream: DataFrame, width: str = "1 day", delay: str = "1 hour", meter: str = "spend") -> DataFrame:
    """Per offering and event-time window: rows and total; late rows beyond the delay are dropped."""
    return (
        stream.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", width), "offering_id")
        .agg(F.count(F.lit(1)).alias("requests"), F.sum(meter).alias(meter))
        .select("offering_id", F.col("window.start").alias("window_start"), "requests", meter)
    )


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Work sessions of an offering: runs of requests without a gap."""
    return (
        stream.withWatermark("timestamp", delay)
        .groupBy(F.session_window("timestamp", gap), "offering_id")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("offering_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "requests")
    )


def newest(updates: DataFrame, key: str = "selection_id", at: str = "generated_at", content: str = "digest") -> DataFrame:
    """The newest generation per key, and whether two contents claim the same time (equivocation).

    Older generations never replace newer ones. Works on a batch or as a running aggregation.
    """
    top = F.max(F.struct(at, content)).alias("top")
    per_time = updates.groupBy(key, at).agg(F.min(content).alias(content), F.max(content).alias("_other"))
    return per_time.groupBy(key).agg(
        top, F.max_by(F.col("_other") != F.col(content), at).alias("equivocated")
    ).select(key, f"top.{at}", f"top.{content}", "equivocated")

"""Session settings that the package's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "paretoflow", **more: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC and adaptive execution; ``more`` overrides."""
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | more
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

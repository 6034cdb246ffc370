"""Tables written between the steps of an operator, in the folder that a cluster's executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="paretoflow-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table of their own: nothing before it is computed again, whatever executors are lost."""
    spark = df.sparkSession
    name = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(name)
    path, files = _path(spark, name)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(name)
    out._written_to = name
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that no later job reads."""
    for table in tables:
        path, files = _path(table.sparkSession, table._written_to)
        files.delete(path, True)

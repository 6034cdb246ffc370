"""Run a stream over what is there now and hand its result on as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.written import shared_folder


def drained(stream: DataFrame, label: str) -> DataFrame:
    """All rows that the stream emits for its present input, in append mode.

    Output and progress lie in the folder that the cluster shares (``spark.checkpoint.dir``), until
    the application ends; only on a local master that names none, as in tests, in a temporary one.
    """
    root = f"{shared_folder(stream.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _drain(stream, root)
    return _emitted(stream, root)


def drained_in_steps(steps: Sequence[DataFrame], follow: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """All rows that ``follow`` emits when the rows of ``steps`` arrive one after another, each as one micro-batch.

    State and progress are those of one query that is stopped and started again between the steps.
    """
    spark = steps[0].sparkSession
    root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for step in steps:
        step.write.mode("append").parquet(f"{root}/source")
        stream = follow(spark.readStream.schema(steps[0].schema).parquet(f"{root}/source"))
        _drain(stream, root)
    return _emitted(stream, root)


def _drain(stream: DataFrame, root: str) -> None:
    started = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    started.option("checkpointLocation", f"{root}/progress").start(f"{root}/rows").awaitTermination()


def _emitted(stream: DataFrame, root: str) -> DataFrame:
    spark: SparkSession = stream.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")

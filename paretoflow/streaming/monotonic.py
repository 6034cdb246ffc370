"""Updates that may only move forward, followed with state for each key.

A selection that is published again must be newer than the one kept. An older one would roll it back, another
one of the same time is an equivocation; both are refused, and so is what was seen before. Each row leaves the stream
with its verdict, so that refused ones can go to a table of their own:

accepted   newer than what was kept, which it replaces
repeated   what is kept, once more
rolled_back older than what is kept
equivocal  as old as what is kept, with another content

Rows of one key that arrive in one micro-batch are taken in the order of time and content, so a batch has one
outcome however its rows are dealt. Keys are dealt to a fixed number of buckets by hash: a bucket's rows of a
micro-batch are judged together as arrays, and its state is one value, a table with a row for each key. A task holds
one bucket. Rows without a time, or without a content, are ``incomplete`` and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of keys; a stream keeps their number for life.
BUCKETS = 1024


def _told(key: np.ndarray, at: np.ndarray, content: np.ndarray, kept: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame | None]:
    """Verdicts of complete rows, and what is kept after them: ``key``, ``at``, ``content``; None if nothing changes."""
    k, names = pd.factorize(key)
    c, _ = pd.factorize(content, sort=True)
    order = np.lexsort((c, at, k))
    k, at, c, content = k[order], at[order], c[order], content[order]
    place = pd.Index(kept["key"]).get_indexer(names)
    known = place >= 0
    old_at, old_content = np.zeros(len(names), "int64"), np.full(len(names), "", dtype=object)
    old_at[known], old_content[known] = kept["at"].to_numpy()[place[known]], kept["content"].to_numpy()[place[known]]
    # Runs of one key and time, and where each row's run begins.
    begins = np.ones(len(k), bool)
    begins[1:] = (k[1:] != k[:-1]) | (at[1:] != at[:-1])
    start = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    newer = ~known[k] | (at > old_at[k])
    same = np.where(newer, c == c[start], content == old_content[k])
    verdict = np.where(same, "repeated", "equivocal").astype(object)
    verdict[~newer & (at < old_at[k])] = "rolled_back"
    verdict[newer & begins] = "accepted"
    out = np.empty(len(k), dtype=object)
    out[order] = verdict
    ends = np.ones(len(k), bool)
    ends[:-1] = k[1:] != k[:-1]
    last = np.flatnonzero(ends & newer)
    if not len(last):
        return out, None
    changed = pd.DataFrame({"key": names[k[last]], "at": at[last], "content": content[start[last]]})
    stay = np.ones(len(kept), bool)
    stay[place[k[last]][known[k[last]]]] = False
    return out, pd.concat([kept[stay], changed], ignore_index=True)


class _Follow(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "table binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True)[["key", "at", "content", "gaps"]]
        kept = pd.DataFrame({"key": [], "at": np.zeros(0, "int64"), "content": []})
        if self.kept.exists():
            kept = pa.ipc.open_stream(bytes(self.kept.get()[0])).read_pandas()
        whole = arrived["gaps"].to_numpy() == 0
        verdicts = np.full(len(arrived), "incomplete", dtype=object)
        if whole.any():
            verdicts[whole], after = _told(*(arrived[c].to_numpy()[whole] for c in ("key", "at", "content")), kept)
            if after is not None:
                table = pa.table({"key": pa.array(after["key"], "string"), "at": pa.array(after["at"], "int64"), "content": pa.array(after["content"], "string")})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                self.kept.update((sink.getvalue().to_pybytes(),))
        yield arrived.assign(verdict=verdicts)

    def close(self) -> None:
        pass


def followed(updates: DataFrame, key: str, at: str, content: str, buckets: int = BUCKETS) -> DataFrame:
    """``key``, ``at``, ``content`` and ``verdict`` of every update of a stream."""
    spark = updates.sparkSession
    spark.conf.set(STORE, ROCKS)  # this kind of state lives in RocksDB only
    rows = updates.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(content).cast("string").alias("content"))
    # Arrays hold no nulls: a key gets a letter before it, and gaps are 1 without a time, 2 without a content, 3 without both.
    gaps = F.when(F.col("at").isNull(), 1).otherwise(0) + F.when(F.col("content").isNull(), 2).otherwise(0)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    filled = rows.select(
        bucket.alias("bucket"), F.coalesce(F.concat(F.lit("k"), "key"), F.lit("")).alias("key"),
        F.coalesce("at", F.lit(0)).alias("at"), F.coalesce("content", F.lit("")).alias("content"), gaps.alias("gaps"),
    )
    told = filled.groupBy("bucket").transformWithStateInPandas(_Follow(), "key string, at long, content string, gaps int, verdict string", "append", "None")
    return told.select(
        F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)).alias(key), F.when(~F.col("gaps").isin(1, 3), F.timestamp_micros("at")).alias(at),
        F.when(F.col("gaps") < 2, F.col("content")).alias(content), "verdict",
    )

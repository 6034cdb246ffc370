"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct 5-word shingles. Its sketch has one 16-bit register per bucket:
the leading-zero count of the bucket's smallest hash and ten bits of mantissa after them. Bands
of compressed registers find candidates; a Jaccard estimate from equal registers, corrected for
accidental collisions, sorts them into stars of leaders; exact intersections of full sets confirm links.

Defined cases: a null, empty or blank text has the empty set and is linked with nothing; fewer
than five words are one shingle; repeated rows and copies are one node; a null doc_id belongs to
its text's component and never names it unless no other member has an id; an empty table gives
an empty result; further columns are ignored here and kept by :func:`keep_one`, which tells rows
apart by all of them (maps apart, which Spark does not hash).

With 26 bands of 5 registers a pair at similarity 0.85 is missed with probability below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, neardup
from .common import arrow_rows, materialize, release, text_or_empty

BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
WIDTH = 5
PERCENT = 85


def compressed(smallest: np.ndarray) -> np.ndarray:
    """uint16 of bucket minima: six bits of leading zeros, ten bits of mantissa."""
    fraction, exponent = np.frexp(np.maximum(smallest, 1).astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    return (zeros << MANTISSA) | ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)


def _sketched(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found = [hashing.windows(hashing.words(t.encode("utf-8", "surrogatepass")), width) for t in texts]
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    return neardup.sketch(np.concatenate(found) if found else np.zeros(0, np.uint64), owner, len(found), REGISTERS)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch pairs, less the expected share of accidental collisions.

    For like sizes about 0.17 / 2**MANTISSA of the registers agree by accident, and fewer the
    more the sizes differ.
    """
    ratio = np.maximum(nx, ny) / np.maximum(1, np.minimum(nx, ny))
    accidental = 0.1699 / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, ((x == y).mean(1) - accidental) / (1 - accidental))


def keyed(docs: DataFrame) -> DataFrame:
    """The documents as a struct ``row``, and k1 and k2, 128 bits that name the whole row."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(7), *columns[::-1]).alias("k2"))


def sketches(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, k1, k2, s1 and s2 (name the set), n (its size) and regs of the :func:`keyed` rows."""
    arrow_rows(rows.sparkSession)
    kind = rows.schema["row"].dataType["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, bounds, ids, low = _sketched(list(b["text"]), width)
            n = np.diff(bounds)
            regs = compressed(low).astype("<u2")
            yield b.drop(columns="text").assign(s1=ids[:, 0], s2=ids[:, 1], n=n, regs=[r.tobytes() if k else b"" for r, k in zip(regs, n)])

    return rows.select("row.doc_id", "k1", "k2", text_or_empty("row.text").alias("text")).mapInPandas(
        sketch, f"doc_id {kind}, k1 long, k2 long, s1 long, s2 long, n long, regs binary"
    )


def shingle_sets(rows: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, shingles) of the rows ``wanted`` (node, k1, k2), computed anew from the documents."""
    chosen = rows.select("k1", "k2", text_or_empty("row.text").alias("text")).join(wanted, ["k1", "k2"]).select("node", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values, bounds, _, _ = _sketched(list(b["text"]), width)
            yield pd.DataFrame({"node": b["node"], "shingles": [values[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:])]})

    # A fully repeated row gives its set as often as it stands there.
    return chosen.mapInPandas(sets, "node long, shingles binary").dropDuplicates(["node"])


def judged(rows: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, k1, k2, n, name (the component's smallest doc_id) and stays (is it the one row to keep?) of the :func:`keyed` rows."""
    found = materialize(sketches(rows, width), "near-sketches")
    # One of the rows of a set stands for all of them; node ids are given once and written.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("k1"), F.col("k2"))).alias("one")
    nodes = found.filter("n > 0").groupBy("s1", "s2").agg(least, F.min("n").alias("n"), F.min("regs").alias("regs"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "one", "n", "regs"), "near-nodes")
    same = neardup.clusters(
        nodes.select("node", "n", "regs"),
        lambda wanted: shingle_sets(rows, nodes.join(wanted, "node").select("node", "one.k1", "one.k2"), width),
        BANDS, 2 * ROWS, REGISTERS, estimate, "<u2", percent,
    )
    named = nodes.select("node", "s1", "s2", "one").join(same, "node", "left").withColumn("c", F.coalesce("component", "node"))
    first = named.groupBy("c").agg(F.min("one").alias("first"))
    by_set = named.join(first, "c").select("s1", "s2", "first")
    out = found.drop("regs").join(by_set, ["s1", "s2"], "left")
    stays = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    out = materialize(out.select("doc_id", "k1", "k2", "n", F.col("first.doc_id").alias("name"), stays.alias("stays")), "near-judged")
    release(found, nodes, same)
    return out


def duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    found = judged(keyed(docs.select("doc_id", "text")), percent, width)
    component = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without all but one of each near-duplicate component, columns unchanged.

    The row with the smallest doc_id stays (nulls last, then the smallest hash of the whole row), once
    if it is fully repeated. Documents without words repeat nothing and all stay.
    """
    rows = keyed(docs)
    found = judged(rows, percent)
    gone = found.filter("n > 0 AND NOT stays").select("k1", "k2").distinct()
    kept = rows.join(gone, ["k1", "k2"], "left_anti")
    twice = found.filter("stays").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("k1", "k2")
    if twice.limit(1).count():
        kept = kept.join(twice, ["k1", "k2"], "left_anti").unionAll(kept.join(twice, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return kept.select("row.*")

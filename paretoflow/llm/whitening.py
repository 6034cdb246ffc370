"""Principal components of integer vectors and whitened coordinates.

A randomised range finder starts from a random basis of ``COMPONENTS + OVERSAMPLE`` columns. Each
power pass goes over all centred rows of the fit list (every distinct vector once), adds up the
covariance times the basis inside tasks, and Rayleigh-Ritz on the small product gives components
and their residuals. When a residual is still above ``RESIDUAL`` after ``PASSES`` passes, the basis is
expanded to the full dimension, where Rayleigh-Ritz is exact to rounding. Rows are centred exactly:
``n * x - S`` is an integer. What reaches the driver is bounded by the square of the dimension.

Defined cases: rows whose vector is null, empty, or holds a null, a non-finite entry or one of 2**40 and
more are dropped; so are those of another length than the most frequent one (of equally frequent ones,
the longest); components without variance (under 1e-13 of the trace) have no rows; repeated rows and
equal vectors count once in the fit and are all returned; a ``deviation`` above a long is null; an empty
table, or one distinct vector, gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

SCALE, OFFSET, LARGEST = 64, 1_000_000, float(1 << 40)
COMPONENTS, OVERSAMPLE, PASSES, SEED = 16, 10, 5, 13
#: Of a component's residual, as a share of the greatest eigenvalue.
RESIDUAL = 2e-14
LEAST_SHARE = 1e-13


@dataclass(frozen=True)
class Model:
    n: int
    sums: np.ndarray
    vectors: np.ndarray  # one column for each component
    values: np.ndarray
    trace: float
    identity_error: float = 0.0
    passes: int = 0
    expanded: bool = False


def integers(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and the integer vector ``x`` of every usable row."""
    c = F.col(vector).cast("array<double>")
    usable = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    x = F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + F.lit(OFFSET))
    return rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(usable).select(F.col(key).alias("vec_id"), x.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(len(x), -1)


def _added(fit: DataFrame, block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of ``block`` of some rows: added in each task, then by cell over the tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                now = block(_matrix(batch))
                total = now if total is None else total + now
        if total is not None:
            cells = np.arange(total.size, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel().astype(np.float64))], ["cell", "value"])

    # As columns in one job: a local iterator runs one for each shuffle partition.
    cells = fit.mapInArrow(partial, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape)
    out.flat[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    return out


def components(fit: DataFrame, n: int, sums: np.ndarray, k: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> Model:
    """Eigenvectors of the covariance of the rows ``x`` of ``fit``."""
    d = len(sums)

    def centred(x: np.ndarray) -> np.ndarray:
        return (n * x - sums) / n

    def times(basis: np.ndarray) -> tuple[np.ndarray, float]:
        def block(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return np.vstack([c.T @ (c @ basis), np.full((1, basis.shape[1]), (c * c).sum())])

        found = _added(fit, block, (d + 1, basis.shape[1])) / n
        return found[:d], found[d, 0]

    rng = np.random.default_rng(SEED)
    basis = np.linalg.qr(rng.standard_normal((d, min(d, k + oversample))))[0]
    for done in range(1, passes + 2):
        product, trace = times(basis)
        inner = basis.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        vectors = basis @ turn
        rest = np.linalg.norm(product @ turn - vectors * values, axis=0).max(initial=0)
        full = basis.shape[1] == d
        if full or trace == 0 or rest <= RESIDUAL * values[0]:
            break
        if done < passes:
            basis = np.linalg.qr(product)[0]
        else:
            basis = np.linalg.qr(np.hstack([basis, rng.standard_normal((d, d - basis.shape[1]))]))[0]
    alive = values > LEAST_SHARE * trace
    vectors, values = vectors[:, alive], values[alive]
    error = 0.0
    if alive.any():
        scaled = vectors / np.sqrt(values)

        def moments(x: np.ndarray) -> np.ndarray:
            y = centred(x) @ scaled
            return np.vstack([y.T @ y, y.sum(0)])

        found = _added(fit, moments, (len(values) + 1, len(values))) / n
        mean = found[-1]
        error = float(np.abs(found[:-1] - np.outer(mean, mean) - np.eye(len(values))).max())
    return Model(n, sums, vectors, values, trace, error, done, full)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every usable row and component: the whitened coordinate, and figures of the fit."""
    kind = rows.schema[key].dataType
    found = integers(rows, key, vector)
    lengths = found.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    found = found.filter(F.size("x") == d)
    fit = materialize(found.select("x").distinct(), "whitening-fit")
    totals = fit.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    total = sorted((r["j"], r["s"], r["n"]) for r in totals.collect())
    n = total[0][2] if total else 0
    model = components(fit, n, np.array([s for _, s, _ in total], np.int64)) if n else Model(0, np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    fields = [
        T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(model.values)
        scaled = model.vectors / np.sqrt(model.values) if m else None
        for batch in batches:
            if not m or not batch.num_rows:
                continue
            off = model.n * _matrix(batch) - model.sums
            fits = (off.astype(float) ** 2).sum(1) < 9.2e18
            deviation = pa.array(np.repeat((off * off).sum(1), m), mask=np.repeat(~fits, m))
            y = (off / model.n) @ scaled
            rows_ = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows_), m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows_)),
                    pa.array(np.full(rows_ * m, model.n)),
                    deviation,
                    pa.array(y.ravel()),
                    pa.array(np.tile(model.values / model.trace, rows_)),
                    pa.array(np.full(rows_ * m, model.identity_error)),
                ],
                names=[f.name for f in fields],
            )

    return found.mapInArrow(project, T.StructType(fields))

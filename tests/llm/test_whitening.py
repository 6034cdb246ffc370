"""Whitening against numpy's eigenvectors of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from paretoflow.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, d, seed=3, decay=1.0):
    g = np.random.default_rng(seed)
    return (g.standard_normal((n, d)) * decay ** np.arange(d) * 3).astype(np.float32)


def reference(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    values, vectors_ = np.linalg.eigh(c.T @ c / n)
    return n, s, values[::-1], vectors_[:, ::-1]


def check(spark, data, d):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    found = whitening.whiten(df).collect()
    usable = [(i, v) for i, v, _ in data if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in usable], np.int64)
    n, s, values, basis = reference(x)
    k = min(16, int((values > 1e-12 * values.sum()).sum()))
    assert len(found) == len(usable) * k
    by = {}
    for r in found:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], r)
    signs = {}
    for j in range(k):
        want = ((n * x - s) / n) @ basis[:, j] / math.sqrt(values[j])
        got = np.array([by[j + 1][i]["whitened"] for i, _ in usable])
        big = np.abs(want).argmax()
        signs[j] = np.sign(want[big] * got[big])
        np.testing.assert_allclose(got, signs[j] * want, rtol=1e-7, atol=1e-8)
        r = by[j + 1][usable[0][0]]
        assert r["n"] == n and abs(r["explained"] - values[j] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9
    for (i, _), row in zip(usable, x.tolist()):
        assert by[1][i]["deviation"] == sum((n * a - b) ** 2 for a, b in zip(row, s.tolist()))
    return found


def test_odd_rows(spark):
    data = [(k, v.tolist(), 0) for k, v in enumerate(vectors(120, 20))]
    data += [(200 + k, data[5][1], 1) for k in range(30)]  # copies count once in the fit
    nan, inf = float("nan"), float("inf")
    data += [(300, None, 0), (301, [nan] * 20, 0), (302, [inf] * 20, 0), (303, [None] * 20, 0), (304, [], 0), (305, [1.0] * 3, 0)]
    check(spark, data, 20)


def test_few_dimensions_and_flat_ones(spark):
    data = [(k, [*v.tolist(), 0.5], 0) for k, v in enumerate(vectors(60, 4))]
    assert {r["component"] for r in check(spark, data, 5)} == {1, 2, 3, 4}


def test_nothing(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).count() == 0
    names = spark.createDataFrame([(1, [1.0, 2.0], 0, 5), (2, [3.0, 2.5], 0, 6)], SCHEMA + ", x long")
    assert [(r["vec_id"], abs(round(r["whitened"], 6))) for r in whitening.whiten(names).orderBy("vec_id").collect()] == [(1, 1.0), (2, 1.0)]


@pytest.mark.parametrize("decay, expanded", [(0.35, False), (1.0, True)])
def test_the_range_finder_expands_only_where_residuals_fail(spark, decay, expanded):
    x = np.floor(64 * vectors(400, 40, decay=decay).astype(float) * 1000).astype(np.int64)
    x = np.unique(x, axis=0)
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(3)
    model = whitening.components(fit, len(x), x.sum(0), k=4, oversample=8)
    assert model.expanded == expanded
    values, basis = reference(x)[2:]
    assert np.allclose(model.values, values[:4], rtol=1e-12)
    assert np.allclose(np.abs((model.vectors * basis[:, :4]).sum(0)), 1, atol=1e-12)


def test_large_deviations_are_null_and_exact_below(spark):
    data = [(1, [3e10], 0), (2, [0.0], 0), (3, [1e3], 0)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(data, SCHEMA)).collect()}
    x = [math.floor(Fraction(float(np.float32(v))) * 64) + 1000000 for v in (3e10, 0.0, 1e3)]
    exact = [(3 * a - sum(x)) ** 2 for a in x]
    assert [got[k + 1] for k in range(3)] == [e if e < 9.2e18 else None for e in exact]


def test_jobs_do_not_grow_with_shuffle_partitions(spark):
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    data = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors(60, 30))], SCHEMA)
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("whitening-jobs", "")
        whitening.whiten(data)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("whitening-jobs")) < 64
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)

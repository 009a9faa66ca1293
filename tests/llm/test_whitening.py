import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import queries as q
from quarrymill.llm import whitening as w

VECTORS = "vec_id long, embedding array<float>"


def wanted(vectors):
    """Longs x, their covariance and its falling eigenvalues, from exact integers."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    apart = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    cov = apart.T @ apart / n
    return n, [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x], apart, cov, np.linalg.eigvalsh(cov)[::-1]


def check(rows, vectors, ids, components):
    n, deviation, apart, cov, values = wanted(vectors)
    got = sorted(rows, key=lambda r: (r.vec_id is None, r.vec_id or 0, r.component))
    order = sorted(range(n), key=lambda i: (ids[i] is None, ids[i] or 0))
    assert [(r.vec_id, r.component) for r in got] == [(ids[i], k + 1) for i in order for k in range(components)]
    m = np.array([r.whitened for r in got]).reshape(n, components)
    for at, i in enumerate(order):
        assert {r.deviation for r in got[at * components : (at + 1) * components]} == {deviation[i]}
    assert all(r.n == n for r in got) and np.allclose(m.mean(axis=0), 0, atol=1e-9)
    error = np.abs(m.T @ m / n - np.eye(components)).max()
    assert error <= 1e-8 and {r.identity_error for r in got} and all(abs(r.identity_error - error) < 1e-9 for r in got)
    assert np.allclose([r.explained for r in got[:components]], values[:components] / np.trace(cov), rtol=1e-9)
    # components are eigenvectors: whitened = apart @ axes / sqrt(values)
    axes = np.linalg.lstsq(apart, m[np.argsort(order)] * np.sqrt(values[:components]), rcond=None)[0]
    assert np.allclose(cov @ axes, axes * values[:components], atol=1e-6 * values[0])


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 3).astype(np.float32).tolist()
    vectors += vectors[:5]
    ids = [*range(304), None]
    odd = [(900, None), (901, []), (902, [None] * 12), (903, [1.0] * 11 + [float("nan")]), (904, [float("inf")] + [1.0] * 11), (905, [1.0] * 5), (906, [3e38] * 12)]
    df = spark.createDataFrame([*zip(ids, vectors), *odd], VECTORS).repartition(4)
    for name in ("x", "n", "w", "c0", "deviation", "component", "count"):
        df = df.withColumn(name, F.lit(1))
    check(w.whiten(df, components=8).collect(), vectors, ids, 8)


def test_query_against_numpy(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check(q.op13_whitening(spark, sf).collect(), [r.embedding for r in rows], [r.vec_id for r in rows], 32)


def test_components_without_variance_are_left_out(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], VECTORS)
    got = w.whiten(df).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and got[0].explained == pytest.approx(1)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    made = w.whiten(spark.createDataFrame(rows, VECTORS))
    assert made.collect() == [] and made.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_are_exact():
    apart, rest = np.array([[10**9, -7], [2, 3]]), np.array([5, 1])
    assert w.deviations(apart, 10**4, rest) == [None, (2 * 10**4 - 5) ** 2 + (3 * 10**4 - 1) ** 2]
    assert w.deviations(np.array([[2, 3]]), 10, rest) == [15**2 + 29**2]


def test_many_pairs_take_several_aggregations(spark, monkeypatch):
    monkeypatch.setattr(w, "PAIRS", 4)
    rows = [[1.0, 2.0, 3.0], [0.5, -1.0, 2.0]]
    assert np.allclose(w.product_sums(spark.createDataFrame(rows, "a double, b double, c double")), np.array(rows).T @ np.array(rows))

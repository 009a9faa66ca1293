import numpy as np
from pyspark.sql import functions as F

from quarrymill.llm import vector_topk as vt


def brute(rows, k, every):
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(s)}
    return out


def run(spark, rows, k=3, every=5, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    return [tuple(r) for r in vt.top_k(df, F.col("vec_id") % every == 0, k=k, **more).collect()]


def test_equals_brute_force_with_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(60)]
    rows += [(i, rows[7][1]) for i in range(60, 130)]  # copies of one vector
    rows += [(200, None), (205, []), (210, [None] * 8), (215, [float("nan")] * 8), (220, [float("inf")] * 8), (None, rows[0][1]), (225, [0.5, 0.25])]
    rows += [(230 + i, [float(i % 2)] * 8) for i in range(12)]
    for more in ({}, {"bits": 2, "scan_block": 16}, {"query_block": 4}):
        got = run(spark, rows, **more)
        assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 5)


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.0])]) == [(0, 1, 1, 1024 * 512)]


def test_large_components_are_exact(spark):
    rows = [(i, [2.0**20 + i, -(2.0**20)]) for i in range(12)]
    assert set(run(spark, rows)) == brute(rows, 3, 5)
    nearest = lambda x: max(1 - 2**63, min(2**63 - 1, x))
    for big in (3e6, 3e9, 3e38):  # products beyond an int, a double's 53 bits, and a long
        rows = [(i, [float(np.float32(big)) if i % 4 == 0 else 0.25 * i, float(i), -1.5]) for i in range(30)]
        assert set(run(spark, rows)) == {(q, r, v, nearest(x)) for q, r, v, x in brute(rows, 3, 5)}


def test_components_that_leave_the_doubles(spark):
    rows = [(0, [1.7e308, 1.0]), (1, [1.7e308, -1.7e308]), (2, [-1.7e308, 2.0]), (3, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r)[:3] for r in vt.top_k(df, F.col("vec_id") % 2 == 0, k=2).collect()]
    assert set(got) == {(0, 1, 1), (0, 2, 3), (2, 1, 3), (2, 2, 0)}


def test_many_candidates_meet_their_vectors_by_a_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(90)]
    monkeypatch.setattr(vt, "BROADCAST_CANDIDATES", 3)
    monkeypatch.setattr(vt, "HELD", 20)
    assert set(run(spark, rows, bits=3, scan_block=7)) == brute(rows, 3, 5)


def test_bounds_hold():
    rng = np.random.default_rng(7)
    x, q = np.floor(rng.normal(0, 300, (50, 6))), np.floor(rng.normal(0, 300, (9, 6)))
    low, high = vt.bounds(q, *vt.cells_of(x, 3), 3)
    assert (low <= q @ x.T).all() and (q @ x.T <= high).all() and np.isfinite(high).all()

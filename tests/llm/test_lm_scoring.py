import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quarrymill.llm import lm_scoring as lm

from .util import ODD, docs

SF = "/root/testdata/sf0.001"


def tokens(t):
    return [*(t or "").encode().lower().split(), lm.END]


def rows(spark):
    return ODD + [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("sizes", [{}, {"classes": 50, "head": 100}])
def test_counts_and_base_score_equal_brute_force(spark, sizes):
    data = rows(spark)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in data if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (str((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in data
    )
    out = lm.score_documents(docs(spark, data, extra=True), **sizes).collect()
    got = sorted((str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens)), r.base_score) for r in out)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_probabilities_are_normalised_and_scores_follow_them(spark):
    data = rows(spark)
    fitted = lm.fit(docs(spark, data), classes=40, head=60)
    a1, a2, z = fitted.model.tables()
    p = np.exp(a1[:, None] + a2[None] - z[..., None]).sum(2)
    assert np.allclose(p, 1, atol=1e-4)
    c = Counter(w for _, t in data for w in tokens(t))
    cls = lm.Classes(fitted.words, len(fitted.words))
    tail = [w for w in c if cls[w] == cls.rest]
    assert fitted.tail_mass == sum(c[w] + 1 for w in tail) + 1
    got = {r.doc_id: r.score for r in lm.score(docs(spark, data[-30:]), fitted).collect()}
    for i, t in data[-30:]:
        u = v = cls[lm.END]
        s = 0.0
        for w in tokens(t):
            k = cls[w]
            s += (a1[u, k] + a2[v, k] - z[u, v]) / math.log(10) + (math.log10((c[w] + 1) / fitted.tail_mass) if k == cls.rest else 0)
            u, v = k, u
        assert math.isclose(got[i], s, rel_tol=1e-4)


def test_words_outside_the_classes_are_told_apart_by_group(spark):
    data = rows(spark)
    fitted = lm.fit(docs(spark, data), classes=40, head=60, groups=32)
    a1, a2, z = fitted.model.tables()
    assert len(a1) == 39 + 32 and np.allclose(np.exp(a1[:, None] + a2[None] - z[..., None]).sum(2), 1, atol=1e-4)
    c = Counter(w for _, t in data for w in tokens(t))
    group = {w: zlib.crc32(w[-lm.ENDING :]) % 32 for w in c if w not in fitted.words}
    mass = Counter({g: 1 for g in range(32)})
    for w, g in group.items():
        mass[g] += c[w] + 1
    assert fitted.group_mass.tolist() == [mass[g] for g in range(32)]
    cls = {**{w: k for k, w in enumerate(fitted.words)}, **{w: 39 + g for w, g in group.items()}}
    got = {r.doc_id: r.score for r in lm.score(docs(spark, data[-30:]), fitted).collect()}
    for i, t in data[-30:]:
        u = v = cls[lm.END]
        s = 0.0
        for w in tokens(t):
            k = cls[w]
            s += (a1[u, k] + a2[v, k] - z[u, v]) / math.log(10) + (math.log10((c[w] + 1) / mass[group[w]]) if w in group else 0)
            u, v = k, u
        assert math.isclose(got[i], s, rel_tol=1e-4)


def test_groups_beat_one_rest_class_on_held_out_text(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    grouped, one = (lm.score_documents(d, **x).where("held_out").agg({"score": "sum"}).first()[0] for x in ({}, {"groups": 1}))
    assert grouped > one


def test_model_beats_unigrams_on_held_out_text(spark):
    got = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and len(held) > 50


def test_no_training_rows(spark):
    assert lm.score_documents(docs(spark, [])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm.score_documents(docs(spark, [(only, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)


def test_groups_are_told_by_their_endings_once(monkeypatch):
    """A text's words outside the classes cost one checksum an ending, not one a token."""
    calls = []
    monkeypatch.setattr(lm, "crc32", lambda x: calls.append(x) or zlib.crc32(x))
    classes = lm.Classes([lm.END, b"the"], 2, 1024)
    texts = [b"The " + b" ".join(b"w%dab c%dde" % (k, k) for k in range(500)), b"", b"x the \xc3\xa9"]
    w, u, v, doc, flat = lm._classed(texts, classes)
    assert flat == [x for t in texts for x in (*t.lower().split(), lm.END)]
    assert w.tolist() == [0 if x == lm.END else 1 if x == b"the" else 2 + zlib.crc32(x[-2:]) % 1024 for x in flat]
    assert doc.tolist() == [0] * 1002 + [1] + [2] * 4 and u[:3].tolist() == [0, 1, w[1]] and v[:3].tolist() == [0, 0, 1]
    assert sorted(calls) == [b"ab", b"de", b"x", b"\xc3\xa9"]


def test_a_step_moves_as_its_gradients_say():
    """One step against the objective's gradients in double precision, summed row by row."""
    rng = np.random.default_rng(3)
    shares = rng.random(40) + 0.1
    shares /= shares.sum()
    model = lm.LogBilinear.start(shares)
    u, v, w = (rng.integers(0, 40, 300) for _ in range(3))
    trainer = lm.Trainer(model, shares, 7)
    n = np.searchsorted(np.cumsum(shares), np.random.default_rng(7).random(lm.NOISE) * np.cumsum(shares)[-1]).clip(0, 39)
    trainer.step(u, v, w)
    r, qq, c1, c2, b = (x.astype(float) for x in model.arrays())
    kq = np.log(lm.NOISE * shares)
    p = r[u] @ c1 + r[v] @ c2
    g = 1 / (1 + np.exp((p * qq[w]).sum(1) + b[w] - kq[w])) / 300
    h = -1 / (1 + np.exp(-(p @ qq[n].T + b[n] - kq[n]))) / 300
    dp = g[:, None] * qq[w] + h @ qq[n]
    grads = [np.zeros_like(x) for x in (r, qq, c1, c2, b)]
    np.add.at(grads[0], u, dp @ c1.T)
    np.add.at(grads[0], v, dp @ c2.T)
    np.add.at(grads[1], w, g[:, None] * p)
    np.add.at(grads[1], n, h.T @ p)
    grads[2], grads[3] = r[u].T @ dp, r[v].T @ dp
    np.add.at(grads[4], w, g)
    np.add.at(grads[4], n, h.sum(0))
    for x, d, got in zip((r, qq, c1, c2, b), grads, trainer.model.arrays()):
        assert np.allclose(x + lm.RATE * d / np.sqrt(1e-3 + d * d), got, atol=1e-4)

import os
import random
from fractions import Fraction

import numpy as np
import pytest

from quarrymill.llm import jaccard_join as jj
from quarrymill.llm.common import shared_root

from .util import ODD, docs


def sets(rows, size):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    return out


def brute(rows, size, threshold):
    """component and number of shingles of each id; ids that repeat are one document."""
    t, known = Fraction(threshold), sets(rows, size)
    parent = {i: i for i, _ in known if i is not None}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    links = {}
    for a, (i, x) in enumerate(known):
        for b, (j, y) in enumerate(known):
            if a != b and i is not None and j is not None and x and y and len(x & y) >= t * len(x | y):
                links[a] = links.get(a, 0) + 1
                if find(i) != find(j):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    return [(i, len(x), None if i is None else find(i), links.get(a, 0)) for a, (i, x) in enumerate(known)]


def near(seed, groups=6, copies=25, words=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    out, n = [], 0
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(words)] = word()
            out.append((1000 + n * 7919 % 10007, " ".join(w)))
            n += 1
    return out + [(50 + k, " ".join(word() for _ in range(rng.randint(1, 50)))) for k in range(60)]


def got(df):
    return sorted((str(tuple(r)) for r in df.collect()))


@pytest.mark.parametrize("size,threshold", [(3, "0.9"), (5, "0.8"), (1, "0.5")])
def test_equals_brute_force(spark, size, threshold):
    rows = near(size)
    result = jj.jaccard_components(docs(spark, rows, extra=True).repartition(4), size, threshold)
    assert got(result) == sorted(map(str, brute(rows, size, threshold)))


@pytest.mark.parametrize("members", [4, 12, 60])
def test_large_regions_are_dealt_out(spark, monkeypatch, members):
    monkeypatch.setattr(jj, "TASK_MEMBERS", members)
    rows = near(7, groups=2, copies=70)
    assert got(jj.jaccard_components(docs(spark, rows), 3, "0.9")) == sorted(map(str, brute(rows, 3, "0.9")))


def test_odd_rows(spark):
    rows = [r for r in ODD if r != (4, "one")] + [(4, "one"), (20, "ONE"), (21, "two words"), (22, "two  WORDS"), (23, "words two"), (24, None), (None, "one")]
    assert got(jj.jaccard_components(docs(spark, rows, extra=True), 3, "0.9").drop("n_links")) == sorted(str(r[:3]) for r in brute(rows, 3, "0.9"))
    again = jj.jaccard_components(docs(spark, [(1, "a b c d"), (1, "a b c d"), (1, "other text"), (2, "other text")])).collect()
    assert {r.component_id for r in again} == {1} and len(again) == 4
    assert jj.jaccard_components(docs(spark, [])).count() == 0


def test_a_coarse_sketch_changes_nothing(spark):
    rows = near(3, groups=3)
    result = jj.jaccard_components(docs(spark, rows), 3, "0.9", max_sketch_bytes=1 << 18)
    assert got(result) == sorted(map(str, brute(rows, 3, "0.9")))


def test_recursion_inside_a_task_finds_all_pairs():
    rng = np.random.default_rng(0)
    data = []
    for _ in range(40):
        base = rng.integers(0, 10**6, 40)
        for _ in range(rng.integers(1, 30)):
            x = base.copy()
            x[: rng.integers(0, 6)] = rng.integers(0, 10**6, 1)
            data.append(np.unique(x).astype(np.uint64))
    t = Fraction("0.8")
    table = jj.SetTable(data, t)
    everyone = np.arange(len(data))
    assert len(data) > jj.LEAF
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(table.linked(everyone, everyone), 1)))}
    some = [(i, j) for i, j in list(want)[:50]]
    assert all(len(set(data[i].tolist()) & set(data[j].tolist())) >= t * len(set(data[i].tolist()) | set(data[j].tolist())) for i, j in some)
    found = {(min(a, b), max(a, b)) for x, y in jj.join_region(table, everyone, 0.2) for a, b in zip(x.tolist(), y.tolist())}
    assert found == want


def test_keep_one(spark):
    rows = near(5, groups=3) + [(None, "same same same same same same"), (None, "same same same same same same"), (2000, ""), (2001, None), (1000, "again")]
    kept = jj.keep_one(docs(spark, rows, extra=True)).collect()
    want = {i for i, _, c, _ in brute([r for r in rows if r[0] is not None], 5, "0.8") if i == c}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in kept) == 2
    assert jj.keep_one(docs(spark, rows)).columns == docs(spark, rows).columns


def test_keep_one_leaves_no_table_but_the_copies(spark, monkeypatch):
    """Its tables and shuffle files stayed on disk while all texts were shuffled, and in the pipeline's later stages."""
    monkeypatch.setattr(jj, "TASK_MEMBERS", 12)
    rows = near(9, groups=2, copies=70)
    folder = shared_root(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    kept = jj.keep_one(docs(spark, rows), 3, "0.9")
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("jaccard-copies")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c, _ in brute(rows, 3, "0.9") if i == c)


def test_signatures_never_exceed_the_distance():
    rng = np.random.default_rng(2)
    for n in (5, 300, 1500, 5000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate((x[n // 10 :], rng.integers(0, 2**63, n // 20, dtype=np.uint64))))
        doc = np.repeat([0, 1], [len(x), len(y)])
        edges, longs = jj.parity_signatures(doc, np.concatenate((x, y)), np.array([n, n]))
        a, b = longs[edges[0] : edges[1]].view(np.uint64), longs[edges[1] : edges[2]].view(np.uint64)
        assert sum(int(v).bit_count() for v in a ^ b) <= len(np.setxor1d(x, y))

import math
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quarrymill.llm import mixing as mx

from .util import ODD, docs


def corpus(spark):
    rows = [(i, f"w{i} " * (1 + i % 7), "big" if i % 3 else f"s{i % 9}") for i in range(300)]
    return docs(spark, rows, extra=True)


def totals(df):
    return {r.source: r.t for r in df.groupBy("source").agg(F.sum(mx.word_count()).alias("t")).collect()}


def check(df, budget, **options):
    t = totals(df)
    rows = mx.mix(df, budget=budget, block_tokens=20, tokens=mx.word_count(), **options).collect()
    total = budget or sum(t.values())
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    weights = {s: x[0].weight for s, x in by.items()}
    assert math.isclose(sum(weights.values()), 1)
    for s, x in by.items():
        part = weights[s] * total
        dealt = sum(r.n_tokens for r in x)
        assert part - 1e-6 <= dealt < part + 7
        full = int(part // t[s] + 1e-9)
        ids = {r.doc_id for r in x if r.epoch == 1}
        for e in range(1, full + 1):
            assert sorted(r.doc_id for r in x if r.epoch == e) == sorted(ids) and len(ids) == sum(r.epoch == e for r in x)
        assert len({r.doc_id for r in x if r.epoch == full + 1}) == sum(r.epoch == full + 1 for r in x)
    return weights, t, rows


def test_repetition_limit_is_met_and_tight(spark):
    df = corpus(spark)
    w, t, _ = check(df, None, max_repetition=1.5)
    total = sum(t.values())
    assert math.isclose(max(w[s] * total / t[s] for s in w), 1.5, rel_tol=1e-6)
    ratios = {round(math.log(w["big"] / w[s]) / math.log(t["big"] / t[s]), 6) for s in w if s != "big"}
    assert len(ratios) == 1  # one exponent for all


def test_entropy_target(spark):
    df = corpus(spark)
    w, t, _ = check(df, 2000, max_repetition=None, target_entropy=1.3)
    assert math.isclose(-sum(x * math.log(x) for x in w.values()), 1.3, abs_tol=1e-6)
    w, t, _ = check(df, None, max_repetition=None, target_entropy=0.0)  # out of reach: the plain shares
    assert all(math.isclose(w[s], t[s] / sum(t.values())) for s in w)
    w, *_ = check(df, None, max_repetition=None, target_entropy=99.0)
    assert all(math.isclose(x, 1 / len(w)) for x in w.values())


def test_epochs_permute_differently_and_runs_repeat(spark):
    _, _, a = check(corpus(spark), 9000, max_repetition=8.0)
    _, _, b = check(corpus(spark).repartition(7), 9000, max_repetition=8.0)
    assert sorted(map(str, a)) == sorted(map(str, b))
    order = lambda e: [r.doc_id for r in sorted(a, key=lambda r: (r.order_key, r.shuffle_key)) if r.epoch == e and r.source == "big"]
    assert order(1) != order(2) and sorted(order(1)) == sorted(order(2))


def test_whole_keeps_every_document(spark):
    df = corpus(spark)
    out = mx.mixed_documents(df, max_repetition=2.0, whole=True)
    assert out.columns == df.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(n) == set(range(300)) and max(n.values()) == 2 and all(n[i] == 1 for i in range(300) if i % 3)


@pytest.mark.parametrize("whole", [False, True])
def test_odd_rows(spark, whole):
    rows = [(i, t, None if k % 2 else "s") for k, (i, t) in enumerate(ODD)] + [(77, "", "blank"), (78, None, "blank")]
    out = mx.mix(docs(spark, rows, extra=True), whole=whole, max_repetition=2.0).collect()
    assert {r.source for r in out} == {None, "s"}
    assert mx.mix(docs(spark, [])).count() == 0
    assert mx.mixed_documents(docs(spark, []), whole=True).count() == 0
    assert mx.mix(docs(spark, [(1, None), (2, "")])).count() == 0


def test_whole_keeps_documents_without_tokens(spark):
    rows = [(i, "a b c", "s") for i in range(20)] + [(30, "", "blank"), (31, None, "blank"), (32, " ", None), (33, "", "s"), (33, "", "s"), (None, "", "blank")]
    rows += [(i, "", "s") for i in range(100, 140)]  # some of its blocks hold empty texts only
    out = mx.mixed_documents(docs(spark, rows), max_repetition=2.0, whole=True, block_tokens=2).collect()
    assert sorted(str((r.doc_id, r.text, r.source)) for r in out) == sorted(map(str, rows))
    only = docs(spark, [(1, None), (2, "")])
    assert mx.mixed_documents(only, whole=True).count() == 2 and mx.mixed_documents(only).count() == 0


def test_documents_come_as_often_as_planned_and_in_the_mixture_order(spark, tmp_path):
    rows = [(i, f"w{i} " * (1 + i % 7), f"s{i % 3}") for i in range(60)] + [(1, "w1 " * 2, "s1"), (1, "w1 " * 2, "s0"), (7, "w7 ", "s1"), (7, "w7 ", "s1")]
    df = docs(spark, rows, extra=True)
    for budget in (None, 333):
        options = {"budget": budget, "max_repetition": 3.0, "block_tokens": 15}
        plan = sorted(mx.mix(df, **options).collect(), key=lambda r: (r.order_key, r.shuffle_key, r.doc_id))
        mx.mixed_documents(df, **options).write.parquet(f"{tmp_path}/{budget}")
        files = sorted(tmp_path.glob(f"{budget}/part-*"), key=lambda f: f.name)
        got = [r for f in files for r in spark.read.parquet(f"file://{f}").coalesce(1).collect()]
        assert [(r.doc_id, r.source) for r in got] == [(r.doc_id, r.source) for r in plan]


def spark_hash(*values):
    """xxhash64 of a row as Spark computes it: each value's hash seeds the next; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute(rows, budget, limit, block_tokens, seed=0):
    """(doc_id, source, epoch, block, block_rank) of every turn, walked one by one."""
    num = lambda x: None if x is None else struct.pack("<q", x)
    small = lambda x: struct.pack("<i", x)
    sized = [(i, spark_hash(t or ""), s, len((t or "").encode().split())) for i, t, s in rows]
    tokens = Counter()
    for _, _, s, n in sized:
        tokens[s] += n
    total = sum(tokens.values())
    budget = budget or total
    share = {s: n / total for s, n in tokens.items() if n}

    def weights(a):
        z = sum(x**a for x in share.values())
        return {s: x**a / z for s, x in share.items()}

    low, high = 0.0, 1.0
    if max(w * budget / tokens[s] for s, w in weights(0).items()) <= limit:
        high = 0.0
    for _ in range(60):
        if high - low < 1e-12:
            break
        mid = (low + high) / 2
        ok = max(w * budget / tokens[s] for s, w in weights(mid).items()) <= limit
        low, high = (low, mid) if ok else (mid, high)
    out = []
    for s, w in weights(high).items():
        part = w * budget * (1 - 1e-9)
        n_blocks = -(-tokens[s] // block_tokens)
        blocks = {}
        for i, k, source, n in sized:
            if source == s:
                blocks.setdefault(spark_hash(small(seed), num(i), num(k)) % n_blocks, []).append((i, k, n))
        dealt, epoch = 0, 1
        while dealt < part:
            order = sorted(blocks, key=lambda b: (spark_hash(small(seed), small(epoch), s, small(b)), b))  # noqa: B023
            for rank, b in enumerate(order, 1):
                if dealt >= part:
                    break
                for i, k, n in sorted(blocks[b], key=lambda d: (spark_hash(small(seed), small(epoch), num(d[0]), num(d[1])), d[0], d[1])):  # noqa: B023
                    if dealt >= part:
                        break
                    out.append((i, s, epoch, b, rank))
                    dealt += n
            epoch += 1
    return out


@pytest.mark.parametrize("budget, limit", [(None, 1.5), (900, 2.0)])
def test_equals_dealing_one_by_one(spark, budget, limit):
    rows = [(i, f"w{i} " * (1 + i % 7), "big" if i % 3 else f"s{i % 9}") for i in range(150)]
    got = mx.mix(docs(spark, rows), budget=budget, max_repetition=limit, block_tokens=25).collect()
    assert sorted((r.doc_id, r.source, r.epoch, r.block, r.block_rank) for r in got) == sorted(brute(rows, budget, limit, 25))

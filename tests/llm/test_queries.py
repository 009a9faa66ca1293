"""The registered queries, production parameters included, against brute force on the smallest tables."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import pytest

from quarrymill.llm import fingerprints as fp
from quarrymill.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return q.queries()[name](spark, SF).collect()


def test_op2(spark, texts):
    t = Counter()
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = {i: len((x or "").encode().split()) for i, x in texts.items()}
    for i in texts:
        t[sources[i]] += n[i]
    got = rows(spark, "op2_mixing")
    dealt, weights = Counter(), {}
    for r in got:
        assert r.n_tokens == n[r.doc_id] and r.source == sources[r.doc_id]
        dealt[r.source] += r.n_tokens
        weights[r.source] = r.weight
    total = sum(t.values())
    assert math.isclose(sum(weights.values()), 1) and set(weights) == {s for s in t if t[s]}
    for s, w in weights.items():
        assert w * total / t[s] <= 4 * (1 + 1e-9)
        assert w * total * (1 - 1e-6) <= dealt[s] < w * total + max(n[i] for i in texts if sources[i] == s)
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)


def test_op4(spark, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(q.tokenizer_path("word_bpe_49k.json"))
    want = set()
    for i, t in texts.items():
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        want.add((i, len((t or "").encode()), n, n > 2048))
    assert {tuple(r) for r in rows(spark, "op4_token_counts")} == want


def test_op5(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=q.tokenizer_path("piece_bpe_32k.model"))
    want = set()
    for i, t in texts.items():
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert {tuple(r)[:4] for r in rows(spark, "op5_sentencepiece")} == want


def test_op6(spark, texts):
    order = sorted(texts)
    got = {r.doc_id: r for r in rows(spark, "op6_fingerprints")}
    for i, j in zip(order, order[1:] + order[:1]):
        t, m = texts[i], len(texts[i]) // 4
        edited = t[: len(t) - m] + texts[j][:m]
        want = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(t).hex(), fp.fingerprint(edited).hex())
        assert tuple(got[i])[:5] == want


def test_op8(spark, texts):
    got = rows(spark, "op8_quality")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_op9(spark, texts):
    words = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, x in words.items() if not held[i] for w in x)
    n, v = sum(c.values()), len(c)
    for r in rows(spark, "op9_lm_scoring"):
        x = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(x), sum(c[w] > 0 for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)

import hashlib

import numpy as np
import pytest

from quarrymill.llm import fingerprints as fp

from .util import ODD, docs


def phrases(text):
    """LZ78 phrases, by position."""
    seen, at, out = set(), 0, []
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in seen:
            n += 1
        if at + n > len(text):
            break
        seen.add(text[at : at + n])
        out.append(text[at : at + n])
        at += n
    return out


@pytest.mark.parametrize("text", ["", "a", "aaaaaaa", "abracadabra abracadabra", "é漢\U0001f600é漢é漢\U0001f600"])
def test_parse_is_lempel_ziv(text):
    for cut in range(len(text) + 1):
        assert list(fp.Parse().feed(text[:cut]).copy().feed(text[cut:]).phrases) == phrases(text)


def test_hash_depends_on_the_phrase_alone():
    a = fp.phrase_hashes("xxabyab", np.array([2, 2, 1, 2]))
    assert a[1] == a[3] and len(set(a.tolist())) == 3
    b = fp.phrase_hashes("ab", np.array([2]))
    assert b[0] == a[1]


def test_estimates_the_jaccard_of_phrase_sets():
    rng = np.random.default_rng(1)
    error = []
    for share in (0.1, 0.5, 0.9):
        for _ in range(20):
            n = 1500
            h = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2)
            k = int(n * share)
            a, b = h[:n], np.concatenate((h[:k], h[n : 2 * n - k]))
            error.append(fp.likeness(fp.signature(a), fp.signature(b)) - k / (2 * n - k))
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.08


def test_table_equals_a_direct_reading(spark):
    rows = ODD + [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id > 9").select("doc_id", "text").collect()]
    rows = [r for i, r in enumerate(rows) if r not in rows[:i]]  # equal rows tie, which has its own test
    got = {r.doc_id: r for r in fp.fingerprint_documents(docs(spark, rows, extra=True).repartition(7)).collect()}
    ring = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(rows)
    prints = {}
    for (i, t), (_, n) in zip(ring, ring[1:] + ring[:1]):
        t, n = t or "", n or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + n[:m]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, e, f = fp.fingerprint(t), fp.fingerprint(edited), fp.fingerprint(n)
        assert (r.fingerprint, r.edited_fingerprint) == (a.hex(), e.hex())
        assert (r.near_edited, r.near_next) == (fp.likeness(a, e), fp.likeness(a, f))
        prints.setdefault(t, set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    long = [r for r in got.values() if r.n_chars > 1000]
    assert np.mean([r.near_edited - r.near_next for r in long]) > 0.2


def test_repeated_rows_and_few_rows(spark):
    assert fp.fingerprint_documents(docs(spark, [])).count() == 0
    (one,) = fp.fingerprint_documents(docs(spark, [(1, "abcd efgh")])).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()
    assert len(fp.fingerprint_documents(docs(spark, [(1, "same text")] * 5)).collect()) == 5

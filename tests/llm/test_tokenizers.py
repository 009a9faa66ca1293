import hashlib
import struct

import pytest

from quarrymill.llm import sentencepiece_codec as sc
from quarrymill.llm import token_counts as tc
from quarrymill.llm.common import scratch_path
from quarrymill.llm.queries import tokenizer_path

from .util import ODD, docs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    path = tokenizer_path(name)
    rows = ODD + [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = tc.count_tokens(docs(spark, rows, extra=True), path, scratch_path(spark, "cache"), limit=100).collect()
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), n := count(t or ""), n > 100) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_cache_encodes_only_misses(spark):
    path, cache = tokenizer_path("word_bpe_49k.json"), scratch_path(spark, "cache")
    a = docs(spark, [(1, "a b"), (2, "a  b"), (3, None)])
    tc.fill_cache(a, path, cache)
    assert spark.read.parquet(cache).count() == 2  # blank runs are one content
    tc.fill_cache(docs(spark, [(4, "a b"), (5, "new words")]), path, cache)
    assert spark.read.parquet(cache).count() == 3
    assert tc.count_tokens(docs(spark, []), path, cache).count() == 0
    kept = tc.with_token_counts(docs(spark, [(1, "a b")]).drop("n_chars"), path, cache, out_col="tokens")
    assert kept.columns == ["doc_id", "text", "lang", "source", "tokens"]


def test_encoding_equals_the_library_and_spans_cover_the_text(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = ODD + [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sc.encode_documents(docs(spark, rows, extra=True), path).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want[(i, hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())] = (ids, model.decode(ids), t or "")
    for r in got:
        ids, decoded, text = want[(r.doc_id, r.ids_sha256)]
        assert (r.ids, r.decoded, r.n_tokens) == (ids, decoded, len(ids))
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        raw = text.encode()
        assert r.span_begin[0] == 0 and r.span_end[-1] == len(raw)
        assert b"".join(raw[b:e] for b, e in zip(r.span_begin, r.span_end)) == raw
        proto = model.encode(text, return_type="proto").pieces
        whole = [(p.begin, p.end) for p in proto if not p.piece.startswith("<0x")]
        mine = [(b, e) for b, e, p in zip(r.span_begin[1:-1], r.span_end[1:-1], proto) if not p.piece.startswith("<0x")]
        assert mine == whole


def test_character_map_is_longest_prefix_with_alignment():
    n = sc.Normaliser({b"\xc3\xa9": b"e", b"ab": b"X", b"abc": b"YZ", b"\t": b" "}, True, True, True)
    text = "abcab é\t\tq".encode()
    out, origin = n(text)
    assert out.decode() == "▁YZX▁e▁q"
    assert origin.tolist() == [0, 0, 0, 0, 0, 3, 5, 5, 5, 6, 8, 8, 8, 10, 11] and len(text) == 11
    assert n(b"")[0] == b"" and n(b"   ")[0] == b""

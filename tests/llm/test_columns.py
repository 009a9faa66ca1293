"""Further columns with every name that the operators use inside are carried whole through the stages and column functions."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quarrymill.llm import common, quality, token_counts
from quarrymill.llm.queries import tokenizer_path

from .util import docs as some_docs

SF = "/root/testdata/sf0.001"
HERE = Path(common.__file__).parent
#: Every name in the operators' code that a column may have, without those of documents.
NAMES = sorted(
    {n for f in HERE.glob("*.py") if f.stem not in ("queries", "conversation_sql", "warc", "chat_format", "conversation_repair", "whitening") for n in re.findall(r'"([A-Za-z_][A-Za-z_0-9]{0,24})"', f.read_text())}
    - {"doc_id", "text", "lang", "source", "n_chars", "__others"}
)
ROWS = [(i, f"a text of some words number {i % 7} " + "with more that is the same in all of them and long enough to be a window " * (i % 3)) for i in range(20)] + [(None, "x"), (3, None)]


@pytest.fixture(scope="module")
def clashing(spark):
    df = some_docs(spark, ROWS)
    lower, seen = [], set()
    for n in NAMES:
        if n.lower() not in seen:
            seen.add(n.lower())
            lower.append(n)
    assert {"__d", "__turn", "__doc", "__nth", "__gone", "__text_key", "__label", "__n_tokens", "__content_digest", "__salt", "__rows", "__hot"} <= set(lower)
    extra = [F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")).alias(n) for n in lower]
    return df.select("*", *extra, F.create_map(F.lit("k"), "doc_id").alias("__others"), F.struct("doc_id").alias("a.b"))


def kept_right(out, df):
    """The columns of df, each row's further values its own."""
    names = [c for c in df.columns if c not in ("doc_id", "text", "lang", "source", "n_chars", "__others", "a.b")]
    assert out.columns[: len(df.columns)] == df.columns
    told = out.select("doc_id", *[F.col(f"`{c}`") for c in names], "__others", F.col("`a.b`.doc_id").alias("z")).collect()
    for r in told:
        assert all(r[c] == f"{c} {r.doc_id or 0}" for c in names) and r["__others"] == {"k": r.doc_id} and r.z == r.doc_id
    return Counter(r.doc_id for r in told)


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES[:-1]], ids=[n for n, _ in cp.STAGES[:-1]])
def test_stages(spark, clashing, stage):
    found = kept_right(stage(spark, clashing, SF), clashing)
    plain = some_docs(spark, ROWS)
    assert found == Counter(r.doc_id for r in stage(spark, plain, SF).select("doc_id").collect())


def test_last_stage(spark, clashing):
    assert cp.STAGES[-1][1](spark, clashing, SF).count() == len(ROWS)


def test_columns_added(spark, clashing, tmp_path):
    counted = token_counts.with_token_counts(clashing, tokenizer_path("word_bpe_49k.json"), f"file://{tmp_path}/cache", out_col="__new")
    assert kept_right(counted, clashing) and counted.columns[-1] == "__new" and counted.where("__new is null").isEmpty()
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    scored = quality.with_scores(clashing, quality.fit(clashing, labels), "__new")
    assert kept_right(scored, clashing) and scored.where("__new between 0 and 1").count() == len(ROWS)


def test_memos_hold_no_long_words():
    from quarrymill.llm import sentencepiece_codec, words

    long, texts = b"x" * 5000, [b"short words and " + b"x" * 5000, b"words"]
    hashes, buckets = words.WordHashes(), quality.Buckets()
    hashes.of(texts[0].split())
    quality.features(texts[0], buckets)
    counter, codec = token_counts._Counter(tokenizer_path("word_bpe_49k.json")), sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model"))
    first, ids = counter(texts), codec.encode([t.decode() for t in texts])
    assert counter(texts) == first and codec.encode([t.decode() for t in texts]) == ids
    for memo in (hashes, buckets, counter.memo):
        assert memo and long not in memo and max(map(len, memo)) <= common.LONGEST_KEPT
    assert codec.memo and max(map(len, codec.memo)) <= common.LONGEST_KEPT

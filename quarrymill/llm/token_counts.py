"""Token counts through a digest cache.

Texts are reduced to normalised content (null becomes empty; blank runs become one space where the tokenizer
itself collapses them), the content to a digest, and the digest together with the tokenizer version's digest is
joined to a cache table of counts. Only distinct contents that the cache lacks are encoded; their counts are
appended to the cache. The cache is a Parquet folder on shared storage, so a repeated run encodes nothing.

Defined results: null or empty text counts 0 tokens; repeated rows keep one row each and share one encoding; rows
with a null id keep their row; extra columns are ignored by `count_tokens` and kept by `with_token_counts`; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONGEST_KEPT, as_batch, carried, in_arrow, kept, materialise, null_free, path_exists, slices, spread_join, utf8_rows

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("content_digest", T.BinaryType()),
        T.StructField("tokenizer_version", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
#: Words remembered by one worker before it forgets them all; with LONGEST_KEPT a bound on memory, not on the result.
WORD_MEMO = 400_000


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library release that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library.__name__} {library.__version__}".encode()).hexdigest()


def _parts(node: dict | None, key: str) -> list[dict]:
    """A tokenizer file's component, with a Sequence opened up."""
    if not node:
        return []
    return node[key] if node.get("type") == "Sequence" else [node]


@lru_cache(maxsize=8)
def blank_rules(path: str) -> tuple[bool, bool]:
    """(blank runs are collapsed, words between blanks encode independently), read from the tokenizer's own file.

    The second holds if the normaliser collapses blank runs, no pre-token can hold a blank, and no added token
    holds one: then the count of a text is the sum of the counts of its words.
    """
    if path.endswith(".model"):
        return False, False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    collapse = any(
        x.get("type") == "Replace" and x["pattern"].get("Regex") == r"\s+" and x["content"] == " "
        for x in _parts(spec.get("normalizer"), "normalizers")
    )
    split = (_parts(spec.get("pre_tokenizer"), "pretokenizers") or [{}])[0]
    pattern = split.get("pattern", {}).get("Regex", " ")
    blankless = not re.search(r"\\[sSWDPH]|[ .]", pattern.replace(r"[^\s", "["))
    apart = (
        collapse
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and bool(split.get("invert"))
        and blankless
        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    )
    return collapse, apart


class _Counter:
    """Counts tokens of UTF-8 texts with the tokenizer's own library; one per worker process."""

    def __init__(self, path: str):
        self.words = blank_rules(path)[1]
        self.memo: dict[bytes, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.whole = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[bytes]) -> list[int]:
        if not self.words:
            return self.whole([t.decode("utf-8", "replace") for t in texts])
        memo = self.memo
        split = [t.split() for t in texts]
        fresh = list({w for words in split for w in words if w not in memo})
        if len(memo) + len(fresh) > WORD_MEMO:
            memo.clear()
            fresh = list({w for words in split for w in words})
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            memo.update(zip(part, self.whole([w.decode("utf-8", "replace") for w in part])))
        known = memo.__getitem__
        counts = [sum(map(known, words)) for words in split]
        for w in fresh:
            if len(w) > LONGEST_KEPT:
                del memo[w]
        return counts


def _counter(path: str) -> _Counter:
    return kept(f"counter {path}", lambda: _Counter(path))


def _content(docs: DataFrame, text_col: str, path: str):
    text = null_free(docs[text_col])
    return F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " ") if blank_rules(path)[0] else text


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text") -> DataFrame:
    """Encode the distinct contents of docs that the cache lacks, append their counts, and return this version's cache."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)

    def cached() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_version") == version)
        return rows.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    content = docs.select(_content(docs, text_col, tokenizer_path).alias("content"))
    distinct = content.select(F.unhex(F.sha2("content", 256)).alias("content_digest"), "content").dropDuplicates(["content_digest"])
    if path_exists(spark, cache_path):
        distinct = distinct.join(cached(), "content_digest", "left_anti")
    schema = pa.schema([("content_digest", pa.binary()), ("tokenizer_version", pa.string()), ("n_tokens", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path)
        for batch in slices(batches, 500):
            counts = count(utf8_rows(batch.column("content")))
            yield as_batch(schema, [batch.column("content_digest").cast(pa.binary()), [version] * len(counts), counts])

    distinct.transform(in_arrow, encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    return cached()


def with_token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """docs with `out_col`: tokens of the whole text, without begin, end or added special tokens."""
    return carried(docs, {"doc_id", text_col}, lambda d: _with_token_counts(d, tokenizer_path, cache_path, text_col, out_col))


def _with_token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str, out_col: str) -> DataFrame:
    cache = fill_cache(docs, tokenizer_path, cache_path, text_col)
    key, count = "__content_digest", "__n_tokens"
    counts = cache.select(F.col("content_digest").alias(key), F.col("n_tokens").alias(count))
    keyed = docs.withColumn(key, F.unhex(F.sha2(_content(docs, text_col, tokenizer_path), 256)))
    return _with_counts(keyed, counts, key, count).withColumn(out_col, F.col(count)).drop(key, count)


def _with_counts(keyed: DataFrame, counts: DataFrame, key: str, count: str) -> DataFrame:
    """keyed with its counts; contents that many documents share are spread over tasks. A content without a count is an error."""
    rows = "__rows"
    sized = materialise(counts.join(keyed.groupBy(key).agg(F.count(F.lit(1)).alias(rows)), key), "token-counts")
    lost = F.raise_error(F.lit("the cache lacks the count of a content")).cast("long")
    spread_by = F.col("doc_id") if "doc_id" in keyed.columns else F.monotonically_increasing_id()
    return spread_join(keyed, sized, [key], rows, spread_by, "left").drop(rows).withColumn(count, F.coalesce(F.col(count), lost))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more tokens than limit)."""
    sized = docs.select("doc_id", F.octet_length(null_free("text")).cast("long").alias("n_bytes"), F.unhex(F.sha2(_content(docs, "text", tokenizer_path), 256)).alias("content_digest"))
    cache = fill_cache(docs.select("text"), tokenizer_path, cache_path)
    return _with_counts(sized, cache, "content_digest", "n_tokens").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

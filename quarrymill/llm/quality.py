"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text becomes term counts: its words hashed into buckets, plus shape terms (bands of repetition, line repetition,
symbol share, word length and size), weighted by log count and inverse document frequency. The weighted matrix of a
bounded training sample is decomposed (truncated SVD); the sample's latent vectors, with labels, go to every task.
Each document is projected, its cosine to every labelled vector computed exactly in blocks, and the labels of its
nearest neighbours are averaged with the similarities as weights.

The sample is at most `max_labelled` rows, evenly from each label as far as there are rows (votes are reweighted to
the labels' shares), chosen by a hash of doc_id; it is the one bounded quantity here.

Defined results: null, empty and blank texts have shape terms only and are scored like any other; a document is
scored whether or not it has a label, an id, or repeats; labels other than 0 and 1, and null ids, don't teach; a doc_id
with several rows or labels teaches with each; no labelled row at all gives the score 0.5; extra columns are ignored by `score_documents` and kept by `with_scores`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import LONGEST_KEPT, as_batch, carried, in_arrow, kept, slices, utf8_rows

WORD_BUCKETS = 4096
#: Upper edges of the bands of each shape quantity.
BANDS = {
    "size": [1, 5, 15, 40, 100, 300, 1000, 3000],
    "distinct": [0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 0.95],
    "top_word": [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7],
    "line_repeat": [0.01, 0.05, 0.15, 0.3, 0.5, 0.75],
    "symbols": [0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.4],
    "digits": [0.005, 0.02, 0.05, 0.1, 0.25],
    "capitals": [0.01, 0.03, 0.06, 0.12, 0.25, 0.5],
    "word_length": [2, 3, 4, 5, 6, 8, 12],
    "line_words": [2, 5, 10, 20, 60],
    "stops": [0.01, 0.03, 0.06, 0.1, 0.2],
}
_OFFSETS = dict(zip(BANDS, np.cumsum([0, *(len(b) + 1 for b in BANDS.values())])[:-1] + WORD_BUCKETS))
TERMS = WORD_BUCKETS + sum(len(b) + 1 for b in BANDS.values())
#: Weight of a shape term against a word seen once.
SHAPE_WEIGHT = 3.0
#: Rows of the sample that are dense at once while the driver decomposes it.
DENSE_ROWS = 512
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_CLASSES[48:58] = 2
_CLASSES[65:91] = 3


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        b = zlib.crc32(word) % WORD_BUCKETS
        if len(word) <= LONGEST_KEPT:
            self[word] = b
        return b


def features(text: bytes, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers, log-scaled counts) of one text."""
    words = text.lower().split()
    if len(buckets) > 400_000:
        buckets.clear()
    counts = np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), minlength=WORD_BUCKETS)
    terms = np.flatnonzero(counts)
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=4) / max(1, len(text))
    seen = set(words)
    shape = {
        "size": len(words), "distinct": len(seen) / n, "top_word": counts.max() / n, "line_repeat": 1 - len(set(lines)) / max(1, len(lines)),
        "symbols": kinds[1], "digits": kinds[2], "capitals": kinds[3], "word_length": sum(map(len, seen)) / max(1, len(seen)), "line_words": n / max(1, len(lines)),
        "stops": sum(x[-1:] in b".!?" for x in words) / n,
    }
    bands = [_OFFSETS[k] + int(np.searchsorted(BANDS[k], v)) for k, v in shape.items()]
    return np.concatenate((terms, bands)), np.concatenate((np.log1p(counts[terms]), np.full(len(bands), SHAPE_WEIGHT))).astype(np.float32)


@dataclass
class Neighbours:
    """The fitted model: bounded by the sample, never by the corpus."""

    projection: np.ndarray  # terms x rank, inverse document frequencies included
    vectors: np.ndarray  # sample x rank, unit length
    labels: np.ndarray
    weights: np.ndarray
    k: int

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        latent = np.stack([values @ self.projection[terms] for terms, values in rows])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        cosine = latent @ self.vectors.T
        k = min(self.k, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, 1), 0.0) ** 4 * self.weights[near] + 1e-9
        return (vote * self.labels[near]).sum(1) / vote.sum(1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, shares: np.ndarray, rank: int, k: int) -> Neighbours:
    """shares: of all labelled rows, by label; neighbours of a label that the sample favours weigh less.

    The weighted matrix is never held whole: products with it are made from DENSE_ROWS rows at a time.
    """
    frequency = np.zeros(TERMS, np.int64)
    for terms, _ in rows:
        frequency += np.bincount(terms, minlength=TERMS)
    idf = np.log((1 + len(rows)) / (1 + frequency)).astype(np.float32) + 0.1
    room = np.zeros((min(DENSE_ROWS, len(rows)), TERMS), np.float32)

    def blocks() -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, len(rows), DENSE_ROWS):
            x = room[: len(rows) - at]
            x[:] = 0
            for i, (terms, values) in enumerate(rows[at : at + DENSE_ROWS]):
                x[i, terms] = values * idf[terms]
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            yield slice(at, at + len(x)), x

    def times(y: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ y for _, x in blocks()])

    def transposed_times(y: np.ndarray) -> np.ndarray:
        return sum(x.T @ y[rows_of] for rows_of, x in blocks())

    rng = np.random.default_rng(0)
    rank = min(rank, len(rows))
    q = np.linalg.qr(times(transposed_times(rng.standard_normal((len(rows), rank + 8)).astype(np.float32))))[0]
    for _ in range(3):
        q = np.linalg.qr(times(transposed_times(q)))[0]
    _, s, vt = np.linalg.svd(transposed_times(q).T, full_matrices=False)
    components = vt[:rank].T
    balance = np.bincount(labels, minlength=2) / len(labels)
    weights = (shares / np.maximum(balance, 1e-9))[labels]
    return Neighbours((components * idf[:, None]).astype(np.float32), _unit(times(components)).astype(np.float32), labels.astype(np.float32), weights.astype(np.float32), k)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """A column of lists as numpy views, no number as a Python object."""
    made = []
    for chunk in column.chunks:
        flat, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        made += [flat[a:b] for a, b in zip(at, at[1:])]
    return made


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", teaches: Column | None = None, max_labelled: int = 6000, rank: int = 64, k: int = 15) -> Neighbours | None:
    """Fit on at most max_labelled labelled rows; None where no row teaches."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (F.lit(True) if teaches is None else teaches))
    totals = {r[0]: r[1] for r in usable.groupBy(target).count().collect()}
    if not totals:
        return None
    half = max_labelled // 2
    parts = []
    for label in (0, 1):
        room = half + max(0, half - totals.get(1 - label, 0))
        one = usable.where(F.col(target) == label).select(F.col("doc_id").alias("__id"), F.col(target).cast("int").alias("__label"))
        parts.append(one.orderBy(F.xxhash64("__id"), "__id").limit(room))
    chosen = parts[0].unionByName(parts[1])  # at most max_labelled rows of two numbers
    spec = "by_id long, by_text long, label int, terms array<int>, counts array<float>"
    schema = pa.schema([("by_id", pa.int64()), ("by_text", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in slices(batches, 500):
            made = [features(t, buckets) for t in utf8_rows(batch.column("text"))]
            yield as_batch(schema, [batch.column("by_id"), batch.column("by_text"), batch.column("label"), [t.astype(np.int32) for t, _ in made], [v for _, v in made]])

    # a doc_id that repeats adds rows: of all of them the first by the hashes of id and text are taken, whatever task they come from
    taught = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    keyed = taught.select(F.xxhash64("doc_id").alias("by_id"), F.xxhash64("text").alias("by_text"), F.col("__label").alias("label"), "text")
    found = keyed.transform(in_arrow, run, spec).orderBy("by_id", "by_text", "label").limit(2 * max_labelled).toArrow()
    if not found.num_rows:
        return None
    rows = list(zip(_lists(found.column("terms")), _lists(found.column("counts"))))
    y = found.column("label").to_numpy().astype(np.int64)
    order = sorted(range(len(rows)), key=lambda i: (zlib.crc32(rows[i][0].astype(np.int64).tobytes() + rows[i][1].tobytes()), int(y[i])))  # the same model whatever order the tasks end in
    shares = np.array([totals.get(0, 0), totals.get(1, 0)], float) / sum(totals.values())
    return train([rows[i] for i in order], y[order], shares, rank, k)


def with_scores(docs: DataFrame, model: Neighbours | None, out_col: str = "score") -> DataFrame:
    """docs with out_col, the weighted share of neighbours labelled 1 (0 to 1); it replaces a column of that name."""
    docs = docs.drop(out_col)
    if model is None:
        return docs.withColumn(out_col, F.lit(0.5))
    return carried(docs, {"doc_id", "text"}, lambda d: _scored(d, model, out_col))


def _scored(docs: DataFrame, model: Neighbours, out_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # terms x rank and max_labelled x rank floats
    made = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])
    schema = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = kept("quality words", Buckets)
        for batch in slices(batches, 256):
            score = sent.value.score([features(t, buckets) for t in utf8_rows(batch.column("text"))]) if batch.num_rows else []
            yield as_batch(schema, [*(batch.column(i).cast(schema.field(i).type) for i in range(batch.num_columns)), np.clip(np.asarray(score, float), 0, 1)])

    return docs.transform(in_arrow, run, made)


def held_out(doc_id: Column | str, parts: int, part: int) -> Column:
    """Rows whose crc32(doc_id as text) leaves this remainder; false for null ids."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % parts == part, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, target: str = "quality", parts: int = 4, part: int = 2, threshold: float = 0.7, **fitting: int) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Held-out rows never teach."""
    model = fit(docs.select("doc_id", "text"), labels, target, ~held_out("doc_id", parts, part), **fitting)
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

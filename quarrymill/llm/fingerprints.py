"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each the shortest prefix of the rest that is not yet in the dictionary);
the set of phrases is hashed, and a one-permutation minimum-hash signature of it is the fingerprint. Two texts that
compress each other well share phrases, so the share of equal minima estimates a compression-like similarity.

Phrases partition the text, so only phrase lengths come from the parsing loop; phrase hashes come from prefix hashes
of the code points, vectorised. Texts meet their successor by one range partitioning on (doc_id, text): within a
task the rows stream, holding one predecessor; the few rows at partition edges meet in a second, small step.

Defined results: null and empty texts have the empty set's fingerprint, alike 1.0 to itself and 0.0 to all others;
equal texts have equal fingerprints; rows follow doc_id, rows without an id last, ties by the text's hash; a single
row is its own successor; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, as_batch, in_arrow, materialise, mix64, null_free, slices, utf8_rows

#: Bins of a signature, 16 bits each.
BINS = 64
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


class _Powers:
    """Powers of BASE and of its inverse, modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(BASE, k, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(INVERSE, k, 1 << 64))))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Parse:
    """Dictionary of phrases in the order found, and the phrase begun."""

    __slots__ = ("phrases", "begun")

    def __init__(self, phrases: dict[str, None] | None = None, begun: str = ""):
        self.phrases, self.begun = phrases if phrases is not None else {}, begun

    def feed(self, text: str) -> "Parse":
        phrases, phrase = self.phrases, self.begun
        for c in text:
            phrase += c
            if phrase not in phrases:
                phrases[phrase] = None
                phrase = ""
        self.begun = phrase
        return self

    def copy(self) -> "Parse":
        return Parse(self.phrases.copy(), self.begun)


def phrase_hashes(text: str, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the consecutive phrases of these lengths."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text[: ends[-1]].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    up, down = _POWERS.to(len(codes))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up, dtype=np.uint64)))
    starts = ends - lengths
    return mix64((prefix[ends] - prefix[starts]) * down[starts] ^ (lengths.astype(np.uint64) << np.uint64(48)))


def signature(hashes: np.ndarray) -> bytes:
    """BINS minima of 16 bits: each bin's least hash; an empty bin takes the next filled one's, moved by the distance."""
    if not len(hashes):
        return b"\0" * (2 * BINS)
    ordered = np.sort(hashes)
    bins, first = np.unique((ordered >> np.uint64(58)).astype(np.int64), return_index=True)
    wanted = np.arange(BINS)
    source = np.searchsorted(bins, wanted) % len(bins)
    gap = (bins[source] - wanted) % BINS
    least = mix64(ordered[first][source] + gap.astype(np.uint64))
    return np.maximum((least & np.uint64(0xFFFF)).astype("<u2"), 1).tobytes()


def fingerprint(text: str, parse: Parse | None = None) -> bytes:
    parse = parse or Parse().feed(text)
    lengths = np.fromiter(map(len, parse.phrases), np.int64, len(parse.phrases))
    return signature(phrase_hashes(text, lengths))


def likeness(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
    return float((x == y).mean())


class _Row:
    """A document with its fingerprint and the parse of the part that its edit keeps."""

    __slots__ = ("doc_id", "text", "cut", "kept", "print")

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.cut = len(text) - len(text) // 4
        parse = Parse().feed(text[: self.cut])
        self.kept = parse.copy()
        self.print = fingerprint(text, parse.feed(text[self.cut :]))

    def finish(self, following: str, following_print: bytes) -> tuple:
        tail = following[: len(self.text) - self.cut]
        edited = self.text[: self.cut] + tail
        edited_print = fingerprint(edited, self.kept.feed(tail))
        return (
            self.doc_id, len(self.text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), self.print.hex(), edited_print.hex(),
            likeness(self.print, edited_print), likeness(self.print, following_print),
        )


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SPEC = f"kind int, part int, text string, {COLUMNS}"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
_FULL = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in _SPEC.split(", ")])
_DONE = pa.schema(list(_FULL)[3:])
#: Kinds of rows in the first step: finished, first of its partition, last of its partition.
DONE, HEAD, LAST = 0, 1, 2


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per document the columns of COLUMNS; the edit replaces a quarter of a text by its successor's beginning."""
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_free("text").alias("text"))
    ranged = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for batch in slices(batches, 500):
            out = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), utf8_rows(batch.column("text"))):
                row = _Row(doc_id, raw.decode("utf-8", "replace"))
                if held is None:
                    out.append((HEAD, part, row.text, None, None, None, row.print.hex(), None, None, None))
                else:
                    out.append((DONE, part, None, *held.finish(row.text, row.print)))
                held = row
            if out:
                yield as_batch(_FULL, list(zip(*out)))
        if held is not None:
            yield as_batch(_FULL, [[x] for x in (LAST, part, held.text, held.doc_id, None, None, None, None, None, None)])

    made = materialise(ranged.transform(in_arrow, run, _SPEC), "fingerprints")
    done = made.where(F.col("kind") == DONE).select(*_DONE.names)
    parts = sorted(r.part for r in made.where(F.col("kind") == HEAD).select("part").collect())  # one number a partition
    if not parts:
        return done
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    heads = made.where(F.col("kind") == HEAD).select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    edges = made.where(F.col("kind") == LAST).select("part", "doc_id", "text").join(following, "part").join(heads, "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("doc_id", "text", "next_text", "next_print")]
            out = [_Row(i, t).finish(n, bytes.fromhex(p)) for i, t, n, p in zip(*columns)]
            if out:
                yield as_batch(_DONE, list(zip(*out)))

    return done.unionByName(edges.transform(in_arrow, close, COLUMNS))

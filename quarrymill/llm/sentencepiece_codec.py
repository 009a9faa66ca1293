"""Offset-preserving SentencePiece encoding and decoding.

The text is normalised by longest-prefix lookup through the model's compiled character map while each normalised
byte keeps the original byte it came from; pieces are then projected onto original byte spans through that
alignment. Piece ids are the library's own: since no piece of a vocabulary with word-initial marks holds the mark
after another character (verified when the model is loaded), merges never cross from a character to a following
mark, so chunks between marks encode independently and repeated chunks are encoded once per worker. Models that
fail the verification are encoded text by text.

Defined results: null and empty texts give only the begin and end ids and decode to ""; repeated rows give repeated
rows; ids may be null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import LONGEST_KEPT, as_batch, in_arrow, kept, slices, utf8_rows

MARK = "▁"
#: Chunks remembered by one worker before it forgets them all; with LONGEST_KEPT a bound on memory, not on the result.
CHUNK_MEMO = 300_000


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, message[at : at + size]
            at += size


def read_character_map(blob: bytes) -> dict[bytes, bytes]:
    """All rules of a compiled map: a double-array trie of source strings, then zero-ended replacements."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = struct.unpack_from(f"<{size // 4}I", blob, 4)
    replacements = blob[4 + size :]
    rules: dict[bytes, bytes] = {}
    offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
    pending = [(offset(units[0]), b"")]
    while pending:
        base, prefix = pending.pop()
        for byte in range(1, 256):
            at = base ^ byte
            if at >= len(units) or units[at] & ((1 << 31) | 0xFF) != byte:
                continue
            unit, key = units[at], prefix + bytes([byte])
            child = at ^ offset(unit)
            if unit >> 8 & 1:
                start = units[child] & 0x7FFFFFFF
                rules[key] = replacements[start : replacements.index(b"\0", start)]
            pending.append((child, key))
    return rules


class Normaliser:
    """Longest-prefix normalisation with alignment, by a model's normaliser settings."""

    def __init__(self, rules: dict[bytes, bytes], dummy_prefix: bool, squeeze: bool, escape: bool):
        self.rules, self.dummy_prefix, self.squeeze = rules, dummy_prefix, squeeze
        self.blank = MARK.encode() if escape else b" "
        starts: dict[int, int] = {}
        for key in rules:
            starts[key[0]] = max(starts.get(key[0], 0), len(key))
        self.starts = starts
        # (?s:.) steps over one byte that no rule starts at
        self.finder = re.compile(b"|".join(map(re.escape, sorted(rules, key=len, reverse=True)))) if rules else None

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not self.finder:
            return text, np.arange(len(text) + 1, dtype=np.int64)
        out, origin, last = [], [], 0
        for m in self.finder.finditer(text):
            if m.start() > 0 and text[m.start()] & 0xC0 == 0x80:
                continue  # not a character's first byte
            new = self.rules[m.group()]
            out += [text[last : m.start()], new]
            origin += [np.arange(last, m.start()), np.full(len(new), m.start())]
            last = m.end()
        out.append(text[last:])
        origin.append(np.arange(last, len(text) + 1))
        return b"".join(out), np.concatenate(origin).astype(np.int64)

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, the original byte each came from plus one closing entry)."""
        if not text:
            return b"", np.zeros(1, np.int64)
        mapped, origin = self._mapped(text)
        if self.squeeze:
            raw = np.frombuffer(mapped, np.uint8)
            blank = raw == 0x20
            keep = ~(blank & np.concatenate(([True], blank[:-1]))) if len(raw) else blank
            solid = np.flatnonzero(~blank)
            keep[(solid[-1] + 1 if len(solid) else 0) :] = False
            mapped, origin = raw[keep].tobytes(), np.append(origin[:-1][keep], origin[-1])
            if not mapped:
                return b"", origin[-1:]
        if self.dummy_prefix:
            mapped, origin = b" " + mapped, np.concatenate((origin[:1], origin))
        width = len(self.blank)
        if width > 1:
            raw = np.frombuffer(mapped, np.uint8)
            sizes = np.where(raw == 0x20, width, 1)
            origin = np.append(np.repeat(origin[:-1], sizes), origin[-1])
        return mapped.replace(b" ", self.blank), origin


class Codec:
    """A model's encoder and decoder; one per worker process."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            message = f.read()
        pieces, kinds, spec, byte_fallback = [], [], {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}, 0
        for field, value in _fields(message):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1])
                kinds.append(piece.get(3, 1))
            elif field == 2:
                byte_fallback = dict(_fields(value)).get(35, 0)
            elif field == 3:
                spec |= dict(_fields(value))
        self.normalise = Normaliser(read_character_map(spec[2]), bool(spec[3]), bool(spec[4]), bool(spec[5]))
        # normalised bytes a piece covers; byte pieces (kind 6) cover one, control pieces none
        self.covers = np.array([1 if k == 6 else 0 if k in (2, 3) else len(p) for p, k in zip(pieces, kinds)], np.int64)
        mark = MARK.encode()
        self.chunked = (
            not spec[2] and bool(spec[3]) and not spec[4] and bool(spec[5]) and bool(byte_fallback) and 4 not in kinds
            and not any(mark in p.lstrip(mark) for p in pieces)
        )
        self.memo: dict[str, bytes] = {}
        self.boundary = re.compile(f"(?<=[^ {MARK}]) ")
        self.plain = re.compile(f"  |{MARK}|^ | $")
        self.lone_mark = struct.pack("<I", model.piece_to_id(MARK))
        self.ends = (struct.pack("<I", model.bos_id()), struct.pack("<I", model.eos_id()))

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return self.boundary.split(text) if self.plain.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, without begin and end."""
        if not self.chunked:
            return [np.asarray(x, "<u4").tobytes() for x in self.model.encode(texts, num_threads=1)]
        memo = self.memo
        split = [self._chunks(t) for t in texts]
        fresh = list({c for chunks in split for c in chunks if c not in memo})
        if len(memo) + len(fresh) > CHUNK_MEMO:
            memo.clear()
            fresh = list({c for chunks in split for c in chunks})
        for chunk, ids in zip(fresh, self.model.encode(fresh, num_threads=1) if fresh else []):
            memo[chunk] = struct.pack(f"<{len(ids)}I", *ids) if chunk else self.lone_mark
        ids = [b"".join(map(memo.__getitem__, chunks)) for chunks in split]
        for c in fresh:
            if len(c) > LONGEST_KEPT:
                del memo[c]
        return ids

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last original byte of each id's piece."""
        normal, origin = self.normalise(text)
        ends = np.cumsum(self.covers[ids])
        if len(ends) and ends[-1] != len(normal):
            return self._library_spans(text)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return origin[starts], origin[ends]

    def _library_spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Unknown pieces cover a whole run, whose length only the library knows."""
        decoded = text.decode("utf-8", "replace")
        pieces = self.model.encode(decoded, return_type="proto").pieces  # its offsets are bytes
        return np.array([p.begin for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64)


def codec(path: str) -> Codec:
    """The worker's codec; what it kept for an earlier stage is dropped."""
    return kept(f"codec {path}", lambda: Codec(path))


ENCODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("span_begin", T.ArrayType(T.IntegerType())),
        T.StructField("span_end", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("spans_sha256", T.StringType()),
    ]
)
_ARROW = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.ArrayType(T.IntegerType()): pa.list_(pa.int32())}


def encode_documents(docs: DataFrame, model_path: str, columns: list[str] | None = None, begin_end: bool = True) -> DataFrame:
    """One row per document with the wanted columns of ENCODED (all by default).

    Begin and end ids have empty spans at the text's two ends. spans_sha256 digests the begin and end offsets as
    little-endian unsigned 32-bit pairs.
    """
    wanted = T.StructType([f for f in ENCODED if columns is None or f.name in columns])
    schema = pa.schema([(f.name, _ARROW[f.dataType]) for f in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        first, last = c.ends if begin_end else (b"", b"")
        for batch in slices(batches, 200):
            raw = utf8_rows(batch.column("text"))
            texts = [x.decode("utf-8", "replace") for x in raw]
            rows: dict[str, list] = {f.name: [] for f in ENCODED}
            body = c.encode(texts)
            full = [first + x + last for x in body]
            lists = [np.frombuffer(x, "<u4").tolist() for x in full]
            decoded = c.model.decode(lists, num_threads=1) if lists else []
            for text, ids, whole, back in zip(raw, body, full, decoded):
                begin, end = c.spans(text, np.frombuffer(ids, "<u4"))
                if begin_end:
                    begin, end = np.concatenate(([0], begin, [len(text)])), np.concatenate(([0], end, [len(text)]))
                pairs = np.stack((begin, end), 1).astype("<u4")
                rows["n_tokens"].append(len(whole) // 4)
                rows["ids_sha256"].append(hashlib.sha256(whole).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                rows["spans_sha256"].append(hashlib.sha256(pairs.tobytes()).hexdigest())
                if "span_begin" in schema.names:
                    rows["span_begin"].append(begin.tolist())
                if "span_end" in schema.names:
                    rows["span_end"].append(end.tolist())
            rows |= {"doc_id": batch.column("doc_id").cast(pa.int64()), "ids": lists, "decoded": decoded}
            yield as_batch(schema, [rows[n] for n in schema.names])

    return docs.select("doc_id", "text").transform(in_arrow, run, wanted)

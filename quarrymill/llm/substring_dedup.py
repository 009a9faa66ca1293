"""Substring deduplication with a count-min prefilter.

A window is `size` consecutive words of one document. Pass 1: every partition sketches how many documents hold each
window, as cells of a hash range; the sketches merge, block by block, into one map of the cells that two or more
documents touch. It overestimates, so a window it calls single is single. Pass 2: only windows whose cell is called
repeated are grouped exactly, by a 96-bit key. Before that grouping each task settles, from its own documents, every
window that has a smaller document among the FLUSH windows it holds, and packs a window's repeats inside one text into
one row; so one key has at most a row for each FLUSH windows of the corpus, however often it stands there. A window falls to the smallest doc_id that holds it; elsewhere its words are removed.

The sketch has `cells_per_window` cells for each window up to `max_sketch_bytes` bits of map; beyond that more
single windows pass the filter, which costs shuffle and never changes the result.

Defined results: null, empty and blank texts have no words; documents shorter than a window lose nothing; rows with
a null doc_id neither remove nor lose anything; rows that share a doc_id don't remove each other's words; repeated
rows each give a row; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import as_batch, carried, discard, in_arrow, kept, materialise, null_free, slices, utf8_rows
from .words import WordHashes, batch_windows, window_hashes

BLOCK_BITS = 20
#: Windows that a task gathers before it sketches or groups them; bounds its memory.
FLUSH = 1_000_000
#: Rows of an Arrow batch that a task returns.
OUT_ROWS = 100_000
#: A word with a sixth of a separator more: bytes of text for each window when the sketch is sized.
BYTES_A_WINDOW = 6


def sketch_bits(text_bytes: int, cells_per_window: int, max_sketch_bytes: int) -> int:
    """log2 of the sketch's cells."""
    wanted = math.ceil(math.log2(max(1, text_bytes // BYTES_A_WINDOW) * cells_per_window))
    return min(max(wanted, BLOCK_BITS), int(math.log2(max_sketch_bytes * 8)))


#: Cells for each window, at least, once the sketch is larger than one map.
CELLS_IN_TURNS = 4


def sketch_turns(text_bytes: int, cells_per_window: int, max_sketch_bytes: int) -> tuple[int, int]:
    """(log2 of the sketch's cells, turns in which tasks hold a part of it): one map as long as it has CELLS_IN_TURNS a window.

    A map that is too small for the table would call most windows repeated and group nearly all of them.
    """
    bits = sketch_bits(text_bytes, cells_per_window, max_sketch_bytes)
    more = math.ceil(math.log2(max(1, text_bytes // BYTES_A_WINDOW) * CELLS_IN_TURNS)) - bits
    return (bits + more, 1 << more) if more > 0 else (bits, 1)


def _planes(x: np.ndarray) -> bytes:
    """uint32 values with their low bytes first, then the next bytes and so on: small values leave runs of zeros."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def partition_sketches(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Rows (block, cells): a task's touched cells of one block, in order, twice where two of its documents touch it."""
    schema = pa.schema([("block", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, count, base = WordHashes(), [], 0, 0

        def flush() -> pa.RecordBatch:
            h, doc = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            h = h[np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))]  # once for each document
            cells = h >> np.uint64(64 - bits)
            keep = np.ones(len(cells), bool)
            keep[2:] = cells[2:] != cells[:-2]
            cells = cells[keep].astype(np.int64)
            block = cells >> BLOCK_BITS
            cuts = np.flatnonzero(np.diff(block)) + 1
            starts = np.concatenate(([0], cuts))
            parts = [_planes(np.diff(x & ((1 << BLOCK_BITS) - 1), prepend=0)) for x in np.split(cells, cuts)]
            return as_batch(schema, [block[starts].astype(np.int32), parts])

        for batch in slices(batches, 500):
            words, doc, _, at = batch_windows(hashes, utf8_rows(batch.column("text")), size)
            if len(doc):
                held.append((window_hashes(words, size)[at], doc + base))
                count += len(doc)
            base += batch.num_rows
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    return docs.select("text").transform(in_arrow, run, "block int, cells binary")


def merge_sketches(sketches: DataFrame, partitions: int = 64) -> DataFrame:
    """Rows (block, repeated): a zlib-compressed bit for each cell that documents touch twice or more."""
    schema = pa.schema([("block", pa.int32()), ("repeated", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                seen = counts.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint8))
                cells = np.cumsum(_unplaned(data).astype(np.int64))
                again = np.concatenate(([False], cells[1:] == cells[:-1]))
                once = cells[~again]
                seen[once] = np.minimum(seen[once] + 1, 2)
                seen[cells[again]] = 2
        for block, seen in counts.items():
            yield as_batch(schema, [[block], [zlib.compress(np.packbits(seen >= 2).tobytes(), 1)]])

    return sketches.repartition(partitions, "block").transform(in_arrow, run, "block int, repeated binary")


def _bit_map(bits: int, blocks: dict[int, bytes]) -> np.ndarray:
    """The merged sketch, unpacked."""
    out = np.zeros((1 << bits) // 8, np.uint8)
    width = (1 << BLOCK_BITS) // 8
    for block, data in blocks.items():
        out[block * width : (block + 1) * width] = np.frombuffer(zlib.decompress(data), np.uint8)
    return out


def repeated_starts(docs: DataFrame, size: int = 13, cells_per_window: int = 8, max_sketch_bytes: int = 128 << 20) -> DataFrame:
    """Rows (doc_id, text_key, starts, settled): where windows start that a document with a smaller doc_id holds too.

    starts lists single starts; settled holds more of them as little-endian uint32 arrays. text_key tells rows of one
    doc_id apart.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, turns = sketch_turns(total, cells_per_window, max_sketch_bytes)
    merged = merge_sketches(partition_sketches(docs, size, bits), max(64, (1 << bits - BLOCK_BITS) // 32))
    merged = materialise(merged, "repeated-sketch")
    docs = docs.withColumn("text_key", _text_key("text"))
    found = None
    for turn in range(turns):
        part = _turn_starts(docs, merged, size, bits, turns, turn)
        found = part if found is None else found.unionByName(part)
    discard(merged)
    if turns == 1:
        return found
    return found.groupBy("doc_id", "text_key").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "settled")])


def _turn_starts(docs: DataFrame, merged: DataFrame, size: int, bits: int, turns: int, turn: int) -> DataFrame:
    """Starts of the windows whose cells lie in one turn's part of the sketch. All copies of a window lie in one turn, so
    it is grouped there; the turn's rows and its map are gone before the next."""
    rows = _turn_rows(docs, merged, size, bits, turns, turn)
    same = Window.partitionBy("h", "g")
    found = rows.withColumn("least", F.min("doc_id").over(same)).where("settled is not null or least < doc_id")
    start = F.when(F.col("settled").isNull(), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    several = F.coalesce("settled", "more")
    found = found.groupBy("doc_id", F.shiftright("at", 32).alias("text_key")).agg(F.collect_list(start).alias("starts"), F.collect_list(several).alias("settled"))
    found = materialise(found, "repeated-starts")
    rows.sketch.destroy()  # the starts are kept, so no task needs the map again
    return found


def _turn_rows(docs: DataFrame, merged: DataFrame, size: int, bits: int, turns: int, turn: int) -> DataFrame:
    """The windows called repeated whose cells lie in one turn's part of the sketch, at most a map's bytes of it."""
    spark, blocks = docs.sparkSession, (1 << bits - BLOCK_BITS) // turns
    own = merged.where(F.col("block").between(turn * blocks, (turn + 1) * blocks - 1)) if turns > 1 else merged
    sketch = spark.sparkContext.broadcast({r.block - turn * blocks: bytes(r.repeated) for r in own.collect()})  # at most max_sketch_bytes
    width = bits - (turns - 1).bit_length()  # of a cell inside its turn's part
    name = f"repeated {uuid.uuid4().hex}"
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("more", pa.binary()), ("settled", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, count = WordHashes(), [], 0
        bit_map = kept(name, lambda: _bit_map(width, sketch.value))

        def flush() -> Iterator[pa.RecordBatch]:
            h, g, ids, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            if not len(h):
                return
            order = np.argsort(h, kind="stable")
            h, g, ids, at = h[order], g[order], ids[order], at[order]
            first = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
            least = np.minimum.reduceat(ids, np.flatnonzero(first))[np.cumsum(first) - 1]
            open_ = ids == least
            yield from _open_rows(schema, h[open_], g[open_], ids[open_], at[open_])
            ids, at = ids[~open_], at[~open_]
            if len(ids):
                order = np.lexsort((at, ids))
                ids, at = ids[order], at[order]
                key = at >> 32
                cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (key[1:] != key[:-1])) + 1
                lead = np.concatenate(([0], cuts))
                parts = [x.astype("<u4").tobytes() for x in np.split(at & 0xFFFFFFFF, cuts)]
                # a key that no window shares, so these rows pass the grouping alone
                spare = np.frombuffer(b"".join(xxhash.xxh64_digest(p + i.tobytes()) for p, i in zip(parts, ids[lead])), np.int64)
                yield as_batch(schema, [spare, np.zeros(len(parts), np.int32), ids[lead], key[lead] << 32, pa.nulls(len(parts), pa.binary()), parts])

        for batch in slices(batches, 500):
            raw = utf8_rows(batch.column("text"))
            words, doc, start, at = batch_windows(hashes, raw, size)
            if len(doc):
                h = window_hashes(words, size)[at]
                cell = h >> np.uint64(64 - bits)
                mine = (cell >> np.uint64(width)) == turn
                cell &= np.uint64((1 << width) - 1)
                hit = np.flatnonzero(mine & bit_map[(cell >> np.uint64(3)).astype(np.int64)] >> (7 - (cell & np.uint64(7)).astype(np.uint8)) & 1)
                if len(hit):
                    g = (window_hashes(words, size, 1)[at[hit]] >> np.uint64(32)).astype(np.uint32)
                    ids = np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False), np.int64)
                    keys = np.asarray(batch.column("text_key").to_numpy(zero_copy_only=False), np.int64)
                    held.append((h[hit], g, ids[doc[hit]], (keys[doc[hit]] << 32) | start[hit]))
                    count += len(hit)
            if count >= FLUSH:
                yield from flush()
                count = 0
        if held:
            yield from flush()

    rows = docs.transform(in_arrow, run, "h long, g int, doc_id long, at long, more binary, settled binary")
    rows.sketch = sketch
    return rows


def _open_rows(schema: pa.Schema, h: np.ndarray, g: np.ndarray, ids: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Undecided windows, sorted by h: one row for each window of a text; `more` has the starts of its repeats there.

    Rows go out in the documents' order: neighbours then share bytes, and the shuffle's compression finds them.
    """
    if not len(h):
        return
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (ids[1:] != ids[:-1]) | (at[1:] >> 32 != at[:-1] >> 32)))
    lead = np.flatnonzero(new)
    size = np.diff(lead, append=len(h))
    for single in (True, False):
        chosen = np.flatnonzero((size == 1) == single)
        chosen = chosen[np.lexsort((at[lead[chosen]], ids[lead[chosen]]))]
        for k in range(0, len(chosen), OUT_ROWS):
            part = chosen[k : k + OUT_ROWS]
            row = lead[part]
            more = pa.nulls(len(part), pa.binary()) if single else [(at[a + 1 : a + n] & 0xFFFFFFFF).astype("<u4").tobytes() for a, n in zip(row.tolist(), size[part].tolist())]
            yield as_batch(schema, [h[row].view(np.int64), g[row].view(np.int32), ids[row], at[row], more, pa.nulls(len(part), pa.binary())])


def _text_key(text: str):
    return F.xxhash64(null_free(text)).bitwiseAND(F.lit(0x7FFFFFFF))


def covered(n_words: int, size: int, starts: list[int] | None, settled: list[bytes] | None) -> np.ndarray:
    """Which words the windows starting there cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for x in [np.asarray(starts or [], np.int64), *(np.frombuffer(s, "<u4").astype(np.int64) for s in settled or [])]:
        np.add.at(edge, x, 1)
        np.add.at(edge, np.minimum(x + size, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def _apply(docs: DataFrame, found: DataFrame, made: T.StructType, fill: Callable[[pa.RecordBatch, list[bytes], list[tuple]], dict[str, list]]) -> DataFrame:
    """docs joined to their starts; `fill` makes the columns of `made` from the texts and their starts."""
    key, k, s, t = "__doc", "__text_key", "__starts", "__settled"
    left = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(k, _text_key("text"))
    right = found.select(F.col("doc_id").alias(key), F.col("text_key").alias(k), F.col("starts").alias(s), F.col("settled").alias(t))
    joined = left.join(right, [key, k], "left").drop(key, k)
    schema = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            starts = list(zip(batch.column(s).to_pylist(), batch.column(t).to_pylist()))
            new = fill(batch, utf8_rows(batch.column("text")), starts)
            yield as_batch(schema, [new[n] if n in new else batch.column(n).cast(schema.field(n).type) for n in schema.names])

    return joined.transform(in_arrow, run, made)


def kept_digests(docs: DataFrame, size: int = 13, **sketch: int) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the digest of the kept words joined by one space."""
    made = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def fill(batch: pa.RecordBatch, texts: list[bytes], starts: list[tuple]) -> dict[str, list]:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": []}
        for text, (a, b) in zip(texts, starts):
            words = text.split()
            gone = covered(len(words), size, a, b) if a or b else None
            kept = words if gone is None else [w for w, x in zip(words, gone.tolist()) if not x]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return out

    docs = docs.select("doc_id", "text")
    return _apply(docs, repeated_starts(docs, size, **sketch), made, fill)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def cut_repeats(docs: DataFrame, size: int = 13, **sketch: int) -> DataFrame:
    """docs with removed words, and the blanks after each, cut from text; documents left without a word are dropped.

    Documents that had no word to begin with stay as they are. n_chars, where there, follows the text.
    """
    return carried(docs, {"doc_id", "text", "n_chars"}, lambda d: _cut_repeats(d, size, **sketch))


def _cut_repeats(docs: DataFrame, size: int, **sketch: int) -> DataFrame:
    found = repeated_starts(docs, size, **sketch)
    gone_col = "__gone"
    made = T.StructType([*docs.schema.fields, T.StructField(gone_col, T.BooleanType())])

    def fill(batch: pa.RecordBatch, texts: list[bytes], starts: list[tuple]) -> dict[str, list]:
        out, gone = [], []
        for text, (a, b), was in zip(texts, starts, batch.column("text").is_null().to_pylist()):
            empty = False
            if a or b:
                spans = [m.span() for m in _WORD.finditer(text)]
                mask = covered(len(spans), size, a, b).tolist()
                empty = all(mask)
                text = text[: spans[0][0]] + b"".join(text[x:y] for (x, y), m in zip(spans, mask) if not m)
            out.append(None if was else text.decode("utf-8", "replace"))
            gone.append(empty)
        new = {"text": out, gone_col: gone}
        if "n_chars" in batch.schema.names:
            new["n_chars"] = pa.array([None if x is None else len(x) for x in out], pa.int64()).cast(batch.schema.field("n_chars").type)
        return new

    return _apply(docs, found, made, fill).where(f"not {gone_col}").drop(gone_col)

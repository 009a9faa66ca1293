"""Exact top-k search with a vector-approximation file.

A vector's integers are floor(scale * x). The approximation file is a table of blocks: up to `scan_block` vectors of one
length as one byte a component, the number of the cell it lies in (2**bits equal intervals between the block's least
and greatest value of the component). For each block of queries there are two steps.

Scan: tasks stream the approximation file, and nothing else. One matrix product over cell centres and one over half
widths bound each query's scores from both sides (the negated upper bound is the lower bound of the distance -score).
A vector stays a candidate while its upper bound reaches the k-th greatest lower bound, in its task and then overall.

Refine: the stored exact vectors meet the candidates by row number, and those of candidates alone go to their query, in
lower-bound order of the distance; a query stops taking them as soon as the k-th result is certain to beat every bound that is left.
Spark's readers can't fetch single rows, so the stored table is scanned once for each block of queries.

Queries go out in blocks of `query_block` (a bounded broadcast each); a table of queries of any size is a sequence of
such blocks. Candidates of a block are broadcast up to BROADCAST_CANDIDATES rows, and meet the vectors by a shuffle
beyond. Copies of one vector beyond the k + 1 smallest ids can't be in any result (ties go to the smaller id) and are
settled before the scan, so a vector that a third of all rows share costs k + 1 rows.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, as query or as
candidate; so do rows without an id; every finite component takes part, and products are exact at any size (scores are
ranked exactly and returned as the nearest long); only vectors of equal length are compared; ties go to the smaller
vec_id; a query finds all candidates if there are fewer than k; an id that is repeated appears once for each row (a
query's own rows are never its candidates); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_batch, in_arrow, materialise, scratch_path

RESULT = "query_id long, rank int, vec_id long, score long"
_RESULT = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
_CANDIDATE = pa.schema([("q", pa.int32()), ("rid", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
_BLOCK = pa.schema([("d", pa.int32()), ("rids", pa.binary()), ("ids", pa.binary()), ("least", pa.binary()), ("width", pa.binary()), ("cells", pa.binary())])
#: Rows (five numbers each) of a query block's candidates that go to every task.
BROADCAST_CANDIDATES = 1_000_000
#: Candidates that a task gathers before it drops those out of reach.
HELD = 1_000_000
LONG = (1 << 63) - 1


def sound_vectors(embeddings: DataFrame) -> DataFrame:
    """Rows (vec_id, vector) of the vectors that take part."""
    vector = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))


def _least_copies(vectors: DataFrame, copies: int) -> DataFrame:
    """vectors without the copies of one vector that `copies` smaller ids precede."""
    same = Window.partitionBy("vector").orderBy("vec_id")
    return vectors.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= copies).drop("copy")


def scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles; infinite where a finite x leaves the doubles."""
    with np.errstate(over="ignore"):
        return np.floor(vectors * float(scale))


def exact_scores(query: np.ndarray, vectors: np.ndarray, scale: float) -> list[int]:
    """Integer inner products of a query with vectors (one a row), whatever their size."""
    q, v = scaled(query, scale), scaled(vectors, scale)
    most = float(np.abs(q).max()) * float(np.abs(v).max(initial=0)) * len(q)
    if most < 2.0**52:
        return (v @ q).astype(np.int64).tolist()
    whole = lambda x, y: [int(b) if np.isfinite(b) else int(a) * int(scale) for a, b in zip(x.tolist(), y.tolist())]
    left = whole(query, q)
    return [sum(a * b for a, b in zip(left, whole(x, y))) for x, y in zip(vectors, v)]


# ---- the approximation file


def cells_of(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least value, cell width, cells) by component of integer vectors, one a row."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        least = x.min(0)
        width = (x.max(0) - least) / (1 << bits)
        cells = np.where(width > 0, (x - least) / width, 0)
    return least, width, np.nan_to_num(cells).clip(0, (1 << bits) - 1).astype(np.uint8)


def bounds(queries: np.ndarray, least: np.ndarray, width: np.ndarray, cells: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper bounds) of all scores, queries x vectors. What doubles can't hold is bounded by infinities."""
    size = np.abs(queries)
    with np.errstate(over="ignore", invalid="ignore"):
        middle = queries @ (least + (cells + 0.5) * width).T
        # half a cell, and what rounding can take off
        half = size @ (width / 2) + 1e-9 * (size @ np.maximum(np.abs(least), np.abs(least + width * (1 << bits)))) + 1e-6
        low, high = middle - half[:, None], middle + half[:, None]
    low[~np.isfinite(low)] = -np.inf
    high[~np.isfinite(high)] = np.inf
    return low, high


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length in a list column."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.values, np.float64)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def approximation_file(vectors: DataFrame, scale: float, bits: int, scan_block: int) -> DataFrame:
    """Rows of _BLOCK for rows (rid, vec_id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(parts: list) -> pa.RecordBatch:
            rids, ids, x = (np.concatenate(y) for y in zip(*parts))
            least, width, cells = cells_of(scaled(x, scale), bits)
            return as_batch(_BLOCK, [[x.shape[1]], *([y.tobytes()] for y in (rids, ids, least, width, cells))])

        for batch in batches:
            rids, ids = (np.asarray(batch.column(n).to_numpy(zero_copy_only=False), np.int64) for n in ("rid", "vec_id"))
            for rows, x in _by_length(batch.column("vector")):
                for at in range(0, len(rows), scan_block):
                    part = rows[at : at + scan_block]
                    parts = held.setdefault(x.shape[1], [])
                    if sum(len(y[0]) for y in parts) + len(part) > scan_block:
                        yield block(held.pop(x.shape[1]))
                        parts = held.setdefault(x.shape[1], [])
                    parts.append((rids[part], ids[part], x[at : at + scan_block]))
            if len(held) > 64:  # many lengths: don't hold a block of each
                yield from map(block, held.values())
                held = {}
        yield from map(block, held.values())

    return vectors.transform(in_arrow, run, "d int, rids binary, ids binary, least binary, width binary, cells binary")


class Candidates:
    """A task's candidates of queries of one length: numbers, row numbers and bounds, kept within reach of the k-th lower bound."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, bits: int):
        self.numbers, self.ids, self.queries, self.k, self.bits = numbers, ids, queries, k, bits
        self.best = np.full((len(ids), k), -np.inf)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def scan(self, rids: np.ndarray, ids: np.ndarray, least: np.ndarray, width: np.ndarray, cells: np.ndarray) -> None:
        low, high = bounds(self.queries, least, width, cells, self.bits)
        own = self.ids[:, None] == ids[None]
        low[own] = high[own] = -np.inf
        few = np.partition(low, max(0, low.shape[1] - self.k), axis=1)[:, -self.k :]
        both = np.concatenate((self.best, few), 1)
        self.best = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        q, v = np.nonzero((high >= self.best.min(1)[:, None]) & ~own)
        self.rows.append((q, rids[v], low[q, v], high[q, v]))
        self.count += len(q)
        if self.count > HELD:
            self.rows = [self.within()]
            self.count = len(self.rows[0][0])

    def within(self) -> tuple[np.ndarray, ...]:
        q, rids, low, high = (np.concatenate(x) for x in zip(*self.rows))
        keep = high >= self.best.min(1)[q]
        return q[keep], rids[keep], low[keep], high[keep]


def _scan(file: DataFrame, sent, k: int, bits: int) -> DataFrame:
    """Rows (q, rid, low, high) that may be among the best k of query q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Candidates] = {}
        for batch in batches:
            for d, rids, ids, least, width, cells in zip(*(c.to_pylist() for c in batch.columns)):
                if d in sent.value:
                    if d not in found:
                        found[d] = Candidates(*sent.value[d][:2], sent.value[d][3], k, bits)
                    at = lambda x, t: np.frombuffer(x, t)
                    found[d].scan(at(rids, np.int64), at(ids, np.int64), at(least, float), at(width, float), at(cells, np.uint8).reshape(-1, d))
        for c in found.values():
            q, rids, low, high = c.within()
            yield as_batch(_CANDIDATE, [c.numbers[q].astype(np.int32), rids, low, high])

    near = file.transform(in_arrow, run, "q int, rid long, low double, high double")
    # a task sends some k rows for each query; a candidate below the k-th lower bound of all tasks is out
    whole = Window.partitionBy("q").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return near.withColumn("kth", F.nth_value("low", k).over(whole)).where("kth is null or high >= kth").drop("kth", "low")


def _refine(near: DataFrame, sent, k: int, scale: float) -> DataFrame:
    """Rows (q, high, vec_id, vector) to the best k of each query, vectors taken in the order of their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {int(q): (int(i), v) for numbers, ids, vectors, _ in sent.value.values() for q, i, v in zip(numbers, ids, vectors)}
        now, best = None, []

        def close() -> pa.RecordBatch:
            return as_batch(_RESULT, [[queries[now][0]] * len(best), range(1, len(best) + 1), [i for _, i in best], [max(-LONG, min(LONG, -s)) for s, _ in best]])

        for batch in batches:
            q, high, ids = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("q", "high", "vec_id"))
            vectors = batch.column("vector")
            for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1) if len(q) else []:
                if now != int(q[part[0]]):
                    if best:
                        yield close()
                    now, best = int(q[part[0]]), []
                for at in range(0, len(part), 4 * k):
                    some = part[at : at + 4 * k]
                    if len(best) == k and float(high[some[0]]) < -best[-1][0]:
                        break  # certain: no bound that is left reaches the k-th score
                    rows = np.array(vectors.slice(int(some[0]), len(some)).to_pylist(), float)
                    best = sorted(best + [(-s, int(i)) for s, i in zip(exact_scores(queries[now][1], rows, scale), ids[some])])[:k]
        if best:
            yield close()

    return near.repartition("q").sortWithinPartitions("q", F.desc("high"), "vec_id").transform(in_arrow, run, RESULT)


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, bits: int = 8, query_block: int = 4096, scan_block: int = 1000) -> DataFrame:
    """Per query: query_id, rank from 1, vec_id, score: its k highest integer inner products."""
    spark = embeddings.sparkSession
    vectors = sound_vectors(embeddings)
    queries = vectors.where(is_query)
    total = queries.count()
    if not total:
        return spark.createDataFrame([], RESULT)
    exact = materialise(_least_copies(vectors, k + 1).withColumn("rid", F.monotonically_increasing_id()), "va-vectors")
    file = materialise(approximation_file(exact.select("rid", "vec_id", "vector"), scale, bits, scan_block), "va-file")
    # blocks by hash of the query ids, so each is bounded however many there are
    parts = -(-total // query_block)
    blocked = queries.distinct().withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    kept = scratch_path(spark, "va-found")
    for block in range(parts):
        rows = blocked.where(F.col("block") == block).select("vec_id", "vector").orderBy("vec_id").collect()
        by_length: dict[int, list] = {}
        for n, r in enumerate(rows):
            by_length.setdefault(len(r.vector), []).append((n, r.vec_id, r.vector))
        told = {}
        for d, x in by_length.items():
            numbers, ids, exact_queries = (np.array(y, t) for y, t in zip(zip(*x), (np.int32, np.int64, float)))
            told[d] = (numbers, ids, exact_queries, scaled(exact_queries, scale))
        sent = spark.sparkContext.broadcast(told)
        near = materialise(_scan(file, sent, k, bits), "va-near")
        if near.limit(BROADCAST_CANDIDATES + 1).count() <= BROADCAST_CANDIDATES:
            near = F.broadcast(near)
        part = _refine(exact.join(near, "rid").select("q", "high", "vec_id", "vector"), sent, k, scale)
        part.write.parquet(f"{kept}/block={block}")  # kept as they come, so the plan stays short however many blocks there are
        sent.destroy()
    return spark.read.schema(RESULT).parquet(kept).select(*_RESULT.names)

"""Exact n-gram Jaccard join in the metric space of shingle sets (distance 1 - Jaccard).

Equal sets are one class. Two documents of different classes that link at `threshold` must share one of the
(1 - threshold) * size + 1 rarest shingles of each, under any one order of shingles. So the first level of regions has
single shingles as pivots: a class lies in the regions of its rarest shingles as far as that window reaches. Rarity
comes from a sketch of how many documents hold a shingle (see substring_dedup); a shingle that the sketch calls single
opens no region, and any error of the sketch changes cost alone. Regions that share classes form clusters.

A cluster is joined by recursion: documents of it are drawn as pivots, far from each other, until all members are near
one; each member falls to its nearest pivot's Voronoi region, and is replicated to every pivot within twice the join
radius of that distance (by the triangle inequality its partners' regions are among them); regions are joined in turn.
The members of one pivot's region are walked in order of their distance to it, and meet only those whose distance
differs by the radius at most, by exact intersection counts. Clusters that fit a task recurse inside one; larger ones
are dealt out by pivots across the cluster first, and a region that pivots can't divide (its members lie all alike far
from each other) is dealt into pairs of blocks.

Defined results: null, empty and blank texts have no shingle, and link with nothing, not even each other; a text
shorter than the shingle is one shingle; rows that share a doc_id are one document, linked by it; rows with a null
doc_id get a null component and link with nothing; repeated rows each give a row; extra columns are ignored by
`jaccard_components` and kept by `keep_one`; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_batch, carried, discard, in_arrow, kept, materialise, null_free, passing, slices, spread_join, utf8_rows
from .components import components
from .substring_dedup import BLOCK_BITS, _planes, _unplaned, sketch_bits
from .words import WordHashes, list_windows, window_hashes

FLUSH = 1_000_000
#: A region is joined in one task up to so many members and shingles; larger ones are dealt out.
TASK_MEMBERS, TASK_SHINGLES = 1000, 4_000_000
#: Members of a region that are compared directly; a larger region is divided by pivots.
LEAF = 8
#: Members of a block of one pivot's region.
BLOCK = 64
#: Pivots of a region, at most; none is drawn once all members are within NEAR radii of one.
PIVOTS, NEAR = 16, 3
#: Regions of at most so many classes pair them, by size and signature; in larger ones all go with the least.
PAIRED = 12
#: Cluster members of at most this number go to every task (three short values each); more meet their texts by a shuffle.
BROADCAST_MEMBERS = 1_000_000


# ---- shingle sets


def shingle_sets(hashes: WordHashes, texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of all distinct shingles, ordered by both; A-Z lower-cased, whole texts."""
    lists = [t.lower().split() for t in texts]
    words, doc, _, at = list_windows(hashes, lists, size)
    h = window_hashes(words, size)[at]
    short = [(i, w) for i, w in enumerate(lists) if 0 < len(w) < size]
    if short:
        extra = np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=len(w)) for _, w in short], np.uint64)
        doc, h = np.concatenate((doc, [i for i, _ in short])), np.concatenate((h, extra))
    order = np.lexsort((h, doc))
    doc, h = doc[order].astype(np.int64), h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _document_sketches(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Rows (block, cells): cells that a task's documents touch, twice where two or more do."""
    schema = pa.schema([("block", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, count = WordHashes(), [], 0

        def flush() -> pa.RecordBatch:
            cells = np.sort(np.concatenate(held))
            keep = np.ones(len(cells), bool)
            keep[2:] = cells[2:] != cells[:-2]
            cells = cells[keep].astype(np.int64)
            block = cells >> BLOCK_BITS
            cuts = np.flatnonzero(np.diff(block)) + 1
            parts = [_planes(np.diff(x & ((1 << BLOCK_BITS) - 1), prepend=0)) for x in np.split(cells, cuts)]
            return as_batch(schema, [block[np.concatenate(([0], cuts))].astype(np.int32), parts])

        for batch in slices(batches, 500):
            h = shingle_sets(hashes, utf8_rows(batch.column("text")), size)[1]
            if len(h):
                held.append(h >> np.uint64(64 - bits))
                count += len(h)
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    return docs.select("text").transform(in_arrow, run, "block int, cells binary")


def _merge_levels(sketches: DataFrame, partitions: int = 64) -> DataFrame:
    """Rows (block, levels): two bits a cell for 1, 2, up to 15 and more touches."""
    schema = pa.schema([("block", pa.int32()), ("levels", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                seen = counts.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint8))
                cells = np.cumsum(_unplaned(data).astype(np.int64))
                again = np.concatenate(([False], cells[1:] == cells[:-1]))
                for part in (cells[~again], cells[again]):
                    seen[part] = np.minimum(seen[part], 254) + 1
        for block, seen in counts.items():
            level = np.digitize(seen, [2, 3, 16]).astype(np.uint8).reshape(-1, 4)
            packed = level[:, 0] | level[:, 1] << 2 | level[:, 2] << 4 | level[:, 3] << 6
            yield as_batch(schema, [[block], [zlib.compress(packed.tobytes(), 1)]])

    return sketches.repartition(partitions, "block").transform(in_arrow, run, "block int, levels binary")


def _level_map(bits: int, blocks: dict[int, bytes]) -> np.ndarray:
    out, width = np.zeros((1 << bits) // 4, np.uint8), (1 << BLOCK_BITS) // 4
    for block, data in blocks.items():
        out[block * width : (block + 1) * width] = np.frombuffer(zlib.decompress(data), np.uint8)
    return out


def parity_signatures(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, longs): for each set a bit map that every shingle flips one bit of.

    Two maps of one width differ in at most as many bits as their sets differ in shingles, so they can only rule out
    links, never lose one. The width follows the size, so that unrelated sets differ in more bits than a link allows.
    """
    width = np.where(n < 900, 4, np.where(n < 3600, 16, 64))
    offsets = np.concatenate(([0], np.cumsum(width)))
    out = np.zeros(offsets[-1], np.uint64)
    bit = ((h >> np.uint64(7)).astype(np.int64) & 0xFFFFFFFF) % (width[doc] * 64)
    np.bitwise_xor.at(out, offsets[doc] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return offsets, out.view(np.int64)


def class_rows(docs: DataFrame, size: int, threshold: Fraction, max_sketch_bytes: int = 64 << 20) -> DataFrame:
    """Rows (doc_id, n_shingles, k1, k2, regions, signature): the set's size and identity, the shingles it is regioned by."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(total, 2, max_sketch_bytes // 2)  # two bits a cell
    merged = materialise(_merge_levels(_document_sketches(docs, size, bits)), "jaccard-sketch")
    sent = spark.sparkContext.broadcast({r.block: bytes(r.levels) for r in merged.collect()})  # at most max_sketch_bytes
    discard(merged)
    name = f"levels {uuid.uuid4().hex}"
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("regions", pa.list_(pa.int64())), ("signature", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, levels = WordHashes(), kept(name, lambda: _level_map(bits, sent.value))
        for batch in slices(batches, 500):
            doc, h = shingle_sets(hashes, utf8_rows(batch.column("text")), size)
            cell = h >> np.uint64(64 - bits)
            level = levels[(cell >> np.uint64(2)).astype(np.int64)] >> ((cell & np.uint64(3)).astype(np.uint8) * np.uint8(2)) & 3
            order = np.lexsort((h, level, doc))
            n = np.bincount(doc, minlength=batch.num_rows)
            first = np.cumsum(n) - n
            place = np.arange(len(h)) - first[doc]
            # a partner holds at least ceil(t * n) of the n shingles
            window = n + (-n * threshold.numerator) // threshold.denominator + 1
            keep = (place < window[doc]) & (level[order] > 0)
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc[keep], minlength=batch.num_rows))))
            chosen = h[order][keep].view(np.int64)
            edges, longs = parity_signatures(doc, h, n)
            keys = [h[a : a + c].tobytes() for a, c in zip(first.tolist(), n.tolist())]
            k = [np.frombuffer(xxhash.xxh3_128_digest(x), np.int64) for x in keys]
            yield as_batch(schema, [
                batch.column("doc_id").cast(pa.int64()), n.astype(np.int64), [int(x[0]) for x in k], [int(x[1]) for x in k],
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(chosen, pa.int64())),
                pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(longs, pa.int64())),
            ])

    rows = docs.select("doc_id", "text").transform(in_arrow, run, "doc_id long, n_shingles long, k1 long, k2 long, regions array<long>, signature array<long>")
    rows = materialise(rows, "jaccard-rows")
    sent.destroy()  # the rows are kept, so no task needs the map again
    return rows


# ---- exact joins


class SetTable:
    """Shingle sets of a region's members, over the shingles that at least two of them hold."""

    def __init__(self, sets: list[np.ndarray], threshold: Fraction):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.num, self.den = threshold.numerator, threshold.denominator
        values, inverse, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        number = np.cumsum(counts > 1) - 1
        row = np.repeat(np.arange(len(sets)), self.sizes)
        shared = counts[inverse] > 1
        self.width = int((counts > 1).sum())
        self.column, row = number[inverse[shared]], row[shared]
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(sets)))))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of members a with members b."""
        columns = np.unique(np.concatenate([self.column[self.bounds[i] : self.bounds[i + 1]] for i in a] or [np.zeros(0, np.int64)]))
        place = np.full(self.width, -1)
        place[columns] = np.arange(len(columns))
        out = np.zeros((len(a), len(b)), np.float32)
        step = max(1, 5_000_000 // max(1, len(a) + len(b)))
        for at in range(0, len(columns), step):
            width = min(step, len(columns) - at)
            left, right = (self._dense(x, place, at, width) for x in (a, b))
            out += left @ right.T
        return out.astype(np.int64)

    def _dense(self, rows: np.ndarray, place: np.ndarray, at: int, width: int) -> np.ndarray:
        x = np.zeros((len(rows), width), np.float32)
        for k, i in enumerate(rows):
            p = place[self.column[self.bounds[i] : self.bounds[i + 1]]] - at
            x[k, p[(p >= 0) & (p < width)]] = 1
        return x

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = self.common(a, b)
        return common * self.den >= self.num * (self.sizes[a][:, None] + self.sizes[b][None] - common)

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = self.common(a, b)
        return 1 - common / np.maximum(self.sizes[a][:, None] + self.sizes[b][None] - common, 1)


def voronoi(distances: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home pivot of each member, members x pivots: lies in the pivot's region). Partners meet in each other's homes."""
    nearest = distances.min(1)
    return distances.argmin(1), distances <= nearest[:, None] + 2 * radius + 1e-9


def draw_pivots(table: SetTable, members: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(pivots, distances of members to them): each the farthest from those before it, until all members are near one."""
    pivots, distances = [members[0]], [table.distances(members, members[:1])[:, 0]]
    nearest = distances[0]
    while len(pivots) < PIVOTS and nearest.max() > NEAR * radius:
        far = int(nearest.argmax())
        pivots.append(members[far])
        distances.append(table.distances(members, members[far : far + 1])[:, 0])
        nearest = np.minimum(nearest, distances[-1])
    return np.array(pivots), np.stack(distances, 1)


def join_region(table: SetTable, members: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked members, each pair at least once."""
    if len(members) <= LEAF:
        i, j = np.nonzero(np.triu(table.linked(members, members), 1))
        yield members[i], members[j]
        return
    pivots, distances = draw_pivots(table, members, radius)
    lies = voronoi(distances, radius)[1]
    if len(pivots) == 1 or lies.sum() > 2 * len(members):  # one region, or more that hold each other's members
        yield from join_window(table, members, distances[:, 0], radius)
        return
    for p in range(len(pivots)):
        inside = members[lies[:, p]]
        if len(inside) == len(members):
            yield from join_window(table, members, distances[:, p], radius)
        elif len(inside) > 1:
            yield from join_region(table, inside, radius)


def join_window(table: SetTable, members: np.ndarray, distance: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of one pivot's region: members in order of their distance to it, in blocks. By the triangle inequality
    partners' distances differ by the radius at most, so a block meets those within that window alone."""
    order = np.argsort(distance, kind="stable")
    members, distance = members[order], distance[order]
    starts = range(0, len(members), BLOCK)
    for k in starts:
        a = members[k : k + BLOCK]
        i, j = np.nonzero(np.triu(table.linked(a, a), 1))
        yield a[i], a[j]
        reach = distance[min(k + BLOCK, len(members)) - 1] + radius + 1e-9
        for n in range(k + BLOCK, len(members), BLOCK):
            if distance[n] > reach:
                break
            b = members[n : n + BLOCK]
            i, j = np.nonzero(table.linked(a, b))
            yield a[i], b[j]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


#: Rows of a region: side 0 meets everything, sides 1 and 2 only each other; home: this region counts its links.
_REGION = "region string, side int, home boolean, cid long, weight long, text string"
_JOINED = "cid long, root long, links long"
_JOINED_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in _JOINED.split(", ")])


def _join_in_tasks(rows: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """Rows of _REGION, whole regions together, to rows (cid, root, links) with the links this region counts."""
    radius = float(1 - threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        region, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda r: (r[1], r[0]))  # by cid, and a cid's copies together
            same = [k for k in range(1, len(held)) if held[k][:2] == held[k - 1][:2] and np.array_equal(held[k][4], held[k - 1][4])]
            for k in reversed(same):
                del held[k]
            side, ids, home, weight = (np.array([r[k] for r in held]) for k in (0, 1, 2, 3))
            table = SetTable([r[4] for r in held], threshold)
            if side.any():
                a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
                i, j = np.nonzero(table.linked(a, b))
                i, j = a[i], b[j]
                i, j = np.minimum(i, j), np.maximum(i, j)
            else:
                found = list(join_region(table, np.arange(len(held)), radius))
                pairs = np.unique(np.concatenate([np.minimum(x, y) * len(held) + np.maximum(x, y) for x, y in found] or [np.zeros(0, np.int64)]))
                i, j = pairs // len(held), pairs % len(held)
            root = ids[_roots(len(held), i, j)]
            own = home[i]  # rows are in order of cid, so i is the smaller
            links = np.bincount(i[own], weight[j[own]], len(held)) + np.bincount(j[own], weight[i[own]], len(held))
            yield as_batch(_JOINED_ARROW, [ids.astype(np.int64), root.astype(np.int64), links.astype(np.int64)])

        for batch in slices(batches, 200):
            doc, h = shingle_sets(hashes, utf8_rows(batch.column("text")), size)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            columns = [batch.column(n).to_pylist() for n in ("region", "side", "cid", "home", "weight")]
            for k, (name, *row) in enumerate(zip(*columns)):
                if name != region and held:
                    yield from close()
                    held = []
                region = name
                held.append((*row, h[cuts[k] : cuts[k + 1]]))
        if held:
            yield from close()

    return rows.repartition("region").sortWithinPartitions("region").transform(in_arrow, run, _JOINED)


def _deal_by_pivots(rows: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """Large regions (with their size n) to the Voronoi regions of PIVOTS members each, boundary members replicated.

    A region's members are dealt to tasks by hash, TASK_MEMBERS each; its pivots go once to each of these, ahead of them.
    """
    radius = float(1 - threshold)
    parts = F.ceil(F.col("n") / TASK_MEMBERS).cast("int")
    first = Window.partitionBy("region").orderBy(F.xxhash64("cid", "region"), "cid")
    pivots = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PIVOTS)
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("pivot", F.lit(True))
    members = rows.withColumn("salt", F.pmod(F.xxhash64("cid"), parts).cast("int")).withColumn("pivot", F.lit(False))
    columns = ["region", "salt", "pivot", "home", "cid", "weight", "text"]
    dealt = pivots.select(*columns).unionByName(members.select(*columns)).repartition("region", "salt").sortWithinPartitions("region", "salt", F.desc("pivot"), "cid")
    schema = pa.schema([("region", pa.string()), ("side", pa.int32()), ("home", pa.bool_()), ("cid", pa.int64()), ("weight", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, drawn = WordHashes(), None, []
        for batch in slices(batches, 100):
            doc, h = shingle_sets(hashes, utf8_rows(batch.column("text")), size)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            out = []
            for k, (name, salt, pivot, home, cid, weight, text) in enumerate(zip(*(batch.column(n).to_pylist() for n in columns))):
                own = h[cuts[k] : cuts[k + 1]]
                if now != (name, salt):
                    now, drawn = (name, salt), []
                if pivot:
                    drawn.append((cid, own))
                    continue
                common = np.array([len(np.intersect1d(own, s, assume_unique=True)) for _, s in drawn])
                sizes = np.array([len(s) for _, s in drawn]) + len(own) - common
                at, lies = voronoi((1 - common / sizes)[None], radius)
                out += [(f"{name}/{drawn[p][0]}", 0, bool(home and p == at[0]), cid, weight, text) for p in np.flatnonzero(lies[0])]
            if out:
                yield as_batch(schema, list(zip(*out)))

    return dealt.transform(in_arrow, run, _REGION)


def _deal_by_blocks(rows: DataFrame) -> DataFrame:
    """Undivided regions (with their size n) to all pairs of blocks of half a task's members."""
    half = TASK_MEMBERS // 2
    n = F.ceil(F.col("n") / half).cast("int")
    block = F.pmod(F.xxhash64("cid"), n).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("a"), F.greatest(k, F.col("block")).alias("b"))))
    dealt = rows.withColumn("block", block).withColumn("pair", pair)
    side = F.when(F.col("pair.a") == F.col("pair.b"), 0).when(F.col("block") == F.col("pair.a"), 1).otherwise(2)
    return dealt.select(F.concat_ws("|", "region", "pair.a", "pair.b").alias("region"), side.alias("side"), "home", "cid", "weight", "text")


def _sized(rows: DataFrame) -> DataFrame:
    """Regions with their members and an upper bound of their shingles."""
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") / 2).alias("shingles"))


def near_classes(classes: DataFrame, t: Fraction) -> DataFrame:
    """Edges (u, v) of classes that may link: every link between two classes lies inside a component of these edges.

    Two classes that share a region and are within a factor t in size are candidates. In regions of few classes each
    pair is tested by its signatures' distance, which bounds that of the sets (a link's sets differ in at most
    (1 - t) / (1 + t) of their sizes' sum); in larger regions all classes of a size window go with the least of it,
    so edges grow with the members, not with their square.
    """
    num, den = t.numerator, t.denominator
    regioned = classes.where(F.size("regions") > 0).select("cid", F.col("n_shingles").alias("n"), F.explode("regions").alias("r"))
    shared = regioned.groupBy("r").agg(F.min("cid").alias("least"), F.max("cid").alias("most"), F.count(F.lit(1)).alias("c")).where("least < most").select("r", "c")
    rows = materialise(spread_join(regioned, materialise(shared, "jaccard-regions-shared"), ["r"], "c", F.col("cid")), "jaccard-shared")
    few = rows.where(F.col("c") <= PAIRED).select("r", "cid", "n")
    a, b = few.toDF("r", "u", "nu"), few.toDF("r", "v", "nv")
    fits = (F.least("nu", "nv") * den >= F.greatest("nu", "nv") * num) & (F.col("u") < F.col("v"))
    pairs = a.join(b, "r").where(fits).select("u", "v").distinct()
    marks = classes.select("cid", F.col("n_shingles").alias("n"), "signature")
    pairs = pairs.join(marks.toDF("u", "nu", "su"), "u").join(marks.toDF("v", "nv", "sv"), "v")
    differing = F.aggregate(F.zip_with("su", "sv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = (F.size("su") != F.size("sv")) | (differing * (den + num) <= (F.col("nu") + F.col("nv")) * (den - num))
    tested = pairs.where(close).select("u", "v")
    if num == den:
        return tested  # equal sets are one class
    window = F.floor(F.log("n") / (math.log(den / num) * 1.0001))
    many = rows.where(F.col("c") > PAIRED).select("cid", "r", F.explode(F.array(window, window + 1)).alias("w"))
    least = many.groupBy("r", "w").agg(F.min("cid").alias("v"), F.max("cid").alias("most"), F.count(F.lit(1)).alias("members")).where("v < most").drop("most")
    met = spread_join(many, materialise(least, "jaccard-least"), ["r", "w"], "members", F.col("cid"))
    return tested.unionByName(met.where("cid <> v").select(F.col("cid").alias("u"), "v"))


def jaccard_components(docs: DataFrame, size: int = 3, threshold: str | Fraction = "0.9", **sketch: int) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links (documents linked to it)."""
    t = Fraction(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = class_rows(docs, size, t, **sketch)
    real = made.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("weight"), F.first("n_shingles").alias("n_shingles"), F.first("regions").alias("regions"), F.first("signature").alias("signature")), "jaccard-classes")
    whole, made = made, materialise(made.drop("regions", "signature"), "jaccard-sets")
    discard(whole)
    with passing() as stays:
        clusters = components(near_classes(classes, t), "jaccard-clusters")
        weights = classes.groupBy("cid").agg(F.sum("weight").alias("weight"))
        members = clusters.join(weights, F.col("node") == F.col("cid")).select("cid", F.col("root").cast("string").alias("region"), "weight")
        members = stays(materialise(members, "jaccard-member-ids"))
    whole, classes = classes, materialise(classes.drop("regions", "signature"), "jaccard-weights")
    discard(whole)
    if members.limit(BROADCAST_MEMBERS + 1).count() <= BROADCAST_MEMBERS:
        members = F.broadcast(members)
    rows = docs.where("text is not null").join(members, docs["doc_id"] == members["cid"]).select("region", F.lit(0).alias("side"), F.lit(True).alias("home"), "cid", "weight", "text")
    rows = materialise(rows, "jaccard-members")

    joined, parents = None, None
    while True:
        sizes = _sized(rows)
        fits = F.col("n").between(0, TASK_MEMBERS) & (F.col("shingles") <= TASK_SHINGLES) | (F.col("n") <= 2)
        big = materialise(sizes.where(~fits), "jaccard-large")
        known = rows.join(big, "region", "left_anti")
        if parents is not None:
            # a region that kept most of its parent's members is dealt into blocks
            stuck = big.withColumn("parent", F.regexp_extract("region", "^(.*)/[^/]*$", 1)).join(parents, "parent").where("n > 0.5 * parent_n").select("region", "n")
            known = known.unionByName(_deal_by_blocks(rows.join(stuck, "region")).select(*known.columns))
            big = big.join(stuck.select("region"), "region", "left_anti")
        part = materialise(_join_in_tasks(known, size, t), "jaccard-joined")
        joined = part if joined is None else joined.unionByName(part)
        if big.isEmpty():
            break
        parents = big.select(F.col("region").alias("parent"), F.col("n").alias("parent_n"))
        before, rows = rows, materialise(_deal_by_pivots(rows.join(big.select("region", "n"), "region"), size, t), "jaccard-regions")
        discard(before)
    discard(rows)

    roots = components(joined.select(F.col("cid").alias("u"), F.col("root").alias("v")), "jaccard-links")
    links = joined.groupBy("cid").agg(F.sum("links").alias("links"))
    final = classes.select("k1", "k2", "cid", "weight").join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(links, "cid", "left")
    final = final.select("k1", "k2", F.coalesce("root", "cid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    hit = F.col("doc_id").isNotNull()
    return made.join(final, ["k1", "k2"], "left").select(
        "doc_id", "n_shingles", F.when(hit, F.coalesce("component", "doc_id")).alias("component_id"), F.when(hit, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame, size: int = 5, threshold: str | Fraction = "0.8") -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id. Rows without an id all stay.

    Of rows that repeat the kept doc_id, the one whose text's hash is least stays.
    """
    return carried(docs, {"doc_id", "text"}, lambda d: _keep_one(d, size, threshold))


def _keep_one(docs: DataFrame, size: int, threshold: str | Fraction) -> DataFrame:
    with passing() as stays:
        found = jaccard_components(docs, size, threshold).where("component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__doc")).distinct()
        found = stays(materialise(found, "jaccard-copies"))
    left = docs.join(found, F.col("doc_id") == F.col("__doc"), "left_anti")
    text = F.xxhash64(null_free("text"))
    again = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), text)).orderBy(text, "text")
    return left.withColumn("__nth", F.row_number().over(again)).where("__nth = 1 or doc_id is null").drop("__nth")

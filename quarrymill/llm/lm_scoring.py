"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Counts: every training word is counted exactly (a worker's partial counts, then one grouping). The most frequent
`head` words go to every task; counts of all other words stay a distributed table, which tail words meet by join.

Model: the `classes` - 1 most frequent tokens are a class each; every other word is in one of `groups` classes by its
ending, so each word has a class, as target and as context, whatever its count. The next class is predicted from the two
before it: prediction = r[u] C1 + r[v] C2, score = prediction . q[w] + b[w]. It is trained in numpy on every training
document with noise-contrastive estimation: tasks train on their own documents from common parameters, which are
averaged by tokens over a tree of constant-memory sums after each round (rounds split the documents, so one pass in
all). Scores are normalised exactly: as the score is a sum over the two context words, exp(score) summed over the
vocabulary is one matrix product of two tables, for all pairs of context words at once. A word of a group gets the
group's probability times its share (count + 1) / (tokens + words of the group + 1).

Defined results: a null, empty or blank text is one end token; rows with a null doc_id train and are scored;
repeated rows each count and each give a row; without training documents all counts are 0 and the model is uniform;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, in_arrow, kept, materialise, slices, utf8_rows
from .quality import held_out

#: The end token. Words hold no line feed, so none is it.
END = b"\n"
PARTIAL_COUNTS = 300_000
BATCH, NOISE, DIM = 4096, 64, 32
RATE = 0.15
#: Bytes at a word's end that tell its group.
ENDING = 2


# ---- counts


def token_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, c) of all tokens of docs' whole texts."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, 500):
            for text in utf8_rows(batch.column("text")):
                counts.update(text.lower().split())
            counts[END] += batch.num_rows
            if len(counts) > PARTIAL_COUNTS:
                yield as_batch(schema, [list(counts), list(counts.values())])
                counts.clear()
        if counts:
            yield as_batch(schema, [list(counts), list(counts.values())])

    return docs.select("text").transform(in_arrow, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


# ---- the model


@dataclass
class LogBilinear:
    r: np.ndarray  # classes x DIM, of context words
    q: np.ndarray  # classes x DIM, of predicted words
    c1: np.ndarray  # DIM x DIM, for the word before
    c2: np.ndarray  # and for the one before it
    b: np.ndarray  # classes

    @classmethod
    def start(cls, unigram: np.ndarray) -> "LogBilinear":
        rng = np.random.default_rng(0)
        n = len(unigram)
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        return cls(small(n, DIM), small(n, DIM), np.eye(DIM, dtype=np.float32), 0.5 * np.eye(DIM, dtype=np.float32), np.log(unigram).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.r, self.q, self.c1, self.c2, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def filled(self, flat: np.ndarray) -> "LogBilinear":
        out, at = [], 0
        for x in self.arrays():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*out)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part of the word before x next word, part of the second before x next word with bias, log normaliser of the pair)."""
        a1 = np.clip((self.r @ self.c1) @ self.q.T, -30, 30)
        a2 = np.clip((self.r @ self.c2) @ self.q.T, -30, 30) + self.b
        return a1, a2, np.log(np.exp(a1) @ np.exp(a2).T)


def _summed(rows: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct rows, then the sums of each of values over them. Small row numbers are sorted as 16 bits, by radix."""
    order = np.argsort(rows.astype(np.uint16) if rows.max() < 1 << 16 else rows, kind="stable")
    at = rows[order]
    cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return [at[cuts], *[np.add.reduceat(x.take(order, 0), cuts, axis=0) for x in values]]


def _logistic(x: np.ndarray, scale: float) -> np.ndarray:
    """scale / (1 + exp(-x)), made in x's own place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(np.float32(scale), x, out=x)


class Trainer:
    """Adagrad ascent on the noise-contrastive objective, with one noise sample for each batch."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, seed: int):
        self.model = model.filled(model.flat())
        self.noise = np.cumsum(unigram)
        self.log_kq = np.log(NOISE * unigram).astype(np.float32)
        self.past = [np.full(x.shape, 1e-3, np.float32) for x in model.arrays()]
        self.rng = np.random.default_rng(seed)

    def _move(self, k: int, rows: np.ndarray | slice, gradient: np.ndarray) -> None:
        x, past = self.model.arrays()[k], self.past[k]
        past[rows] += gradient * gradient
        x[rows] += RATE * gradient / np.sqrt(past[rows])

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        m = self.model
        n = np.searchsorted(self.noise, self.rng.random(NOISE) * self.noise[-1]).clip(0, len(m.b) - 1)
        ru, rv, qw, qn = m.r.take(u, 0), m.r.take(v, 0), m.q.take(w, 0), m.q.take(n, 0)
        p = ru @ m.c1
        p += rv @ m.c2
        bias = m.b - self.log_kq
        true = np.einsum("ij,ij->i", p, qw) + bias.take(w)
        fake = p @ qn.T
        fake += bias.take(n)
        g = _logistic(-true, 1 / len(w))
        h = _logistic(fake, -1 / len(w))
        dp = h @ qn
        qw *= g[:, None]
        dp += qw
        d1, d2 = dp @ m.c1.T, dp @ m.c2.T
        dc1, dc2 = ru.T @ dp, rv.T @ dp
        hp, hs = h.T @ p, h.sum(0)
        p *= g[:, None]
        rows, dq, db = _summed(np.concatenate((w, n)), np.concatenate((p, hp)), np.concatenate((g, hs)))
        self._move(1, rows, dq)
        self._move(4, rows, db)
        rows, dr = _summed(np.concatenate((u, v)), np.concatenate((d1, d2)))
        self._move(0, rows, dr)
        self._move(2, slice(None), dc1)
        self._move(3, slice(None), dc2)


class Endings(dict):
    """Ending to class, filled on demand: endings are of two bytes at most, so there are some 65,000."""

    def __init__(self, rest: int, groups: int):
        self.rest, self.groups = rest, groups

    def __missing__(self, ending: bytes) -> int:
        self[ending] = g = self.rest + crc32(ending) % self.groups
        return g


class Classes(dict):
    """Word to class; every other word is in one of the last classes, from `rest` on."""

    def __init__(self, words: list[bytes], rest: int, groups: int = 1):
        super().__init__(zip(words, range(len(words))))
        self.rest, self.endings = rest, Endings(rest, groups)

    def __missing__(self, word: bytes) -> int:
        return self.endings[word[-ENDING:]]

    def of(self, words: list[bytes]) -> np.ndarray:
        get, endings = self.get, self.endings
        return np.array([endings[x[-ENDING:]] if (k := get(x)) is None else k for x in words], np.int64)


def group_of(word: str, groups: int) -> Column:
    """The group of a word outside the classes, as `Classes` tells it."""
    return (F.crc32(F.substring(word, -ENDING, ENDING)) % groups).cast("int")


def _classed(texts: list[bytes], classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(next class, class before, second before, document) of every token, and the tokens. Before a text stands its end token."""
    flat, counts = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        before = len(flat)
        flat += t.lower().split()
        flat.append(END)
        counts[k] = len(flat) - before
    w = classes.of(flat)
    end = classes[END]
    first = np.cumsum(counts) - counts
    u = np.concatenate(([end], w[:-1]))
    u[first] = end
    v = np.concatenate(([end], u[:-1]))
    v[first] = end
    return w, u, v, np.repeat(np.arange(len(texts)), counts), flat


def _sum_models(rows: DataFrame, tasks: int) -> DataFrame:
    schema = pa.schema([("weight", pa.float64()), ("flat", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0.0, None
        for batch in batches:
            for a, data in zip(batch.column("weight").to_pylist(), batch.column("flat").to_pylist()):
                x = np.frombuffer(data, np.float32).astype(np.float64) * a
                weight, total = weight + a, x if total is None else total + x
        if total is not None:
            yield as_batch(schema, [[weight], [(total / weight).astype(np.float32).tobytes()]])

    return rows.repartition(tasks).transform(in_arrow, run, "weight double, flat binary")


def train(docs: DataFrame, words: list[bytes], unigram: np.ndarray, rounds: int = 2) -> LogBilinear:
    """words: the classes' words in order; the groups of all other words follow them. unigram: shares by class."""
    spark = docs.sparkSession
    model = LogBilinear.start(unigram)
    keyed = docs.select("text", F.pmod(F.xxhash64("text"), F.lit(rounds)).alias("turn"))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((model, words, unigram))  # bounded by the number of classes

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            start, known, shares = sent.value
            classes = Classes(known, len(known), len(shares) - len(known))
            trainer, seen, left = Trainer(start, shares, 1000 * turn + TaskContext.get().partitionId()), 0, None
            for batch in slices(batches, 500):
                w, u, v, _, _ = _classed(utf8_rows(batch.column("text")), classes)
                order = trainer.rng.permutation(len(w))
                w, u, v = w[order], u[order], v[order]
                if left is not None:
                    w, u, v = (np.concatenate(x) for x in zip(left, (w, u, v)))
                whole = len(w) // BATCH * BATCH
                for at in range(0, whole, BATCH):
                    trainer.step(u[at : at + BATCH], v[at : at + BATCH], w[at : at + BATCH])
                seen += len(w) - (0 if left is None else len(left[0]))
                left = (w[whole:], u[whole:], v[whole:])
            if left is not None and len(left[0]):
                trainer.step(left[1], left[2], left[0])
            if seen:
                yield as_batch(pa.schema([("weight", pa.float64()), ("flat", pa.binary())]), [[float(seen)], [trainer.model.flat().tobytes()]])

        trained = keyed.where(F.col("turn") == turn).select("text").transform(in_arrow, run, "weight double, flat binary")
        rows = _sum_models(_sum_models(trained, 32), 1).collect()  # one row
        if rows:
            model = model.filled(np.frombuffer(rows[0].flat, np.float32))
    return model


# ---- scoring

@dataclass
class Fitted:
    counts: DataFrame  # word, c
    tokens: int  # N
    distinct: int  # V
    head: dict[bytes, int]  # counts of the most frequent words
    words: list[bytes]  # of the classes but the last
    tail_mass: int  # tokens + words outside the classes, + 1
    group_mass: np.ndarray  # tokens + words of each group, + 1
    model: LogBilinear


def fit(docs: DataFrame, classes: int = 2048, head: int = 65536, groups: int = 1) -> Fitted:
    """Counts and model from all of docs. The sizes bound what is broadcast; no word is left out of counts or model."""
    counts = materialise(token_counts(docs), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = [(bytes(r.word), r.c) for r in counts.orderBy(F.desc("c"), "word").limit(head).collect()]
    known = dict(top)
    words = [END, *[w for w, _ in top if w != END][: classes - 2]]
    mass = sum(known.get(w, 0) for w in words)
    seen = sum(w in known for w in words)
    group = group_of("word", groups).alias("g")
    tail_tokens, tail_words = np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    for g, tokens, distinct in counts.groupBy(group).agg(F.sum("c"), F.count(F.lit(1))).collect():  # at most one row a group
        tail_tokens[g], tail_words[g] = tokens, distinct
    for w in words:
        if w in known:
            g = crc32(w[-ENDING:]) % groups
            tail_tokens[g], tail_words[g] = tail_tokens[g] - known[w], tail_words[g] - 1
    shares = np.array([*(known.get(w, 0) + 1.0 for w in words), *(tail_tokens + 1.0)])
    model = train(docs, words, shares / shares.sum())
    return Fitted(counts, n, v, known, words, (n - mass) + (v - seen) + 1, tail_tokens + tail_words + 1, model)


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, base_score, score."""
    spark: SparkSession = docs.sparkSession
    name = xxhash.xxh64_hexdigest(fitted.model.flat().tobytes())
    sent = spark.sparkContext.broadcast((fitted.model, fitted.words, fitted.head, np.log10(fitted.group_mass)))
    base_log = math.log10(fitted.tokens + fitted.distinct + 1)
    spec = "rid long, word binary, tf long, doc_id long, n_tokens long, n_known long, base double, model double"
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in spec.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, words, head, group_logs = sent.value
        a1, a2, z = kept(name, model.tables)
        classes = Classes(words, len(words), len(group_logs))
        mass_log = np.concatenate((np.zeros(len(words)), group_logs))
        logs = {w: math.log10(c + 1) for w, c in head.items()}
        rest, rid = len(words), TaskContext.get().partitionId() << 40
        for batch in slices(batches, 200):
            n_docs = batch.num_rows
            w, u, v, doc, flat = _classed(utf8_rows(batch.column("text")), classes)
            logp = np.bincount(doc, (a1[u, w] + a2[v, w] - z[u, v]) / math.log(10) - mass_log[w], n_docs)
            # log10(count + 1) of head words; nan marks the words that the distributed counts must tell
            known = np.fromiter((logs.get(x, math.nan) for x in flat), np.float64, len(flat))
            tail = np.isnan(known)
            in_rest = w >= rest
            sums = np.bincount(doc, np.where(tail, 0, known), n_docs)
            rest_sums = np.bincount(doc, np.where(tail | ~in_rest, 0, known), n_docs)
            n, n_known = (np.bincount(doc, x, n_docs).astype(np.int64) for x in (np.ones(len(doc)), ~tail))
            rids = rid + np.arange(n_docs)
            rid += n_docs
            marks = [END + int(r).to_bytes(8, "little") for r in rids]  # no word, so it meets no count
            where = np.flatnonzero(tail)
            tf = Counter(zip(doc[where].tolist(), (flat[k] for k in where.tolist())))
            m = len(tf)
            yield as_batch(schema, [rids, marks, np.zeros(n_docs, np.int64), batch.column("doc_id").cast(pa.int64()), n, n_known, sums, logp + rest_sums])
            if m:
                none = pa.nulls(m, pa.int64())
                yield as_batch(schema, [rids[[d for d, _ in tf]], [x for _, x in tf], list(tf.values()), none, none, none, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())])

    rows = docs.select("doc_id", "text").transform(in_arrow, run, spec)
    found = rows.join(fitted.counts, "word", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + 1.0) * F.col("tf")
    sums = found.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("base").alias("base"), F.max("model").alias("model"),
        (F.max("n_known") + F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0))).alias("n_known"), F.sum(log).alias("tail"),
    )
    return sums.select(
        "doc_id", "n_tokens", "n_known",
        (F.col("base") + F.col("tail") - F.col("n_tokens") * base_log).alias("base_score"), (F.col("model") + F.col("tail")).alias("score"),
    )


def score_documents(docs: DataFrame, parts: int = 7, part: int = 2, groups: int = 1024, **sizes: int) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Held-out rows never teach."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fitted = fit(docs.where(~held_out("doc_id", parts, part)), groups=groups, **sizes)
    return score(docs, fitted).select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "n_tokens", "n_known", F.lit(fitted.tokens).cast("long").alias("train_tokens"), "base_score", "score")

"""Embedding whitening: covariance from upper-triangle column aggregates, eigenvectors from LAPACK.

Spark SQL expressions sum the centred products of every pair of dimensions in one aggregation (several for very wide
vectors), of which the driver gets one row; numpy's LAPACK decomposes the assembled covariance; tasks project their vectors by
one matrix product a batch. The same aggregates over the whitened columns measure how far their covariance is from the
identity.

Odd rows: vectors that are null, empty or hold null or non-finite entries take no part, nor do those with an entry of 2^56 or
more in size (its integer isn't a long) or of another length than the most common one (ties: the longer). A null vec_id is
kept; repeated rows count as often as they come. Components without variance can't be whitened and are left out, so a
table without two different vectors gives no row. A deviation beyond a long is null. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, materialise, slices

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 56)
#: Sums in one aggregation; 90 dimensions have 4,095 pairs.
PAIRS = 4096


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # their unit eigenvectors as columns
    trace: float


def integer_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, x: each entry c as floor(64 c) + 1,000,000, of vectors of the most common length."""
    sound = F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    found = rows.where(F.coalesce(sound, F.lit(False))).select("vec_id", x.alias("x"))
    length = found.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return found.where(F.size("x") == (length["length"] if length else 0))


def product_sums(columns: DataFrame) -> np.ndarray:
    """The symmetric matrix of summed products of every two columns (doubles, centred by the caller)."""
    names = columns.columns
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = np.zeros((len(names), len(names)))
    for at in range(0, len(pairs), PAIRS):
        part = pairs[at : at + PAIRS]
        sums = columns.agg(*[F.expr(f"sum(`{names[i]}` * `{names[j]}`)") for i, j in part]).first()
        for (i, j), s in zip(part, sums):
            found[i, j] = found[j, i] = s
    return found


def centred(x: Column, total: int, n: int) -> Column:
    """x less its mean as double: whole parts are subtracted as longs, so nothing of a large x is lost."""
    whole, rest = divmod(total, n)
    return (x - F.lit(whole).cast("long")).cast("double") - F.lit(rest / n)


def fit(vectors: DataFrame) -> Whitening | None:
    """Eigenvalues and eigenvectors of the covariance (divisor n) of x; None without a vector."""
    first = vectors.first()
    if first is None:
        return None
    size = len(first["x"])
    n, *sums = vectors.agg(F.count(F.lit(1)), *[F.sum(F.get("x", F.lit(i)).cast("decimal(20,0)")) for i in range(size)]).first()
    sums = [int(s) for s in sums]
    columns = vectors.select(*[centred(F.get("x", F.lit(i)), s, n).alias(f"c{i}") for i, s in enumerate(sums)])
    covariance = product_sums(columns) / n
    values, axes = np.linalg.eigh(covariance)
    return Whitening(n, sums, values[::-1].copy(), axes[:, ::-1].copy(), float(np.trace(covariance)))


def deviations(apart: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n apart - rest)^2, exactly; apart: x less the whole part of the mean."""
    if len(apart) == 0:
        return []
    largest = n * (int(np.abs(apart).max()) + 1)
    if largest < 1 << 31 and apart.shape[1] * largest * largest < 1 << 63:
        far = apart * n - rest
        return (far * far).sum(axis=1).tolist()
    exact = [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest)) for row in apart]
    return [d if d < 1 << 63 else None for d in exact]


def project(vectors: DataFrame, model: Whitening, components: int) -> DataFrame:
    """vec_id, deviation, w: each vector less the mean, projected on the first components, over the roots of their eigenvalues."""
    live = int(np.sum(model.values[:components] > model.values[0] * len(model.values) * np.finfo(float).eps))
    axes = model.vectors[:, :live] / np.sqrt(model.values[:live])
    whole, rest = (np.array(c, dtype=np.int64) for c in zip(*[divmod(s, model.n) for s in model.sums]))
    n = model.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            apart = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(whole)) - whole
            w = (apart - rest / n) @ axes
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * live)
            made = [batch.column(0), pa.array(deviations(apart, n, rest), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))]
            yield pa.RecordBatch.from_arrays(made, ["vec_id", "deviation", "w"])

    schema = T.StructType([vectors.schema["vec_id"], T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    return in_arrow(vectors.select("vec_id", "x"), run, schema)


def identity_error(projected: DataFrame, n: int, live: int) -> float:
    """The largest absolute entry of the covariance of w less the identity, by the same column aggregates."""
    at = [F.get("w", F.lit(i)) for i in range(live)]
    means = [s / n for s in projected.agg(*[F.sum(c) for c in at]).first()]
    columns = projected.select(*[(c - F.lit(m)).alias(f"w{i}") for i, (c, m) in enumerate(zip(at, means))])
    return float(np.abs(product_sums(columns) / n - np.eye(live)).max())


def whiten(rows: DataFrame, components: int = 32, column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each vector and component."""
    vectors = integer_vectors(rows, column)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    model = fit(vectors)
    if model is None or not model.values[0] > 0:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    projected = materialise(project(vectors, model, components), "whitened")
    live = len(projected.first()["w"])
    error = identity_error(projected, model.n, live)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values[:live]])
    out = projected.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))

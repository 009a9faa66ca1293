"""Shared plumbing of the training-data operators: scratch tables, row keys, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the ASCII blanks that separate words, `[\x20\x09-\x0D]`. bytes.split() uses exactly these.
BLANKS = " \t\n\x0b\x0c\r"

MASK64 = (1 << 64) - 1

#: Bytes of an Arrow batch sent to a Python worker, and of the part of it that is worked on at once.
BATCH_BYTES, SLICE_BYTES = 8 << 20, 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may leave it unset and gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def in_arrow(df: DataFrame, run: Callable, schema: Any) -> DataFrame:
    """df.mapInArrow with batches of at most BATCH_BYTES (or one row), unless the session sets a limit of its own."""
    if df.sparkSession.conf.get(_BATCH_CONF, None) is None:
        df.sparkSession.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


#: Shuffle files go when the query that made them ends; otherwise they stay until the driver happens to collect its garbage.
_CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PASSING: ContextVar[list[DataFrame] | None] = ContextVar("passing", default=None)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. Its shuffle files go."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN_CONF)
    spark.conf.set(_CLEAN_CONF, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_CONF, before)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch = path
    if (tables := _PASSING.get()) is not None:
        tables.append(made)
    return made


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that `materialise` makes inside are deleted at the end, but for those given to the function that it yields."""
    outer, tables = _PASSING.get(), []
    token = _PASSING.set(tables)

    def stays(made: DataFrame) -> DataFrame:
        tables.remove(made)
        if outer is not None:
            outer.append(made)
        return made

    try:
        yield stays
    finally:
        _PASSING.reset(token)
        for made in tables:
            discard(made)


def discard(made: DataFrame) -> None:
    """Delete a table of `materialise` that no later plan reads."""
    spark = made.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made.scratch)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def carried(docs: DataFrame, needed: set[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(docs) with docs' other columns carried as structs, so that none of their names meets one that run uses inside.

    run keeps the columns that it gets; columns it adds stand last and replace those of their names.
    """
    is_map = {f.name: "map<" in f.dataType.simpleString() for f in docs.schema}
    packs = {"__others": [c for c in docs.columns if c not in needed and not is_map[c]], "__maps": [c for c in docs.columns if c not in needed and is_map[c]]}
    packs = {name: columns for name, columns in packs.items() if columns}
    own = [c for c in docs.columns if c in needed]
    out = run(docs.select(*own, *[F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]).alias(name) for name, columns in packs.items()]))
    new = [c for c in out.columns if c not in own and c not in packs]
    at = {c: F.col(name).getField(c).alias(c) for name, columns in packs.items() for c in columns} | {c: F.col(c) for c in own}
    return out.select(*[at[c] for c in docs.columns if c not in new], *new)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def null_free(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def utf8_rows(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of at most `rows` rows and about `size` bytes; a row is never cut."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: Longer words aren't remembered from batch to batch: memos are bounded in bytes by this and their number of entries.
LONGEST_KEPT = 64

_KEPT: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """The one large value a worker process keeps from task to task: a new name drops the value before."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def as_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64, wrapping."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A key is hot with more than one HOT_KEYS-th of all counted rows, so there are at most HOT_KEYS such keys.
HOT_KEYS, SALTS = 2048, 32


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], counts: str, spread_by: Column, how: str = "inner") -> DataFrame:
    """left joined to right (one row a key) with each hot key's rows dealt to SALTS tasks.

    counts: right's column with the number of left rows a key has. Hot keys, at most HOT_KEYS, are broadcast to mark
    left's rows; right's rows of hot keys are there once for each salt.
    """
    total = right.agg(F.sum(counts)).first()[0] or 0
    hot = right.where(F.col(counts) > max(total / HOT_KEYS, 100)).select(*keys).withColumn("__hot", F.lit(True))
    marked = left.join(F.broadcast(hot), keys, "left")
    marked = marked.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("__hot")
    salts = F.when(F.col(counts) > max(total / HOT_KEYS, 100), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return marked.join(right.withColumn("__salt", F.explode(salts)), [*keys, "__salt"], how).drop("__salt")

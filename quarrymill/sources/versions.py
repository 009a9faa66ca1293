"""State as versions: data folders that never change, and one pointer a version that exactly one writer can claim.

A version is written in full beside the others, then published by creating the pointer file of the next number, which fails if that
file is there. So readers see whole versions only, of two writers on one version one wins, and a writer that is lost between both
steps leaves a folder that no pointer names and nothing else.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer published the version first."""


class Versions:
    """The versions of one table under root, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._fs = self._hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.fs.Path("/".join((self.root, *parts)))

    def _listed(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path("pointers", name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _claim(self, name: str, text: str) -> bool:
        """Publish a pointer whole and only if there is none of that name: a link on a local disk, a rename without overwriting elsewhere."""
        draft, target = self._path("drafts", uuid.uuid4().hex), self._path("pointers", name)
        for p in ("drafts", "pointers"):
            self._fs.mkdirs(self._path(p))
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                local = lambda p: urlparse(p.toString()).path
                os.link(local(draft), local(target))
            else:
                options = self.spark._jvm.java.lang.reflect.Array.newInstance(self._hadoop.fs.Options.Rename.NONE.getClass(), 0)
                self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, options)
            return True
        except FileExistsError:
            return False
        except Exception as failed:  # Hadoop's FileAlreadyExistsException, seen through the gateway
            if self._fs.exists(target):
                return False
            raise failed
        finally:
            self._fs.delete(draft, False)

    def head(self) -> int | None:
        """The newest version's number, from 1; None before the first."""
        names = self._listed("pointers")
        return int(names[-1]) if names else None

    def about(self, version: int) -> dict:
        """data (its folder), batches (those in it, by name), from (the version it was made of)."""
        return json.loads(self._text(f"{version:012d}"))

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version, the newest where none is named; None before the first."""
        version = version or self.head()
        return None if version is None else self.spark.read.parquet(f"{self.root}/data/{self.about(version)['data']}")

    def commit(self, rows: DataFrame, base: int | None, batch: str | None = None) -> int:
        """Publish rows as the version after base; Conflict if there is one already.

        batch: a name by which a writer that doesn't know whether it had succeeded finds its work: if base holds it, nothing is written.
        """
        held = self.about(base)["batches"] if base else []
        if batch is not None and batch in held:
            return base
        data = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{data}")
        version = (base or 0) + 1
        if not self._claim(f"{version:012d}", json.dumps({"data": data, "from": base, "batches": [*held, *([batch] if batch is not None else [])]})):
            self._fs.delete(self._path("data", data), True)
            raise Conflict(f"version {version} is there already")
        return version

    def update(self, change: Callable[[DataFrame | None], DataFrame], batch: str | None = None, tries: int = 5) -> int:
        """Publish change(newest); after a conflict the change is made again on what the other writer left."""
        for left in reversed(range(tries)):
            base = self.head()
            try:
                return self.commit(change(self.read(base)), base, batch)
            except Conflict:
                if not left:
                    raise
        raise AssertionError("unreachable")

    def unpublished(self) -> list[str]:
        """Data folders that no pointer names: lost writers' and those still being written."""
        named = {self.about(int(n))["data"] for n in self._listed("pointers")}
        return [d for d in self._listed("data") if d not in named]

    def discard(self, folders: list[str]) -> None:
        """Delete folders of `unpublished` whose writers are known to be gone."""
        for d in folders:
            self._fs.delete(self._path("data", d), True)


def next_state(changes: DataFrame, numbers: DataFrame, state: DataFrame) -> DataFrame:
    """The state after a change set: relpath, hash, docno, retired.

    What stays, was modified or renamed keeps its number, additions have theirs from `numbers` (relpath, docno), removed ones are
    retired with theirs; retired rows stay unless their path is there again or a rename took them over.
    """
    now = changes.where("kind <> 'removed'").select("relpath", "hash").join(numbers, "relpath").select("relpath", "hash", "docno", F.lit(False).alias("retired"))
    gone = state.join(changes.where("kind = 'removed'").select("relpath"), "relpath", "left_semi").select("relpath", "hash", "docno", F.lit(True).alias("retired"))
    taken = changes.where("from_path is not null").select(F.col("from_path").alias("relpath")).unionByName(now.select("relpath")).unionByName(gone.select("relpath"))
    kept = state.where("retired").join(taken, "relpath", "left_anti").select("relpath", "hash", "docno", "retired")
    return now.unionByName(gone).unionByName(kept)


def add_contents(store: Versions, raw: DataFrame, key: str, content: str, batch: str | None = None) -> DataFrame:
    """Contents as they are with their digest, each (key, digest) once, whoever else adds to the store meanwhile."""
    rows = raw.select(key, content).withColumn("digest", F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256)).dropDuplicates([key, "digest"])

    def grown(there: DataFrame | None) -> DataFrame:
        if there is None:
            return rows
        return there.unionByName(rows.join(there.select(key, "digest"), [key, "digest"], "left_anti"))

    return store.read(store.update(grown, batch))

"""Scans: files by ordered glob specifications, texts, JSON lines, archives, spreadsheets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .archives import members

FILE = "relpath string, size long, modified timestamp, spec_index int"


def glob_pattern(glob: str) -> str:
    """A glob with `**` as a regular expression over whole relative paths; one that ends in `/` takes all files below."""
    glob = glob + "**" if glob.endswith("/") else glob
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def scan_files(spark: SparkSession, root: str, globs: list[str], excludes: list[str] = (), extensions: list[str] | None = None, internal: list[str] = (), content: bool = False) -> DataFrame:
    """Files under root that a glob names and no exclude matches; the first glob that names a file owns it.

    internal: prefixes of the pipeline's own products, never read. File contents are read only where asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/"), "^" + re.escape(base), "")
    rows = files.select(rel.alias("relpath"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    for p in excludes:
        rows = rows.where(~F.col("relpath").rlike(p))
    for p in internal:
        rows = rows.where(~F.col("relpath").startswith(p.rstrip("/") + "/"))
    if extensions:
        rows = rows.where(F.lower(F.regexp_extract("relpath", r"(\.[^./]+)$", 1)).isin([e.lower() for e in extensions]))
    spec = reduce(lambda out, k: (F if out is None else out).when(F.col("relpath").rlike(glob_pattern(globs[k])), k), range(len(globs)), None)
    return rows.withColumn("spec_index", spec).where("spec_index is not null")


def source_tree(files: DataFrame, excluded_dirs: list[str], extensions: list[str], cap: int = 50_000) -> DataFrame:
    """Source files outside excluded directories, at most `cap` in path order, with whether the cap cut any."""
    pruned = r"(^|/)(" + "|".join(map(re.escape, excluded_dirs)) + r"|[^/]*\.egg-info)/"
    rows = files.where(~F.col("relpath").rlike(pruned) & ~F.col("relpath").rlike(r"\.min\.(js|css)$"))
    rows = rows.where(F.lower(F.regexp_extract("relpath", r"(\.[^./]+)$", 1)).isin(extensions))
    more = rows.limit(cap + 1).count() > cap
    return rows.orderBy("relpath").limit(cap).withColumn("approx", F.lit(more))


def capped_count(files: DataFrame, most: int = 5_000) -> tuple[int, bool]:
    """How many files there are, counted up to `most`, and whether there are more."""
    n = files.limit(most + 1).count()
    return min(n, most), n > most


def read_texts(files: DataFrame) -> DataFrame:
    """relpath, text: UTF-8 with replacement of what isn't. files: relpath, content."""
    return files.select("relpath", F.decode(F.col("content"), "UTF-8").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank and malformed lines are skipped."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    parsed = rows.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("v"))
    return parsed.where("v is not null and r is not null").select("r.*")


def expand_archives(files: DataFrame, levels: int = 3) -> DataFrame:
    """relpath, content: files, with archives replaced by their members, nested ones up to `levels` deep.

    An archive that can't be opened (or a level too deep) gives no member; `archives.member_chunks` says why, and has no bound on
    a member's size.
    """
    return members(files, levels)


def unique_by_name(files: DataFrame, name: str) -> DataFrame:
    """The one file of that exact name; none or several is an error when the row is read."""
    hit = files.where(F.col("filename") == name)
    n = hit.agg(F.count(F.lit(1)).alias("n"))  # one row
    checked = F.assert_true(F.col("n") == 1, F.concat(F.col("n").cast("string"), F.lit(f" files named {name}")))
    return hit.crossJoin(F.broadcast(n)).where(checked.isNull()).drop("n")


def first_owner(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows that share a key the first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")

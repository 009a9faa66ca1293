"""Incremental state: change sets by content hash, numbering with tombstones, stage marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def change_set(current: DataFrame, state: DataFrame) -> DataFrame:
    """kind, relpath, from_path, hash, old_hash over current (relpath, hash) and state (relpath, hash, retired).

    A path that is new and whose content an absent or retired path had is a rename of it (active before retired, then by
    path, paired one to one); its old path is not removed. A copy of a file that is still there is an addition.
    Joins are merges: paths made from narrow columns are far larger than Spark's estimate, and would go through the driver.
    """
    live = state.where("not retired").select("relpath", F.col("hash").alias("old_hash"))
    both = current.join(live.hint("merge"), "relpath", "full_outer")
    stay = both.where("hash is not null and old_hash is not null").select(F.when(F.col("hash") == F.col("old_hash"), "unchanged").otherwise("modified").alias("kind"), "relpath", F.lit(None).cast("string").alias("from_path"), "hash", "old_hash")
    fresh = both.where("old_hash is null").select("relpath", "hash")
    gone = both.where("hash is null").select(F.col("relpath").alias("from_path"), F.col("old_hash").alias("hash"), F.lit(False).alias("retired"))
    lost = gone.unionByName(state.where("retired").join(current.select("relpath").hint("merge"), "relpath", "left_anti").select(F.col("relpath").alias("from_path"), "hash", "retired"))
    a = fresh.withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("relpath")))
    b = lost.withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("retired", "from_path")))
    paired = a.join(b.hint("merge"), ["hash", "n"], "left")
    new = paired.select(F.when(F.col("from_path").isNotNull(), "renamed").otherwise("added").alias("kind"), "relpath", "from_path", "hash", F.when(F.col("from_path").isNotNull(), F.col("hash")).alias("old_hash"))
    removed = gone.join(paired.where("from_path is not null").select("from_path").hint("merge"), "from_path", "left_anti").select(F.lit("removed").alias("kind"), F.col("from_path").alias("relpath"), F.lit(None).cast("string").alias("from_path"), F.lit(None).cast("string").alias("hash"), F.col("hash").alias("old_hash"))
    return stay.unionByName(new).unionByName(removed)


def ranked(rows: DataFrame, order: str, name: str = "rank", parts: int | None = None) -> DataFrame:
    """rows with their place in order, from 1, without a window over all of them.

    Rows are dealt to tasks by ranges of the order, sorted and written once with their place in their task; the rows of the
    tasks before are added to it, a sum over one row a task. parts: the number of ranges, else Spark's.
    """
    place, task = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("__at", 33)
    dealt = written((rows.repartitionByRange(parts, order) if parts else rows.repartitionByRange(order)).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    sizes = dealt.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = dealt.withColumn("__task", task).join(sizes.select("__task", before.alias("__before")), "__task")
    return found.withColumn(name, (place + 1 + F.col("__before")).cast("long")).drop("__at", "__task", "__before")


def free_numbers(used: DataFrame, wanted: int) -> DataFrame:
    """The `wanted` smallest positive numbers not in used (n): n, rank. Candidates are as many as used and wanted ones together."""
    spark = used.sparkSession
    taken = used.select(F.col("n").cast("long").alias("n")).distinct()
    free = spark.range(1, used.count() + wanted + 1).toDF("n").join(taken.hint("merge"), "n", "left_anti")
    return ranked(free, "n").where(F.col("rank") <= wanted)


def assign_numbers(changes: DataFrame, state: DataFrame, wanted: int) -> DataFrame:
    """relpath, docno after a change set: kept, inherited by renames, else the smallest free; retired ones never return.

    wanted: how many documents were added (a count the caller has from the change set).
    """
    numbers = state.select(F.col("relpath").alias("owner"), F.col("docno").cast("int").alias("n"))
    kept = changes.where("kind in ('unchanged', 'modified', 'renamed')").join(numbers.hint("merge"), F.coalesce("from_path", "relpath") == F.col("owner")).select("relpath", "n")
    added = ranked(changes.where("kind = 'added'").select("relpath"), "relpath")
    new = added.join(free_numbers(numbers.select("n"), wanted).hint("merge"), "rank").select("relpath", "n")
    return kept.unionByName(new).select("relpath", docno(F.col("n")).alias("docno"))


def docno(n: Column) -> Column:
    """Two digits at least."""
    return F.when(n < 100, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))


def needs_stage(stage: str, force: Column, changed: Column, config_changed: Column, cheap: bool, adopted: Column, expensive: bool = False) -> Column:
    """Whether a document goes through a stage: forced or changed, a cheap stage after a new configuration, or no mark yet.

    Adopted documents skip expensive stages unless forced. marks: column stages, a map.
    """
    unmarked = ~F.col("stages").getItem(stage).eqNullSafe(F.lit("ok"))
    wanted = changed | (config_changed & F.lit(cheap)) | unmarked
    return force | (wanted & ~(adopted & F.lit(expensive)))


def baseline(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Upsert: rows of new, and rows of old that new doesn't hold."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def changed_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, state: changed, new or deleted by module hash, where no file list is at hand."""
    rows = old.select("id", F.col("src_hash").alias("a")).join(new.select("id", F.col("src_hash").alias("b")), "id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return rows.select("id", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").otherwise("changed").alias("state"))


def orphans(products: DataFrame, alive: DataFrame, reserved: DataFrame, keep: list[str]) -> DataFrame:
    """Products whose docno nobody owns, but for the kept names. products: name, docno."""
    return products.where(~F.col("name").isin(keep)).join(alive.select("docno"), "docno", "left_anti").join(reserved.select("docno"), "docno", "left_anti")


def adopt(sources: DataFrame, products: DataFrame) -> DataFrame:
    """Sources to existing products: by declared number, the rest in order. sources: relpath, declared; products: docno."""
    named = sources.where("declared is not null").join(products, F.col("declared") == F.col("docno")).select("relpath", "docno")
    left = ranked(sources.join(named.select("relpath"), "relpath", "left_anti").select("relpath"), "relpath", "n")
    free = ranked(products.join(named.select("docno"), "docno", "left_anti").select("docno", F.col("docno").cast("int").alias("number")), "number", "n")
    return named.unionByName(left.join(free, "n").select("relpath", "docno"))


def cascaded(docs: DataFrame, stages: list[str], aggregate: list[str] = ()) -> DataFrame:
    """docs with due: the stages, in their order, that a document goes through.

    docs: dirty (stages that are due by themselves), config_changed. A stage that is due makes all later ones due; a new
    configuration makes aggregate stages due, and those after the first of them.
    """
    own = lambda s: F.array_contains("dirty", s) | (F.col("config_changed") & F.lit(s in aggregate))
    due, so_far = [], F.lit(False)
    for s in stages:
        so_far = so_far | F.coalesce(own(s), F.lit(False))
        due.append(F.when(so_far, F.lit(s)))
    return docs.withColumn("due", F.array_compact(F.array(*due)))


def union_paths(*lists: DataFrame) -> DataFrame:
    """rel and its first position over several lists (rel, pos), an earlier list first: an ordered union without repeats."""
    rows = None
    for k, part in enumerate(lists):
        part = part.select("rel", F.struct(F.lit(k).alias("list"), F.col("pos").cast("long").alias("pos")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where("rel is not null and rel <> ''").groupBy("rel").agg(F.min("at").alias("at")).select("rel", "at.list", "at.pos")


def unlisted(found: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Keys that are there and that the state doesn't hold, once each."""
    return found.select(key).distinct().join(state.select(key), key, "left_anti")


def patched(manifest: DataFrame, counts: DataFrame, key: str, column: str) -> DataFrame:
    """manifest with its column renewed where counts hold the key."""
    new = counts.select(key, F.col(column).alias("__new"))
    return manifest.join(new, key, "left").select(*[F.coalesce("__new", column).alias(column) if c == column else F.col(c) for c in manifest.columns])


def snapshot(raw: DataFrame, path: str, key: str, content: str) -> DataFrame:
    """Intermediate contents as they are, beside the digest they are found by; contents that path holds are not written again."""
    rows = raw.select(key, content).withColumn("digest", F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256))
    spark = raw.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        rows = rows.join(spark.read.parquet(path).select(key, "digest"), [key, "digest"], "left_anti")
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)

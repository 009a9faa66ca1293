"""Changes of tickets as plans, and what a whole plan would do: partial failures are told beside what succeeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import resolve


def planned_watchers(wanted: DataFrame, users: DataFrame, watching: DataFrame) -> DataFrame:
    """key, who, user, action (add, remove, skip, fail), reason. wanted: key, who (an id or an exact name), op (add or remove).

    users: id, name. watching: key, id. Adding who watches already, or removing who doesn't, is skipped; an unknown or ambiguous user
    fails alone and leaves the others of the ticket as they are. Requests that repeat are one.
    """
    known = resolve(wanted.select(F.col("who").alias("wanted")).distinct(), users)
    rows = wanted.select("key", "who", "op").distinct().join(known.select(F.col("wanted").alias("who"), F.col("id").alias("user"), "status"), "who", "left")
    rows = rows.join(watching.select("key", F.col("id").alias("user"), F.lit(True).alias("there")).distinct(), ["key", "user"], "left")
    there = F.coalesce("there", F.lit(False))
    action = F.when(F.col("status") != "ok", "fail").when((F.col("op") == "add") == there, "skip").otherwise(F.col("op"))
    reason = F.when(action == "fail", F.concat(F.lit("user is "), "status")).when(action == "skip", F.when(there, "watches already").otherwise("doesn't watch"))
    return rows.select("key", "who", "user", action.alias("action"), reason.alias("reason"))


def planned_attachments(wanted: DataFrame, files: DataFrame, attached: DataFrame, replace: bool = False) -> DataFrame:
    """key, filename, action (upload, replace, skip, fail), reason. wanted and attached: key, filename; files: filename, size, one or more of a name.

    A name must be that of exactly one file; one that is attached already is skipped, or replaced where asked for.
    """
    found = files.groupBy("filename").agg(F.count(F.lit(1)).alias("n"))
    rows = wanted.select("key", "filename").distinct().join(found, "filename", "left")
    rows = rows.join(attached.select("key", "filename", F.lit(True).alias("there")).distinct(), ["key", "filename"], "left")
    there, n = F.coalesce("there", F.lit(False)), F.coalesce("n", F.lit(0))
    action = F.when(n != 1, "fail").when(there, "replace" if replace else "skip").otherwise("upload")
    reason = F.when(n == 0, "no such file").when(n > 1, F.concat(n.cast("string"), F.lit(" files of that name"))).when(there & F.lit(not replace), "attached already")
    return rows.select("key", "filename", action.alias("action"), reason.alias("reason"))


def plan_outcome(plan: DataFrame, what: str, most: int = 5) -> DataFrame:
    """A ticket a row: how many rows of its plan act, are skipped and fail, and its first `most` failures with their reasons."""
    failed = F.col("action") == "fail"
    first = Window.partitionBy("key").orderBy(what)
    few = plan.where(failed).withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
    told = few.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.concat_ws(": ", what, "reason").alias("t")))), lambda x: x["t"]).alias("failures"))
    sums = plan.groupBy("key").agg(F.count_if(~F.col("action").isin("skip", "fail")).alias("acts"), F.count_if(F.col("action") == "skip").alias("skipped"), F.count_if(failed).alias("failed"))
    return sums.join(told, "key", "left").withColumn("failures", F.coalesce("failures", F.array().cast("array<string>")))


# ---- dimensions of a tracker, flattened from what it sends


def transitions(rows: DataFrame, sent: Column | str = "sent") -> DataFrame:
    """rows with the transitions in a tracker's answer (JSON text), one a row: id, name, to_status, category, has_screen and the required fields in order of their ids."""
    shape = "struct<transitions:array<struct<id:string,name:string,hasScreen:boolean,to:struct<name:string,statusCategory:struct<name:string>>,fields:map<string,struct<required:boolean,name:string>>>>>"
    c = F.col(sent) if isinstance(sent, str) else sent
    each = rows.withColumn("__t", F.explode(F.from_json(c, shape)["transitions"]))
    needed = F.array_sort(F.map_keys(F.map_filter(F.coalesce("__t.fields", F.create_map().cast("map<string,struct<required:boolean,name:string>>")), lambda _, f: F.coalesce(f["required"], F.lit(False)))))
    return each.select(
        *[x for x in rows.columns if x != sent], F.col("__t.id").alias("id"), F.col("__t.name").alias("name"), F.col("__t.to.name").alias("to_status"),
        F.col("__t.to.statusCategory.name").alias("category"), F.coalesce("__t.hasScreen", F.lit(False)).alias("has_screen"), needed.alias("required"),
    )


def watchers(rows: DataFrame, sent: Column | str = "sent") -> DataFrame:
    """rows with watch_count as the tracker tells it, and the names of the watchers that it lists, which may be fewer."""
    c = F.col(sent) if isinstance(sent, str) else sent
    told = F.from_json(c, "struct<watchCount:long,watchers:array<struct<name:string,displayName:string>>>")
    names = F.transform(F.coalesce(told["watchers"], F.array().cast("array<struct<name:string,displayName:string>>")), lambda w: F.coalesce(w["name"], w["displayName"]))
    return rows.select(*[x for x in rows.columns if x != sent], told["watchCount"].alias("watch_count"), F.array_sort(names).alias("watchers"))


def assignable(rows: DataFrame, text: str, most: int = 20) -> DataFrame:
    """Active users (name, display, active, group) whose name or display holds a text, case aside, the first `most` of each group by name."""
    fits = F.lower("name").contains(text.lower()) | F.lower("display").contains(text.lower())
    ranked = rows.where(F.col("active") & fits).withColumn("nth", F.row_number().over(Window.partitionBy("group").orderBy("name")))
    return ranked.where(F.col("nth") <= most)

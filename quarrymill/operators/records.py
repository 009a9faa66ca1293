"""Record operators: predicates, nested to flat projections, validation, planned changes, paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conjunction(equals: dict[str, object] | None = None, contains: dict[str, str] | None = None, empty: list[str] | None = None, since: dict[str, object] | None = None) -> Column:
    """All given conditions; at least one is required. Text search ignores case."""
    parts = [F.col(k) == v for k, v in (equals or {}).items()]
    parts += [F.lower(F.col(k)).contains(v.lower()) for k, v in (contains or {}).items()]
    parts += [F.col(k).isNull() | (F.col(k).cast("string") == "") for k in empty or []]
    parts += [F.col(k) >= F.lit(v) for k, v in (since or {}).items()]
    if not parts:
        raise ValueError("no condition given")
    return reduce(lambda a, b: a & b, parts)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with total and truncated. Only the page is sorted out; the total is one aggregate."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    part = rows.orderBy(*order).offset(offset).limit(limit)
    return part.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > offset + limit)  # one row


def text_filter(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    return rows.where(reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(text.lower()) for c in columns]))


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, kept: int, name: str = "children") -> DataFrame:
    """parents with their first `kept` children as an array, how many there are, and whether some were left out.

    order: a column, or `-column` for the last ones first.
    """
    first = Window.partitionBy(key).orderBy(F.desc(order[1:]) if order.startswith("-") else F.asc(order))
    columns = [c for c in children.columns if c != key]
    ranked = children.withColumn("__n", F.row_number().over(first))
    few = ranked.where(F.col("__n") <= kept).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("__n"), *columns))).alias(name))
    total = children.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    out = parents.join(few, key, "left").join(total, key, "left")
    return out.withColumn(name, F.transform(name, lambda x: F.struct(*[x[c].alias(c) for c in columns]))).withColumn("total", F.coalesce("total", F.lit(0))).withColumn("cut", F.col("total") > kept)


def resolve(wanted: DataFrame, entries: DataFrame, by: str = "wanted", key: str = "id", name: str = "name") -> DataFrame:
    """wanted values to the one entry whose id or exact name they are: status ok, missing or ambiguous.

    Two equi-joins, by id and by name, rather than one join on either.
    """
    ids = wanted.select(by).distinct()
    hits = ids.join(entries, F.col(by) == F.col(key).cast("string")).select(by, key).unionByName(ids.join(entries, F.col(by) == F.col(name)).select(by, key)).distinct()
    found = hits.groupBy(by).agg(F.count(F.lit(1)).alias("hits"), F.min(key).alias(key))
    status = F.when(F.col("hits") == 1, "ok").when(F.col("hits") > 1, "ambiguous").otherwise("missing")
    return wanted.join(found, by, "left").withColumn("status", status).withColumn(key, F.when(F.col("hits") == 1, F.col(key))).drop("hits")


def missing_required(fields: DataFrame, payload: DataFrame) -> DataFrame:
    """Required fields that a record leaves out or blank. fields: id, required; payload: record, id, value (JSON text)."""
    blank = F.trim("value").isin("", '""', "[]", "{}", "null")
    given = F.collect_set(F.when(F.col("value").isNotNull() & ~blank, F.col("id"))).alias("given")
    needed = fields.where("required").agg(F.collect_set("id").alias("needed"))  # one row of metadata
    lacking = F.explode(F.array_except("needed", "given")).alias("id")
    return payload.groupBy("record").agg(given).crossJoin(F.broadcast(needed)).select("record", lacking)


def planned_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields that would change: key, field, before, after. Equal values, nulls included, give no row.

    Keys on one side only are compared with nulls.
    """
    old = before.select(F.col(key), *[F.col(f).cast("string").alias(f"o_{f}") for f in fields])
    new = after.select(F.col(key), *[F.col(f).cast("string").alias(f"n_{f}") for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("before"), F.col(f"n_{f}").alias("after")) for f in fields])
    rows = old.join(new, key, "full_outer").select(key, F.explode(each).alias("c")).select(key, "c.*")
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def planned_transitions(current: DataFrame, wanted: DataFrame, allowed: DataFrame) -> DataFrame:
    """key, from, to, action: apply, skip (there already) or refuse (not allowed). allowed: status, target."""
    rows = current.join(wanted, "key").join(allowed.withColumn("ok", F.lit(True)), ["status", "target"], "left")
    action = F.when(F.col("status") == F.col("target"), "skip").when(F.col("ok"), "apply").otherwise("refuse")
    return rows.select("key", F.col("status").alias("from_status"), F.col("target").alias("to_status"), action.alias("action"))


def receipt_status(tickets: DataFrame, receipts: DataFrame) -> DataFrame:
    """tickets with state ok, failed or missing."""
    state = F.when(F.col("status").isNull(), "missing").when(F.col("status") == "ok", "ok").otherwise("failed")
    return tickets.join(receipts, "key", "left").withColumn("state", state)


def rollup(rows: DataFrame, state: str, states: list[str]) -> DataFrame:
    """One row: how many rows are in each state."""
    return rows.agg(*[F.count_if(F.col(state) == s).alias(s) for s in states])


def not_mentioned(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Files whose name no text of their ticket holds. files: key, filename; texts: key, body."""
    a, b = files.alias("a"), texts.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & F.contains(F.lower("b.body"), F.lower("a.filename")), "left_anti")


def capped(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows in order, each with how many were skipped. Only these rows are sorted out."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    kept = rows.orderBy(*order).limit(most)
    return kept.crossJoin(total).withColumn("skipped", F.greatest(F.col("total") - most, F.lit(0))).drop("total")  # one row


def wanted_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is asked for, case and blanks aside; all rows where no key is asked for. keys: one column."""
    clean = lambda c: F.upper(F.trim(c))
    asked = keys.select(clean(F.col(keys.columns[0])).alias("__key")).where("__key <> ''").distinct()
    return rows if asked.isEmpty() else rows.join(asked, clean(F.col(key)) == F.col("__key"), "left_semi")


def configured(rows: DataFrame, config: DataFrame, name: str, default: dict[str, object]) -> DataFrame:
    """rows with the columns of the configuration of their name, and defaults where there is none. config: name, ..."""
    found = rows.join(config, name, "left")
    return found.select(*rows.columns, *[F.coalesce(F.col(c), F.lit(default.get(c))).alias(c) for c in config.columns if c != name])


def reviewed(defaults: DataFrame, earlier: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values that a person set in an earlier run stay; others take the new default. Adds `kept`: how many stayed."""
    old = earlier.select(key, *[F.nullif(F.trim(F.col(c)), F.lit("")).alias(f"__{c}") for c in columns])
    rows = defaults.join(old, key, "left")
    kept = sum((F.col(f"__{c}").isNotNull().cast("int") for c in columns), F.lit(0))
    others = [c for c in defaults.columns if c not in columns]
    return rows.select(*others, *[F.coalesce(f"__{c}", c).alias(c) for c in columns], kept.alias("kept"))


def counted(rows: DataFrame, by: str) -> DataFrame:
    """Rows by category: by, n."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))

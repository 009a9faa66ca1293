"""Event-log digests: ranked counts, first examples, bounded hit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(events: DataFrame, by: str, order: str) -> DataFrame:
    """Per value of `by`: n, share of all in percent (1 decimal), order of its first row; one shuffle on few partial rows."""
    counts = events.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seq"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.round(100 * F.col("n") / F.col("total"), 1)).drop("total")  # one row


def top(counts: DataFrame, k: int, n: str = "n", first: str = "first_seq", within: list[str] | None = None) -> DataFrame:
    """The k largest, ties by first occurrence; per group where `within` names one."""
    if not within:
        return counts.orderBy(F.desc(n), first).limit(k)
    w = Window.partitionBy(*within).orderBy(F.desc(n), first)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_examples(events: DataFrame, by: str, order: str, *columns: str) -> DataFrame:
    return events.groupBy(by).agg(F.min_by(F.struct(*columns), order).alias("x")).select(by, "x.*")


def hits_per_id(events: DataFrame, ids: DataFrame, key: str, order: str, kept: int) -> DataFrame:
    """For each wanted id its first `kept` rows and how many there are.

    Counts come from partial sums, and the row limit prunes before the shuffle, so a frequent id costs `kept` rows a task.
    """
    rows = events.join(ids.distinct(), key)
    hits = rows.groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= kept).join(hits, key)


def near_times(events: DataFrame, ts: str, hints: list[str], kept: int, order: str) -> DataFrame:
    """Rows whose timestamp text holds any of the clock times, the first `kept`."""
    return events.where(F.exists(F.array(*map(F.lit, hints)), lambda h: F.col(ts).contains(h))).orderBy(order).limit(kept)


def segments(rows: DataFrame, by: str, order: str, opens: Column) -> DataFrame:
    """Gaps and islands: rows after a header row belong to it; those before any have segment 0."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("segment", F.sum(opens.cast("int")).over(w))


def flagged_names(rows: DataFrame, columns: list[str], flag: str = "s") -> Column:
    """Names of the columns that hold the flag, joined by `/`."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.lower(F.trim(c)) == flag, F.lit(c)) for c in columns])), "/")


def merged_header(cells: DataFrame) -> DataFrame:
    """Header rows to one: per column its distinct parts from top to bottom, joined. cells: sheet, row, col, value."""
    parts = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]))
    return cells.where(F.trim("value") != "").groupBy("sheet", "col").agg(F.array_join(parts, "<br>").alias("header"))


def clean_grid(cells: DataFrame) -> DataFrame:
    """Cells of rows and columns that hold anything, rows and columns numbered anew. cells: sheet, row, col, value."""
    full = cells.where(F.trim("value") != "")
    rows = full.select("sheet", "row").distinct().withColumn("r", F.row_number().over(Window.partitionBy("sheet").orderBy("row")))
    cols = full.select("sheet", "col").distinct().withColumn("c", F.row_number().over(Window.partitionBy("sheet").orderBy("col")))
    grid = rows.join(cols, "sheet").join(cells, ["sheet", "row", "col"], "left")  # ragged rows are padded
    return grid.select("sheet", F.col("r").alias("row"), F.col("c").alias("col"), F.coalesce("value", F.lit("")).alias("value"))


def data_rows(cells: DataFrame) -> DataFrame:
    """sheet, row of rows that start by column 2 with a number or hexadecimal and fill two cells or more."""
    full = cells.where(F.trim("value") != "").groupBy("sheet", "row").agg(F.min_by(F.struct("col", "value"), "col").alias("x"), F.count(F.lit(1)).alias("n"))
    return full.where((F.col("n") >= 2) & (F.col("x.col") <= 2) & F.trim("x.value").rlike(r"^(0[xX][0-9A-Fa-f]+|\d+(\.\d+)?)$")).select("sheet", "row")

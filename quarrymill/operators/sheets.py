"""Sheets as cells (sheet, row, col, value): split headers, indexes, and message matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import data_rows, merged_header, segments


def normalised_spec(spec: dict) -> tuple[str, dict]:
    """(kind, spec) of both forms of `structured`: a name, or a dictionary whose other keys win over the spec's own."""
    form = spec.get("structured")
    if isinstance(form, str):
        return form, spec
    if not isinstance(form, dict):
        return "", spec
    inner = {k: v for k, v in form.items() if k not in ("kind", "type")}
    return form.get("kind") or form.get("type") or "", {**spec, **inner}


def row_parts(cells: DataFrame, header_rows: int = 6) -> DataFrame:
    """sheet, row, part of a clean grid's rows: pre, header, note or body.

    The header starts at the first row of three filled cells or more that follows a row of at most one (or nothing),
    else at the first row. It ends before the first data row, and with its `header_rows`-th row of two cells or more;
    rows of one cell in between are notes.
    """
    by_row = Window.partitionBy("sheet").orderBy("row")
    filled = cells.groupBy("sheet", "row").agg(F.count_if(F.trim("value") != "").alias("n"))
    rows = filled.join(data_rows(cells).withColumn("data", F.lit(True)), ["sheet", "row"], "left").withColumn("data", F.coalesce("data", F.lit(False)))
    starts = (F.col("n") >= 3) & (F.coalesce(F.lag("n").over(by_row), F.lit(0)) <= 1)
    whole = Window.partitionBy("sheet")
    rows = rows.withColumn("starts", starts).withColumn("h", F.coalesce(F.min(F.when(F.col("starts"), F.col("row"))).over(whole), F.min("row").over(whole)))
    counts = (F.col("row") == F.col("h")) | ((F.col("row") > F.col("h")) & (F.col("n") >= 2))
    so_far = F.sum(counts.cast("int")).over(by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("nth", so_far)
    first_data = F.min(F.when((F.col("row") > F.col("h")) & F.col("data"), F.col("row"))).over(whole)
    full = F.min(F.when((F.col("nth") >= header_rows) & (F.col("row") >= F.col("h")), F.col("row") + 1)).over(whole)
    rows = rows.withColumn("body", F.least(first_data, full))
    after = F.coalesce(F.col("row") >= F.col("body"), F.lit(False))
    part = F.when(F.col("row") < F.col("h"), "pre").when(after, "body").when((F.col("n") >= 2) | (F.col("row") == F.col("h")), "header").otherwise("note")
    return rows.select("sheet", "row", part.alias("part"))


def sheet_index(cells: DataFrame, parts: DataFrame, titles: DataFrame) -> DataFrame:
    """sheet, title, header (merged, by column) and body rows. titles: sheet, title."""
    placed = cells.join(parts, ["sheet", "row"])
    head = merged_header(placed.where("part = 'header'").select("sheet", "row", "col", "value")).groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct("col", "header"))).alias("hs"))
    body = parts.where("part = 'body'").groupBy("sheet").agg(F.count(F.lit(1)).alias("body_rows"))
    rows = parts.select("sheet").distinct().join(titles, "sheet", "left").join(head, "sheet", "left").join(body, "sheet", "left")
    return rows.select("sheet", F.coalesce("title", F.lit("")).alias("title"), F.array_join(F.transform("hs", lambda x: x["header"]), "|").alias("header"), F.coalesce("body_rows", F.lit(0)).alias("body_rows"))


def sheet_notes(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """sheet, row, part, text of the lines before a header and of the notes in it: their filled cells, joined."""
    placed = cells.join(parts.where("part in ('pre', 'note')"), ["sheet", "row"]).where(F.trim("value") != "")
    words = F.transform(F.sort_array(F.collect_list(F.struct("col", "value"))), lambda x: x["value"])
    return placed.groupBy("sheet", "row", "part").agg(F.array_join(words, " ").alias("text"))


def message_rows(rows: DataFrame) -> DataFrame:
    """rows (sheet, row, name, id, ...) with segment, message and message_id of the message they belong to.

    A row with both a name and an id opens a message, and is its first row; rows before any belong to none.
    """
    opens = F.col("name").isNotNull() & F.col("id").isNotNull()
    cut = segments(rows, "sheet", "row", opens).where("segment > 0")
    heads = Window.partitionBy("sheet", "segment").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return cut.withColumn("message", F.first("name").over(heads)).withColumn("message_id", F.first("id").over(heads)).withColumn("nth", F.row_number().over(Window.partitionBy("sheet", "segment").orderBy("row")))


def id_order(c: str) -> Column:
    """A hexadecimal identifier's value; 65,535 for what isn't one."""
    return F.coalesce(F.conv(F.regexp_extract(F.trim(c), "^(?:0[xX])?([0-9A-Fa-f]+)$", 1), 16, 10).try_cast("long"), F.lit(0xFFFF))


def speed_table(messages: DataFrame, length: str, cycle: str, senders: str) -> DataFrame:
    """A message a row in order of identifiers: rank, message_id, message, length, cycle, senders of its first row, and rows."""
    ranked = Window.partitionBy("sheet").orderBy(id_order("message_id"), "segment")
    sizes = messages.groupBy("sheet", "segment").agg(F.count(F.lit(1)).alias("rows"))
    first = messages.where("nth = 1").join(sizes, ["sheet", "segment"])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return first.select("sheet", F.row_number().over(ranked).alias("rank"), "message_id", "message", text(length).alias("length"), text(cycle).alias("cycle"), text(senders).alias("senders"), "rows")


def signal_table(messages: DataFrame, columns: list[str]) -> DataFrame:
    """sheet, message_id, message, nth and the signal columns of rows whose first signal column isn't blank."""
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    return messages.where(text(columns[0]) != "").select("sheet", "message_id", "message", "nth", *[text(c).alias(c) for c in columns])


def structured(spec: dict, cells: DataFrame, message_columns: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The tables that a document's spec asks for: of generic sheets, of a message matrix, or none."""
    kind, full = normalised_spec(spec)
    if kind == "can_matrix":
        named = {**{"name": 1, "id": 3}, **(message_columns or {}), **full.get("structured_rules", {}).get("columns", {})}
        rows = cells.groupBy("sheet", "row").agg(*[F.max(F.when(F.col("col") == c, F.nullif(F.trim("value"), F.lit("")))).alias(n) for n, c in named.items()])
        skip = int(full.get("structured_rules", {}).get("column_header_row", 0))
        return {"messages": message_rows(rows.where(F.col("row") > skip))}
    if kind:
        parts = row_parts(cells, int(full.get("structured_rules", {}).get("header_max_rows", 6)))
        titles = cells.sparkSession.createDataFrame(list(full.get("sheet_titles", {}).items()), "sheet string, title string")
        return {"index": sheet_index(cells, parts, titles), "notes": sheet_notes(cells, parts), "parts": parts}
    return {}

"""Sinks: guarded, dated, and rendered to text only at the edge."""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_escaped, table_row


def _plain(path: str) -> str:
    return re.sub(r"^[a-z]+:/*", "/", path).rstrip("/") + "/"


def assert_writable(path: str, inputs: list[str]) -> None:
    """Refuse to write into or above an input."""
    out = _plain(path)
    for i in map(_plain, inputs):
        if out.startswith(i) or i.startswith(out):
            raise PermissionError(f"{path} overlaps the input {i}")


def write_new(df: DataFrame, path: str, inputs: list[str] = (), run_date: str | None = None, fmt: str = "parquet") -> str:
    """Write to a path that must not exist yet, by date where one is given; what an earlier run wrote stays as its backup."""
    target = f"{path.rstrip('/')}/run_date={run_date}" if run_date else path
    assert_writable(target, list(inputs))
    df.write.mode("errorifexists").format(fmt).save(target)
    return target


def markdown_table(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """Column `value`: a table's lines in order, for the text writer. For reports: the rows are sorted into one file."""
    body = df.orderBy(*order).select(table_row(*[F.col(c).cast("string") for c in columns]).alias("value")).coalesce(1)
    head = df.sparkSession.createDataFrame([("| " + " | ".join(columns) + " |",), ("| " + " | ".join(["---"] * len(columns)) + " |",)], "value string").coalesce(1)
    return head.unionByName(body)


def html_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = [F.concat(F.lit("<td>"), html_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def manifest(docs: DataFrame, lines: DataFrame, heads: DataFrame, chunks: DataFrame) -> DataFrame:
    """A document a row: docs' columns with its lines, headings and chunks. docs and the others are keyed by docno."""
    out = docs
    for rows, name in ((lines, "lines"), (heads, "headings"), (chunks, "chunks")):
        counts = rows.groupBy("docno").agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, "docno", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def inverted_index(top: DataFrame, most: int = 12) -> DataFrame:
    """A term a row: its documents in order, with their best section's name and line, at most `most`, and how many there are.

    top: docno, term, section, hits, first_line, rank.
    """
    best = top.groupBy("term", "docno").agg(F.min_by(F.struct("section", F.col("first_line").alias("line")), "rank").alias("x"), F.sum("hits").alias("hits"))
    # the limit of a rank is met by every task before the shuffle, so none holds or sends more than `most` places of a term
    first = Window.partitionBy("term").orderBy(F.desc("hits"), "docno")
    kept = best.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most)
    place = F.concat_ws(":", F.col("docno").cast("string"), F.col("x.section"), F.col("x.line").cast("string"))
    listed = kept.groupBy("term").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", place.alias("place")))), lambda e: e["place"]).alias("places"))
    return listed.join(best.groupBy("term").agg(F.count(F.lit(1)).alias("docs")), "term")


def state_rows(docs: DataFrame, run: str) -> DataFrame:
    """What the next run compares with: relpath, hash, docno, retired, the stages' marks and the run that wrote it."""
    return docs.select("relpath", "hash", "docno", F.coalesce("retired", F.lit(False)).alias("retired"), F.coalesce("stages", F.create_map().cast("map<string,string>")).alias("stages"), F.lit(run).alias("run"))


def filled(template: Column | str, values: dict[str, Column]) -> Column:
    """`{name}` placeholders of a template replaced."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out

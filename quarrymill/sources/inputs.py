"""Inputs besides plain scans: commented JSON, change lists of a version control, metadata pages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_jsonc(text: str) -> object:
    """JSON with `//` and `/* */` comments and trailing commas; those inside strings are text."""
    out, at, quoted = [], 0, False
    while at < len(text):
        c, two = text[at], text[at : at + 2]
        if quoted:
            out.append(text[at : at + 2] if c == "\\" else c)
            at += len(out[-1])
            quoted = c != '"'
        elif two == "//":
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
        elif two == "/*":
            end = text.find("*/", at + 2)
            if end < 0:
                raise ValueError("a comment isn't closed")
            at = end + 2
        else:
            quoted = c == '"'
            if c in "]}":
                while out and (out[-1].isspace() or out[-1] == ","):
                    if out.pop() == ",":
                        break
            out.append(c)
            at += 1
    return json.loads("".join(out))


def read_config(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """One configuration file, wherever Spark can read it, over a default."""
    from ..operators.evidence import merged_config

    (row,) = spark.read.text(path, wholetext=True).collect()  # one file of configuration
    return merged_config(default or {}, parse_jsonc(row.value.lstrip("﻿")))


def changed_files(diff: DataFrame, status: DataFrame) -> DataFrame:
    """rel and its first position (list, pos) of lines (pos, line) of `diff --name-status` and of `status --porcelain`.

    Both sides of a rename count; quotes around a path go; the diff's files come first.
    """
    from ..operators.cdc import union_paths

    bare = lambda p: F.regexp_replace(F.trim(p), '^"|"$', "")
    parts = F.split("line", "\t")
    a = diff.where(F.col("line").rlike(r"^[A-Z][0-9]*\t")).select((F.col("pos") * 2).alias("pos"), F.posexplode(F.slice(parts, 2, 2)).alias("k", "p"))
    sides = F.split(F.expr("substring(line, 4)"), " -> ")
    b = status.where(F.col("line").rlike(r"^[ A-Z?!]{2} .")).select((F.col("pos") * 2).alias("pos"), F.posexplode(sides).alias("k", "p"))
    rows = [x.select(bare(F.col("p")).alias("rel"), (F.col("pos") + F.col("k")).alias("pos")) for x in (a, b)]
    return union_paths(*rows)


def metadata_pages(rows: DataFrame, order: list[Column], page: int, most: int) -> DataFrame:
    """The first `most` rows of a dimension in order, with nth, their page from 0, and whether rows were left out."""
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    kept = rows.orderBy(*order).limit(most)  # a dimension: `most` is a few thousand
    nth = F.row_number().over(Window.orderBy(*order))  # of the kept rows alone
    ranked = kept.select(nth.alias("nth"), F.floor((nth - 1) / page).cast("int").alias("page"), *rows.columns)
    return ranked.crossJoin(total).withColumn("truncated", F.col("__total") > most).drop("__total")  # one row

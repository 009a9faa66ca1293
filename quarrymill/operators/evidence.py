"""Lookups and assertions over documents and attachments."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flat_user(user: Column) -> Column:
    """name, key, display, email of a nested user; null where all are blank."""
    fields = {"name": "name", "key": "key", "display": "displayName", "email": "email"}
    values = {k: F.nullif(F.trim(user[v]), F.lit("")) for k, v in fields.items()}
    return F.when(F.coalesce(*values.values()).isNotNull(), F.struct(*[v.alias(k) for k, v in values.items()]))


def allowed_values(options: DataFrame, key: str, value: str, kept: int = 40) -> DataFrame:
    """Per field its first allowed values in order and how many more there are."""
    w = Window.partitionBy(key).orderBy(value)
    few = options.withColumn("n", F.row_number().over(w)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy(key))).where(F.col("n") <= kept)
    return few.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.col(value).cast("string").alias("v")))), lambda x: x["v"]), ",").alias("shown"), (F.max("all") - F.count(F.lit(1))).alias("more"))


#: What refers to an image (no blanks) or to another attachment, in two kinds of marks.
IMAGE, OTHER = r"![^!\s]+\.(?:png|jpg|jpeg|gif|bmp|webp)!", r"[!\[][^!\]]+\.(?:log|txt|blf|dbc|tar\.gz|tgz|zip|csv|xlsx|docx|pdf)[!\]]"
REFERENCE = f"(?i)(?:{IMAGE}|{OTHER})"


def localised(texts: DataFrame, files: DataFrame) -> DataFrame:
    """References to files in texts (key, id, body) become their local paths (key, filename, local), case aside.

    A reference is REFERENCE; one without a file stays as it is, and so does any other text, marks included. References
    are joined with the text up to the next one, and put together in order.
    """
    cut = texts.select("key", "id", F.split("body", REFERENCE, -1).alias("gaps"), F.regexp_extract_all("body", F.lit(REFERENCE), 0).alias("refs"))
    parts = cut.select("key", "id", F.col("gaps")[0].alias("head"), F.posexplode_outer(F.zip_with("refs", F.slice("gaps", 2, F.size("gaps")), lambda r, g: F.struct(r.alias("ref"), g.alias("gap")))).alias("pos", "x"))
    parts = parts.withColumn("name", F.lower(F.regexp_replace("x.ref", r"^[!\[]|[!\]]$", "")))
    names = files.groupBy("key", F.lower("filename").alias("name")).agg(F.min("local").alias("local"))
    found = parts.join(names, ["key", "name"], "left")
    piece = F.concat(F.when(F.col("local").isNotNull(), F.concat(F.lit("["), "local", F.lit("]"))).otherwise(F.col("x.ref")), "x.gap")
    pieces = F.transform(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", piece.alias("piece"))))), lambda x: x["piece"])
    return found.groupBy("key", "id").agg(F.concat(F.first("head"), F.array_join(pieces, "")).alias("body"))


def quick_table(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Rows (docno, key) with the line of their detail (docno, key, line); the last detail of a key counts, none is 0."""
    last = details.groupBy("docno", "key").agg(F.max("line").alias("detail_line"))
    return rows.join(last, ["docno", "key"], "left").withColumn("detail_line", F.coalesce("detail_line", F.lit(0)))


def wrong_lines(table: DataFrame, details: DataFrame) -> DataFrame:
    """Rows of a quick table whose line holds no detail of their key."""
    return table.join(details.select("docno", "key", F.col("line").alias("detail_line")), ["docno", "key", "detail_line"], "left_anti")


def unmapped_prefixes(modules: DataFrame, document: DataFrame) -> DataFrame:
    """Prefixes (id, prefix) that no line of the root document (text) names as a path or as the start of one.

    The document's path tokens and what they begin with are exploded once, so prefixes meet them by equality.
    """
    from .modules import ancestors

    tokens = document.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\s`'\"()\[\],;|]+"), 0)).alias("token"))
    named = tokens.select(F.explode(F.array_union(ancestors(F.col("token")), F.array("token"))).alias("prefix")).distinct()
    return modules.join(named, "prefix", "left_anti")


def unknown_paths(document: DataFrame, modules: DataFrame) -> DataFrame:
    """Directory tokens (ending in /) of the root document (text) that no module's prefix is."""
    tokens = document.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\s`'\"()\[\],;|]+/"), 0)).alias("path"))
    return tokens.distinct().join(modules, F.col("path") == F.col("prefix"), "left_anti")


def groups_by_dir(files: DataFrame) -> DataFrame:
    """Logs of one directory: members in order and their bytes. files: path, bytes."""
    d = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return files.groupBy(d.alias("dir")).agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("bytes"), F.min("path").alias("first"))


def broken_links(docs: DataFrame, targets: Column, known: DataFrame) -> DataFrame:
    """Relative link targets that aren't known. docs: doc; known: rel."""
    rows = docs.select("doc", F.explode(targets).alias("target")).where(~F.col("target").rlike("^(https?:|#|mailto:|computer:)") & (F.col("target") != ""))
    rel = F.regexp_replace(F.regexp_replace("target", "#.*$", ""), "^(\\./)+", "")
    return rows.withColumn("rel", rel).join(known.select("rel"), "rel", "left_anti").select("doc", "target").distinct()


def unindexed(top: DataFrame, index: DataFrame) -> DataFrame:
    """First sections (docno, term, section) that an index of the same columns lacks."""
    return top.join(index, ["docno", "term", "section"], "left_anti")


#: Shares that the findings of one kind are dealt to.
SHARES = 256


def findings(parts: dict[str, DataFrame], most: dict[str, int], default: int = 10) -> DataFrame:
    """kind, nth, subject, detail, total: the findings of several checks (subject, detail) in one table.

    Of each kind the first `most` (else `default`) in order of subject and detail, each with how many there are of its kind.
    """
    rows = None
    for kind, part in parts.items():
        part = part.select(F.lit(kind).alias("kind"), F.col("subject").cast("string").alias("subject"), F.col("detail").cast("string").alias("detail"))
        rows = part if rows is None else rows.unionByName(part)
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col("kind")), F.lit(default)) if most else F.lit(default)
    # the checks run once: shares of a kind give their first rows and, by their last row's place, their sizes
    order = Window.partitionBy("kind", "share").orderBy("subject", "detail")
    shares = rows.withColumn("share", F.pmod(F.xxhash64("subject", "detail"), F.lit(SHARES)))
    placed = shares.withColumn("nth", F.row_number().over(order)).withColumn("ends", F.lead(F.lit(False), 1, True).over(order))
    few = placed.where((F.col("nth") <= limit) | F.col("ends")).groupBy("kind").agg(
        F.sum(F.when(F.col("ends"), F.col("nth"))).alias("total"),
        F.sort_array(F.collect_list(F.when(F.col("nth") <= limit, F.struct("subject", "detail")))).alias("found"),
    )
    found = few.select("kind", "total", F.posexplode(F.slice("found", F.lit(1), limit)).alias("pos", "x"))
    return found.select("kind", (F.col("pos") + 1).alias("nth"), "x.subject", "x.detail", "total")


def with_spec(docs: DataFrame, specs: DataFrame, default: str) -> DataFrame:
    """docs (relpath, category) with the first declared spec (pattern, spec_index, category) that fits; the document's own category goes first."""
    hit = docs.select("relpath").join(specs.withColumnRenamed("category", "declared"), F.expr("relpath like pattern"))
    first = hit.groupBy("relpath").agg(F.min_by("declared", "spec_index").alias("declared"))
    return docs.join(first, "relpath", "left").select("relpath", F.coalesce("category", "declared", F.lit(default)).alias("category"))


def config_hash(config: dict) -> str:
    """Sixteen digits over the sorted configuration, top-level keys with `_` aside."""
    kept = {k: v for k, v in config.items() if not k.startswith("_")}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def merged_config(default: dict, own: dict) -> dict:
    """Dictionaries merge; anything else replaces."""
    out = dict(default)
    for k, v in own.items():
        out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def signal_rows(rows: DataFrame) -> DataFrame:
    """Message and signal rows of a matrix (sheet, row, message, id, signal, and sender flags already joined as senders):
    a row with a message opens it, rows after it are its signals; messages in order of their identifier.
    """
    from .events import segments

    cut = segments(rows, "sheet", "row", F.trim("message") != "")
    heads = cut.where(F.trim("message") != "").select("sheet", "segment", "message", "id")
    body = cut.where((F.trim("message") == "") & (F.trim("signal") != "")).groupBy("sheet", "segment").agg(F.count(F.lit(1)).alias("signals"))
    order = F.coalesce(F.conv(F.regexp_extract("id", "^0[xX]([0-9A-Fa-f]+)$", 1), 16, 10).try_cast("long"), F.lit(0xFFFF))
    ranked = Window.partitionBy("sheet").orderBy(order, "segment")
    return heads.join(body, ["sheet", "segment"], "left").select("sheet", F.row_number().over(ranked).alias("rank"), "message", "id", F.coalesce("signals", F.lit(0)).alias("signals"))


def binned(sizes: list[tuple[str, str, int]], most_dirs: int = 4, most_files: int = 30) -> list[tuple[str, list[str]]]:
    """Small directories (dir, ext, files) of one extension to groups of bounded directories and files, greedily in order."""
    out: list[tuple[str, list[str]]] = []
    for ext in sorted({e for _, e, _ in sizes}):
        group, held = [], 0
        for d, _, n in sorted(x for x in sizes if x[1] == ext):
            if group and (len(group) >= most_dirs or held + n > most_files):
                out.append((ext, group))
                group, held = [], 0
            group, held = [*group, d], held + n
        if group:
            out.append((ext, group))
    return out

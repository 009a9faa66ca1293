"""Queries over what the library stores and reads back: paged exports, streams of changes, versioned state, containers."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import cdc, records as rc
from ..sources import archives, tracker, workbooks
from ..sources.scratch import scratch_path
from ..sources.versions import Versions, add_contents, next_state
from ..streaming import renames
from .catalog import CHANGES, _current, _state, query, table

# ---- paged exports


def _export(spark, sf):
    path, orders = scratch_path(spark, "tracker-orders"), table(spark, sf, "orders")
    tracker.export_pages(orders, path, "o_orderkey", page=1000)
    return path, orders.schema


@query(
    "select o_orderkey, o_orderdate, o_totalprice, (select count(*) from orders where o_orderstatus = 'F' and o_orderdate >= date '1994-01-01') as total, "
    "(select count(*) from orders where o_orderstatus = 'F' and o_orderdate >= date '1994-01-01') > 150 as truncated "
    "from orders where o_orderstatus = 'F' and o_orderdate >= date '1994-01-01' order by o_orderdate, o_orderkey limit 50 offset 100"
)
def tracker_search(spark, sf):
    """A search of an export of all orders, its conditions met by the reader: a page, the total, and whether more follows."""
    path, schema = _export(spark, sf)
    wanted = rc.conjunction({"o_orderstatus": "F"}, since={"o_orderdate": F.lit("1994-01-01").cast(schema["o_orderdate"].dataType)})
    rows = tracker.search(spark, path, schema, "o_orderkey", wanted).select("o_orderkey", "o_orderdate", "o_totalprice")
    return rc.page(rows, [F.asc("o_orderdate"), F.col("o_orderkey")], 50, 100)


@query("select o_orderstatus, count(*) as n, min(o_orderkey) as first_key, max(o_orderkey) as last_key from orders where o_orderkey between 100 and 20000 and contains(o_orderpriority, 'URG') group by o_orderstatus")
def tracker_counts(spark, sf):
    """A range of keys and a part of a text: pages outside the range are never opened."""
    path, schema = _export(spark, sf)
    wanted = F.col("o_orderkey").between(100, 20000) & F.col("o_orderpriority").contains("URG")
    return tracker.search(spark, path, schema, "o_orderkey", wanted).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


# ---- changes as a stream


@query(CHANGES + "select kind, relpath, from_path, hash, old_hash from ch")
def streamed_changes(spark, sf):
    """The change set from single observations, each told twice, in an order of their digests, by micro-batches of one file."""
    spark.conf.set(*renames.STORE_CONF)
    state, seen = _state(spark, sf).drop("docno"), _current(spark, sf)
    gone = state.where("not retired").join(seen, "relpath", "left_anti").select("relpath", F.lit(None).cast("string").alias("hash"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("relpath"), F.lit(500)))
    told = seen.select("relpath", "hash").unionByName(gone).withColumn("ts", at)
    root = scratch_path(spark, "observed")
    told.unionByName(told).repartition(4, F.xxhash64("relpath", F.rand(7))).write.parquet(f"{root}/rows")
    closing = spark.range(1).select(F.lit(None).cast("string").alias("relpath"), F.lit(None).cast("string").alias("hash"), F.timestamp_seconds(F.lit(1_700_100_000)).alias("ts"))
    closing.write.mode("append").parquet(f"{root}/rows")
    stream = spark.readStream.schema(told.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/rows")
    changes = renames.change_stream(stream, state, "30 minutes")
    changes.writeStream.format("parquet").option("path", f"{root}/changes").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{root}/changes")


# ---- versioned state


@query(
    CHANGES + ", k as (select c.relpath, docno from ch c join ol on coalesce(from_path, c.relpath) = ol.relpath where kind in ('unchanged', 'modified', 'renamed')), a as (select relpath, row_number() over (order by relpath) as r from ch where kind = 'added'), "
    "f as (select n, row_number() over (order by n) as r from range(1, (select count(*) from ol) + (select count(*) from a) + 1) t(n) where n not in (select cast(docno as bigint) from ol)), "
    "nu as (select relpath, docno from k union all select relpath, case when n < 100 then lpad(cast(n as string), 2, '0') else cast(n as string) end from a join f using (r)), "
    "nw as (select relpath, hash, docno, false as retired from ch join nu using (relpath) where kind <> 'removed'), go as (select relpath, ol.hash, docno, true as retired from ol where relpath in (select relpath from ch where kind = 'removed')) "
    "select * from nw union all select * from go union all select relpath, hash, docno, true from ol where retired and relpath not in (select relpath from nw) and relpath not in (select relpath from go) and relpath not in (select from_path from ch where from_path is not null)"
)
def committed_state(spark, sf):
    """A state published, its change set applied and published as the next version, and that version read back."""
    store = Versions(spark, scratch_path(spark, "state"))
    store.commit(_state(spark, sf), None, "first")

    def applied(state):
        changes = cdc.change_set(_current(spark, sf), state.drop("docno"))
        numbers = cdc.assign_numbers(changes, state, changes.where("kind = 'added'").count())
        return next_state(changes, numbers, state)

    store.update(applied, "second")
    return store.read()


@query("select p_partkey % 100 as key, p_name as body, sha256(p_name) as digest from part group by 1, 2, 3")
def stored_contents(spark, sf):
    """Contents added in two overlapping parts, one of them told twice: each once."""
    rows = table(spark, sf, "part").select(F.expr("p_partkey % 100").alias("key"), F.col("p_name").alias("body"), "p_partkey")
    store = Versions(spark, scratch_path(spark, "contents"))
    for batch, part in (("a", rows.where("p_partkey % 3 <> 0")), ("b", rows.where("p_partkey % 3 <> 1")), ("b", rows.where("p_partkey % 3 <> 1"))):
        found = add_contents(store, part, "key", "body", batch)
    return found


# ---- containers


def _workbooks(spark, sf):
    """relpath, content: a workbook for each thousand orders, with a sheet for each tenth of them by customer."""
    o = table(spark, sf, "orders").select(F.expr("concat('w', cast(o_orderkey div 1000 as string))").alias("relpath"), F.expr("cast(o_custkey % 10 as string)").alias("sheet"), F.expr("cast(o_orderkey % 1000 as int)").alias("row"), F.expr("cast(o_custkey % 7 as int)").alias("col"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("value"))

    def make(key, rows):
        sheets = {s: list(zip(g["row"].tolist(), g["col"].tolist(), g["value"].tolist())) for s, g in rows.groupby("sheet")}
        return pd.DataFrame({"relpath": [key[0]], "content": [workbooks.workbook_bytes(sheets)]})

    return o.groupBy("relpath").applyInPandas(make, "relpath string, content binary")


@query("select concat('w', cast(o_orderkey // 1000 as varchar)) as relpath, cast(o_custkey % 10 as varchar) as sheet, cast(o_orderkey % 1000 as integer) as \"row\", cast(o_custkey % 7 as integer) as col, o_orderpriority || ' ' || o_orderstatus as value from orders")
def workbook_cells(spark, sf):
    """Orders in workbooks of a thousand, read back cell by cell."""
    return workbooks.sheet_cells(_workbooks(spark, sf))


def _bundles(spark, sf):
    """relpath, content: a tar for each hundred pages, holding them as a zip of pages and one page as it is."""

    def make(key, rows):
        rows = rows.sort_values("page_id")
        inner, outer = io.BytesIO(), io.BytesIO()
        named = [(f"{i}.html", (h or "").encode()) for i, h in zip(rows["page_id"], rows["html"])]
        with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in named[1:]:
                z.writestr(name, body)
        with tarfile.open(fileobj=outer, mode="w:gz", compresslevel=1) as t:
            for name, body in (named[0], ("rest.zip", inner.getvalue())):
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
        return pd.DataFrame({"relpath": [f"b{key[0]}"], "content": [outer.getvalue()]})

    pages = table(spark, sf, "pages").select(F.expr("page_id div 100").alias("bundle"), "page_id", "html")
    return pages.groupBy("bundle").applyInPandas(make, "relpath string, content binary")


@query(
    "select concat('b', cast(page_id // 100 as varchar), case when page_id = min(page_id) over (partition by page_id // 100) then '!/' else '!/rest.zip!/' end, cast(page_id as varchar), '.html') as relpath, "
    "octet_length(encode(coalesce(html, ''))) as bytes, md5(coalesce(html, '')) as digest from pages"
)
def archived_pages(spark, sf):
    """Pages in zips in compressed tars, read back member by member in chunks of 4 KB, joined again for their digests."""
    parts = archives.member_chunks(_bundles(spark, sf), chunk=4096).where("note is null")
    whole = parts.groupBy("relpath").agg(F.sort_array(F.collect_list(F.struct("chunk", "content"))).alias("c"))
    content = F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["content"])), ""))
    return whole.select("relpath", F.length(content).cast("long").alias("bytes"), F.md5(content).alias("digest"))

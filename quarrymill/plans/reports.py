"""Further queries of the catalog: lookups, assertions and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evidence as evd, lines as ln, modules as mo, records as rc
from .catalog import FILES_SQL, HEADS, HITS, MD_SQL, MODULES_SQL, _hits, md_lines, query, repo_files, repo_modules, table


@query("select c_custkey, case when c_custkey % 3 = 0 and c_custkey % 5 <> 0 then null else c_name end as name, case when c_custkey % 5 = 0 then null else c_mktsegment end as display, not (c_custkey % 3 = 0 and c_custkey % 5 <> 0) or c_custkey % 5 <> 0 as known from customer")
def flat_users(spark, sf):
    k = F.col("c_custkey")
    user = F.struct(F.when((k % 3 == 0) & (k % 5 != 0), " ").otherwise(F.col("c_name")).alias("name"), F.lit("").alias("key"), F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("displayName"), F.lit(None).cast("string").alias("email"))
    return table(spark, sf, "customer").withColumn("u", evd.flat_user(user)).select("c_custkey", F.col("u.name").alias("name"), F.col("u.display").alias("display"), F.col("u").isNotNull().alias("known"))


@query("with r as (select *, row_number() over (partition by n_regionkey order by n_name) as n, count(*) over (partition by n_regionkey) as c from nation) select n_regionkey, string_agg(n_name, ',' order by n_name) as shown, max(c) - count(*) as more from r where n <= 3 group by n_regionkey")
def allowed_values(spark, sf):
    return evd.allowed_values(table(spark, sf, "nation"), "n_regionkey", "n_name", 3)


BODIES = ["hello! world", "wow! see !a.png! end", "see !Shot.PNG! and [other.log] end", "!shot.png!!A.png!", "none", "!a b.png! or !x y.pdf!"]
BODY_SQL = "(" + "[" + ", ".join(f"'{b}'" for b in BODIES) + "])[cast(c_custkey % 6 as integer) + 1]"


@query(
    f"with t as (select c_custkey as key, {BODY_SQL} as body from customer), a as (select key, case when key % 2 = 0 then replace(replace(body, '!Shot.PNG!', concat('[files/', key::varchar, ']')), '!shot.png!', concat('[files/', key::varchar, ']')) else body end as body from t) "
    "select key, 1 as id, case when key % 3 = 0 then replace(replace(replace(body, '!a.png!', '[img/a]'), '!A.png!', '[img/a]'), '!x y.pdf!', '[doc]') else body end as body from a"
)
def localised(spark, sf):
    c = table(spark, sf, "customer").withColumn("key", F.col("c_custkey"))
    body = F.element_at(F.array(*map(F.lit, BODIES)), (F.col("c_custkey") % 6).cast("int") + 1)
    named = lambda rows, name, local: rows.select("key", F.lit(name).alias("filename"), local.alias("local"))
    files = named(c.where("key % 2 = 0"), "Shot.png", F.concat(F.lit("files/"), F.col("key").cast("string")))
    files = files.unionByName(named(c.where("key % 3 = 0"), "a.PNG", F.lit("img/a"))).unionByName(named(c.where("key % 3 = 0"), "x y.pdf", F.lit("doc")))
    return evd.localised(c.select("key", F.lit(1).alias("id"), body.alias("body")), files)


QUICK = HEADS + ", de as (select docno, text as key, line from he where depth = 2), ro as (select distinct docno, case when line % 5 = 0 then 'none' else text end as key from he where depth <= 3) "


def _quick(spark, sf):
    h = ln.headings(md_lines(spark, sf))
    details = h.where("depth = 2").select("docno", F.col("text").alias("key"), "line")
    rows = h.where("depth <= 3").select("docno", F.when(F.col("line") % 5 == 0, "none").otherwise(F.col("text")).alias("key")).distinct()
    return rows, details


@query(QUICK + "select ro.docno, ro.key, coalesce(max(line), 0) as detail_line from ro left join de on ro.docno = de.docno and ro.key = de.key group by all")
def quick_table(spark, sf):
    return evd.quick_table(*_quick(spark, sf))


@query(
    QUICK + ", qt as (select ro.docno, ro.key, coalesce(max(line), 0) as detail_line from ro left join de on ro.docno = de.docno and ro.key = de.key group by all), mo as (select docno, key, case when detail_line % 3 = 1 then detail_line + 1 else detail_line end as detail_line from qt) "
    "select docno, key, detail_line from mo where not exists (select 1 from de where de.docno = mo.docno and de.key = mo.key and de.line = mo.detail_line)"
)
def wrong_lines(spark, sf):
    """A table whose documents were edited since: every third line is one off."""
    rows, details = _quick(spark, sf)
    moved = F.when(F.col("detail_line") % 3 == 1, F.col("detail_line") + 1).otherwise(F.col("detail_line"))
    return evd.wrong_lines(evd.quick_table(rows, details).withColumn("detail_line", moved), details)


@query(f"with {MODULES_SQL} select id, prefix from modules where not exists (select 1 from nation where contains(concat('see src', n_nationkey::varchar, '/ and SRC1/'), prefix))")
def unmapped_prefixes(spark, sf):
    document = table(spark, sf, "nation").select(F.concat(F.lit("see src"), F.col("n_nationkey").cast("string"), F.lit("/ and SRC1/")).alias("text"))
    return evd.unmapped_prefixes(repo_modules(spark), document)


@query(f"with {FILES_SQL} select regexp_extract(rel, '^(.*)/[^/]*$', 1) as dir, count(*) as members, cast(sum(size) as bigint) as bytes, min(rel) as first from files group by 1")
def log_groups(spark, sf):
    return evd.groups_by_dir(repo_files(spark, sf).select(F.col("rel").alias("path"), F.col("size").alias("bytes")))


@query("select case p_size % 5 when 0 then 'image' when 1 then 'video' when 2 then 'archive' when 3 then 'dbc' else 'unknown' end as kind, count(*) as n from part group by 1")
def evidence_counts(spark, sf):
    name = F.concat(F.lit("f."), F.element_at(F.array(*map(F.lit, ["PNG", "mp4", "zip", "dbc", "weird"])), (F.col("p_size") % 5).cast("int") + 1))
    return rc.counted(table(spark, sf, "part").select(tx.attachment_kind(name).alias("kind")), "kind")


@query(f"with {FILES_SQL} select p_partkey as doc, concat('./src0/Mod', (p_partkey % 9)::varchar, '/f', p_partkey::varchar, '.c#top') as target from part where concat('src0/Mod', (p_partkey % 9)::varchar, '/f', p_partkey::varchar, '.c') not in (select rel from files)")
def broken_links(spark, sf):
    text = F.concat(F.lit("[a](http://x/y) [b](#z) [c](./src0/Mod"), (F.col("p_partkey") % 9).cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"), F.lit(".c#top)"))
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), text.alias("text"))
    return evd.broken_links(docs, tx.links("text"), repo_files(spark, sf))


@query(HITS + ", r as (select *, row_number() over (partition by docno, term order by hits desc, first_line) as rank from hi), i as (select * from hi where first_line % 2 = 0) select docno, term, section from r where rank = 1 and not exists (select 1 from i where i.docno = r.docno and i.term = r.term and i.section = r.section)")
def unindexed_sections(spark, sf):
    hits = _hits(spark, sf)
    return evd.unindexed(ln.top_sections(hits, 1, 1, 1).select("docno", "term", "section"), hits.where("first_line % 2 = 0").select("docno", "term", "section"))


SPECS = [("src0/%", 0, "core"), ("%.md", 1, "docs"), ("src%", 2, "code")]


@query(f"with {FILES_SQL} select rel as relpath, case when loc = 7 then 'own' when starts_with(rel, 'src0/') then 'core' when ends_with(rel, '.md') then 'docs' when loc < 0 then 'x' else 'code' end as category from files")
def document_specs(spark, sf):
    docs = repo_files(spark, sf).select(F.col("rel").alias("relpath"), F.when(F.col("loc") == 7, "own").alias("category"))
    return evd.with_spec(docs, spark.createDataFrame(SPECS, "pattern string, spec_index int, category string"), "none")


MATRIX = "select cast(o_orderkey // 2000 as string) as sheet, cast(row_number() over (partition by o_orderkey // 2000 order by o_orderkey) as integer) as \"row\", o_orderkey as k from orders"


@query(
    f"with m as ({MATRIX}), r as (select sheet, \"row\", case when k % 6 = 0 then concat('M', k::varchar) else '' end as message, case when k % 12 = 0 then concat('0x', lower(to_hex(k % 4096))) else 'bad' end as id, case when k % 5 = 0 then ' ' else 'sig' end as signal, k from m), "
    "s as (select *, sum(case when message <> '' then 1 else 0 end) over (partition by sheet order by \"row\") as g from r), b as (select sheet, g, count(*) as signals from s where message = '' and trim(signal) <> '' group by all) "
    "select h.sheet, cast(row_number() over (partition by h.sheet order by case when k % 12 = 0 then k % 4096 else 65535 end, h.g) as integer) as rank, message, id, coalesce(signals, 0) as signals from s h left join b on b.sheet = h.sheet and b.g = h.g where message <> ''"
)
def signal_matrix(spark, sf):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    sheet = F.expr("cast(o_orderkey div 2000 as string)")
    rows = table(spark, sf, "orders").select(
        sheet.alias("sheet"), F.row_number().over(Window.partitionBy(F.expr("o_orderkey div 2000")).orderBy("o_orderkey")).alias("row"), F.when(k % 6 == 0, F.concat(F.lit("M"), k.cast("string"))).otherwise("").alias("message"),
        F.when(k % 12 == 0, F.concat(F.lit("0x"), F.lower(F.hex(k % 4096)))).otherwise("bad").alias("id"), F.when(k % 5 == 0, " ").otherwise("sig").alias("signal"),
    )
    return evd.signal_rows(rows)


@query("select s_suppkey, concat('https://tracker.example/browse/T-', s_suppkey::varchar) as url, date '2024-01-01' + cast(s_suppkey as integer) as due, concat('Ticket T-', s_suppkey::varchar, ' of ', s_name) as note, 'T' as message from supplier")
def rendered_tickets(spark, sf):
    from ..sources.sinks import filled

    key = F.concat(F.lit("T-"), F.col("s_suppkey").cast("string"))
    body = F.when(F.col("s_suppkey") % 2 == 0, '{"errorMessages":["T","x"]}').otherwise("T")
    return table(spark, sf, "supplier").select("s_suppkey", tx.browse_url("https://tracker.example/", key).alias("url"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("s_suppkey").cast("int")).alias("due"), filled("Ticket {key} of {name}", {"key": key, "name": F.col("s_name")}).alias("note"), tx.error_message(body).alias("message"))


@query(f"with {FILES_SQL}, {MODULES_SQL} select id, count(distinct rel) as files, max(prefix) as prefix from modules join files on starts_with(lower(rel), lower(prefix)) group by id")
def module_sizes(spark, sf):
    up = repo_files(spark, sf).select("rel", F.explode(mo.ancestors(F.lower("rel"))).alias("p"))
    return up.join(repo_modules(spark), F.col("p") == F.lower("prefix")).groupBy("id").agg(F.countDistinct("rel").alias("files"), F.max("prefix").alias("prefix"))


@query(f"with {MD_SQL} select docno, line, text from md where regexp_matches(text, '^#+ ') and not regexp_matches(text, 'Deep')")
def reserved_sections(spark, sf):
    lines = md_lines(spark, sf)
    return lines.where(F.col("text").rlike("^#+ ")).join(lines.where(F.col("text").contains("Deep")).select("docno", "line"), ["docno", "line"], "left_anti").select("docno", "line", "text")


@query(f"with {MD_SQL} select docno, line, text, docno % 10 = 0 as reserved from md where regexp_matches(text, '^#+ ') and not regexp_matches(text, 'Deep')")
def all_sections(spark, sf):
    """`reserved_sections` with whether a document's number is reserved as a column."""
    lines = md_lines(spark, sf)
    kept = lines.where(F.col("text").rlike("^#+ ")).join(lines.where(F.col("text").contains("Deep")).select("docno", "line"), ["docno", "line"], "left_anti")
    return kept.select("docno", "line", "text", (F.col("docno") % 10 == 0).alias("reserved"))

"""Queries over tickets' plans and dimensions, module ranks, findings, and files that are written and scanned again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evidence as evd, lines as ln, modules as mo, planned as pl, sheets as sh
from ..sources import scans, sinks, workbooks
from ..sources.scratch import scratch_path
from .catalog import FILES_SQL, LINES_SQL, MD_SQL, MODULES_SQL, REL, ROUTED_SQL, doc_lines, md_lines, query, repo_files, repo_modules, table
from .stored import _workbooks

# ---- modules


@query(
    f"with {FILES_SQL}, {MODULES_SQL}, {ROUTED_SQL}, c as (select module as id, count(*) as churn from lineitem join (select p_partkey as k, {REL} as path from part) on l_partkey = k join routed on rel = path where l_shipdate >= timestamp '1998-06-01' - interval 200 days group by module), "
    "s as (select module as id, count(*) as files from routed group by module), m as (select id, coalesce(churn, 0) as churn, coalesce(files, 0) as files from modules left join c using (id) left join s using (id)) "
    "select id, churn, files, row_number() over (order by churn desc, files desc, id) as rank from m"
)
def ranked_modules(spark, sf):
    paths = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr(REL).alias("path"))
    changes = table(spark, sf, "lineitem").join(paths, "l_partkey").select("path", F.col("l_shipdate").alias("ts"))
    return mo.ranked_modules(repo_files(spark, sf), changes, repo_modules(spark), F.lit("1998-06-01").cast("timestamp_ntz"), 200)


# ---- findings

OVER = f"select 'budget' as kind, cast(docno as varchar) as subject, count(*) || ' of ' || case when docno % 3 = 0 then 60 else 80 end as detail from md group by docno having count(*) > case when docno % 3 = 0 then 60 else 80 end"
EMPTY = "select 'empty_section', cast(docno as varchar), cast(line as varchar) from (select *, first_value(case when trim(text) <> '' then text end ignore nulls) over (partition by docno order by line rows between 1 following and unbounded following) as f from md) where starts_with(text, '## ') and (f is null or starts_with(f, '## '))"
TWICE = "select 'repeated_line', left(trim(text), 40), cast(count(distinct docno) as varchar) from ls where length(trim(text)) >= 12 group by trim(text) having count(distinct docno) >= 2"
UNMAPPED = "select 'unmapped', id, prefix from modules where not exists (select 1 from nation where contains(concat('see src', n_nationkey::varchar, '/ and SRC1/'), prefix))"


@query(
    f"with {MD_SQL}, {LINES_SQL}, {MODULES_SQL}, a as ({OVER} union all {EMPTY} union all {TWICE} union all {UNMAPPED}), r as (select *, row_number() over (partition by kind order by subject, detail) as nth, count(*) over (partition by kind) as total from a) "
    "select kind, cast(nth as integer) as nth, subject, detail, total from r where nth <= case kind when 'budget' then 8 when 'empty_section' then 5 when 'repeated_line' then 20 else 10 end"
)
def lint_findings(spark, sf):
    """The checks of a documentation tree in one table, each kind up to its own limit and with its total."""
    lines = md_lines(spark, sf)
    budgets = lines.where("docno % 3 = 0").select("docno").distinct().withColumn("budget", F.lit(60))
    over = ln.over_budget(lines, budgets).select(F.col("docno").alias("subject"), F.concat_ws(" of ", F.col("lines").cast("string"), F.col("budget").cast("string")).alias("detail"))
    empty = ln.empty_sections(lines).select(F.col("docno").alias("subject"), F.col("line").alias("detail"))
    twice = ln.repeated_lines(doc_lines(spark, sf)).select(F.left("text", F.lit(40)).alias("subject"), F.col("docs").alias("detail"))
    root = table(spark, sf, "nation").select(F.concat(F.lit("see src"), F.col("n_nationkey").cast("string"), F.lit("/ and SRC1/")).alias("text"))
    unmapped = evd.unmapped_prefixes(repo_modules(spark), root).select(F.col("id").alias("subject"), F.col("prefix").alias("detail"))
    return evd.findings({"budget": over, "empty_section": empty, "repeated_line": twice, "unmapped": unmapped}, {"budget": 8, "empty_section": 5, "repeated_line": 20})


# ---- plans

WHO = "case when o_orderkey % 4 = 0 then cast(o_custkey as string) when o_orderkey % 4 = 1 then concat('Customer ', cast(o_custkey % 50 as string)) else 'nobody' end"
WATCH_SQL = (
    f"wa as (select distinct o_orderkey // 8 as key, {WHO} as who, case when o_orderkey % 3 = 0 then 'remove' else 'add' end as op from orders), us as (select c_custkey as id, concat('Customer ', cast(c_custkey % 90 as string)) as name from customer), "
    "kn as (select who, count(distinct id) as n, min(id) as id from (select distinct who from wa) left join us on who = cast(id as string) or who = name group by who), "
    "th as (select distinct o_orderkey // 8 as key, o_custkey as id from orders where o_orderkey % 8 < 3), "
    "pl as (select wa.key, who, case when n = 1 then kn.id end as user_, case when n = 0 then 'missing' when n > 1 then 'ambiguous' else 'ok' end as status, op, th.id is not null as there from wa join kn using (who) left join th on th.key = wa.key and th.id = case when n = 1 then kn.id end), "
    "pw as (select key, who, user_ as user, case when status <> 'ok' then 'fail' when (op = 'add') = there then 'skip' else op end as action, case when status <> 'ok' then 'user is ' || status when (op = 'add') = there then case when there then 'watches already' else 'doesn''t watch' end end as reason from pl)"
)


def _watchers(spark, sf):
    orders = table(spark, sf, "orders").withColumn("key", F.expr("o_orderkey div 8"))
    wanted = orders.select("key", F.expr(WHO).alias("who"), F.expr("case when o_orderkey % 3 = 0 then 'remove' else 'add' end").alias("op"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr("concat('Customer ', cast(c_custkey % 90 as string))").alias("name"))
    return pl.planned_watchers(wanted, users, orders.where("o_orderkey % 8 < 3").select("key", F.col("o_custkey").alias("id")))


@query(f"with {WATCH_SQL} select * from pw")
def planned_watchers(spark, sf):
    return _watchers(spark, sf)


@query(
    f"with {WATCH_SQL}, f as (select key, who || ': ' || reason as t, row_number() over (partition by key order by who) as n from pw where action = 'fail') "
    "select key, count_if(action not in ('skip', 'fail')) as acts, count_if(action = 'skip') as skipped, count_if(action = 'fail') as failed, coalesce((select list(t order by n) from f where f.key = pw.key and n <= 2), []) as failures from pw group by key"
)
def plan_outcomes(spark, sf):
    return pl.plan_outcome(_watchers(spark, sf), "who", most=2)


@query(
    "with w as (select distinct p_partkey // 4 as key, 'f' || p_size as filename from part), fi as (select 'f' || (p_partkey % 60) as filename, count(*) as n from part where p_partkey % 60 < 45 and p_partkey // 60 < 1 + p_partkey % 3 group by 1), "
    "t as (select distinct p_partkey // 4 as key, 'f' || p_size as filename from part where p_partkey % 4 = 1) "
    "select w.key, w.filename, case when coalesce(n, 0) <> 1 then 'fail' when t.key is not null then 'skip' else 'upload' end as action, case when n is null then 'no such file' when n > 1 then n || ' files of that name' when t.key is not null then 'attached already' end as reason "
    "from w left join fi using (filename) left join t on t.key = w.key and t.filename = w.filename"
)
def planned_attachments(spark, sf):
    p = table(spark, sf, "part").withColumn("key", F.expr("p_partkey div 4")).withColumn("filename", F.concat(F.lit("f"), F.col("p_size").cast("string")))
    files = p.where("p_partkey % 60 < 45 and p_partkey div 60 < 1 + p_partkey % 3").select(F.expr("concat('f', cast(p_partkey % 60 as string))").alias("filename"), F.col("p_size").alias("size"))
    return pl.planned_attachments(p, files, p.where("p_partkey % 4 = 1"))


# ---- dimensions


@query(
    "select c_custkey, cast(t as varchar) as id, 'To ' || t as name, case t when 1 then c_mktsegment else 'done' end as to_status, case when t = 1 then 'open' end as category, t = 1 as has_screen, case when t = 1 and c_custkey % 2 = 0 then ['due', 'resolution'] when t = 1 then ['resolution'] else [] end as required "
    "from customer, (values (1), (2)) v(t) where t = 1 or c_custkey % 3 = 0"
)
def transition_list(spark, sf):
    """Transitions of each ticket from the tracker's own answer, with the fields that their screens require."""
    one = "named_struct('id', '1', 'name', 'To 1', 'hasScreen', true, 'to', named_struct('name', c_mktsegment, 'statusCategory', named_struct('name', 'open')), 'fields', map('resolution', named_struct('required', true, 'name', 'Resolution'), 'due', named_struct('required', c_custkey % 2 = 0, 'name', 'Due'), 'note', named_struct('required', false, 'name', 'Note')))"
    two = "named_struct('id', '2', 'name', 'To 2', 'to', named_struct('name', 'done'))"
    sent = F.expr(f"concat('{{\"transitions\":[', to_json({one}), case when c_custkey % 3 = 0 then concat(',', to_json({two})) else '' end, ']}}')")
    return pl.transitions(table(spark, sf, "customer").select("c_custkey", sent.alias("sent")))


@query("select n_regionkey, 10 + count(*) as watch_count, list(n_name order by n_name) as watchers from nation group by n_regionkey")
def watcher_lists(spark, sf):
    sent = F.to_json(F.struct((F.count(F.lit(1)) + 10).alias("watchCount"), F.collect_list(F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("name"), F.col("n_name").alias("displayName"))).alias("watchers")))
    return pl.watchers(table(spark, sf, "nation").groupBy("n_regionkey").agg(sent.alias("sent")))


@query("with r as (select c_nationkey as \"group\", c_name as name, c_mktsegment as display, row_number() over (partition by c_nationkey order by c_name) as nth from customer where c_custkey % 7 <> 0 and (contains(lower(c_name), '11') or contains(lower(c_mktsegment), '11'))) select \"group\", name, display, true as active, cast(nth as integer) as nth from r where nth <= 5")
def assignable_users(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("group"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("display"), (F.col("c_custkey") % 7 != 0).alias("active"))
    return pl.assignable(c, "11", 5)


# ---- paths and files


@query(
    "select p_partkey, case when p_size % 2 = 0 then 'strasse/' || lower(p_brand) else 'a/' || lower(p_brand) end as folded, case p_size % 4 when 0 then '../lib/f' || p_partkey when 1 then 'f' || p_partkey when 2 then '../../other/f' || p_partkey else '.' end as relative from part"
)
def path_forms(spark, sf):
    folded = tx.casefolded(F.expr("concat(case when p_size % 2 = 0 then 'Straße\\\\' else './A/' end, p_brand)"))
    path = F.expr("case p_size % 4 when 0 then concat('src/lib/f', cast(p_partkey as string)) when 1 then concat('src/core/f', cast(p_partkey as string)) when 2 then concat('other/f', cast(p_partkey as string)) else './src/core' end")
    return table(spark, sf, "part").select("p_partkey", folded.alias("folded"), tx.relative_to(path, F.lit("src/core")).alias("relative"))


def _tree(spark, sf):
    """Names of suppliers in text files, one for each directory kind/nation."""
    path = scratch_path(spark, "tree")
    s = table(spark, sf, "supplier").select(F.expr("concat('k', cast(s_nationkey % 3 as string))").alias("kind"), F.expr("concat('n', cast(s_nationkey as string))").alias("nation"), "s_suppkey", F.concat("s_name", F.lit(" é")).alias("value"))
    s.repartition("kind", "nation").sortWithinPartitions("kind", "nation", "s_suppkey").drop("s_suppkey").write.partitionBy("kind", "nation").text(path)
    return path


@query("select 'kind=k' || (s_nationkey % 3) || '/nation=n' || s_nationkey as dir, case s_nationkey % 3 when 1 then 0 else 1 end as spec_index, cast(sum(octet_length(encode(s_name)) + 4) as bigint) as size from supplier where s_nationkey <> 7 group by s_nationkey")
def scanned_files(spark, sf):
    """Files by ordered specifications: a directory, then a glob; one directory is excluded, the marker files belong to none."""
    found = scans.scan_files(spark, _tree(spark, sf), ["kind=k1/", "**/*.txt"], excludes=["/nation=n7/", r"(^|/)[._][^/]*$"])
    return found.select(F.regexp_extract("relpath", "^(.*)/[^/]*$", 1).alias("dir"), "spec_index", "size")


@query("select 'nation=n' || s_nationkey as dir, md5(string_agg(s_name || ' é' || chr(10), '' order by s_suppkey)) as digest from supplier group by s_nationkey")
def scanned_texts(spark, sf):
    found = scans.read_texts(scans.scan_files(spark, _tree(spark, sf), ["**/*.txt"], content=True))
    return found.select(F.regexp_extract("relpath", "(nation=[^/]*)", 1).alias("dir"), F.md5("text").alias("digest"))


@query("select 'kind=k' || (s_nationkey % 3) || '/nation=n' || s_nationkey as dir, (select count(distinct s_nationkey) from supplier where s_nationkey % 3 <> 2) > 10 as approx from supplier where s_nationkey % 3 <> 2 group by s_nationkey order by dir limit 10")
def capped_tree(spark, sf):
    """A source tree without one directory, its first ten files and whether there are more."""
    tree = scans.source_tree(scans.scan_files(spark, _tree(spark, sf), ["**/*.txt"]), ["kind=k2"], [".txt"], cap=10)
    return tree.select(F.regexp_extract("relpath", "^(.*)/[^/]*$", 1).alias("dir"), "approx")


@query("select event_id, event_type from events where event_id % 11 <> 0")
def event_lines(spark, sf):
    """JSON lines read back; every eleventh is cut short, and blank lines stand between."""
    path = scratch_path(spark, "lines")
    line = F.to_json(F.struct("event_id", "event_type"))
    broken = F.when(F.col("event_id") % 11 == 0, F.concat(F.left(line, F.length(line) - 3), F.lit("\n\n"))).otherwise(line)
    table(spark, sf, "events").select(broken.alias("value")).write.text(path)
    return scans.json_lines(spark, path, "event_id long, event_type string")


@query("select n_nationkey, n_name, date '2024-05-01' as run_date from nation union all select n_nationkey, upper(n_name), date '2024-05-02' from nation where n_nationkey % 2 = 0")
def dated_sink(spark, sf):
    """Two dated runs beside each other, neither inside the input; a third to a date that is there is refused."""
    path, nation = scratch_path(spark, "dated"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    sinks.write_new(nation, path, [sf], "2024-05-01")
    sinks.write_new(nation.where("n_nationkey % 2 = 0").withColumn("n_name", F.upper("n_name")), path, [sf], "2024-05-02")
    try:
        sinks.write_new(nation, path, [sf], "2024-05-02")
    except Exception:
        return spark.read.parquet(path)
    raise AssertionError("a dated run was written twice")


@query("select p_partkey, p_brand from part where p_partkey = 5")
def one_attachment(spark, sf):
    """The file of an exact name, which must be one."""
    files = table(spark, sf, "part").select("p_partkey", "p_brand", F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit(".log")).alias("filename"))
    return scans.unique_by_name(files, "part-5.log").select("p_partkey", "p_brand")


@query(
    "with c as (select concat('w', cast(o_orderkey // 1000 as varchar), '/', cast(o_custkey % 10 as varchar)) as sheet, cast(o_orderkey % 1000 as integer) as r, max(case when o_custkey % 7 = 1 then o_orderpriority || ' ' || o_orderstatus end) as name, max(case when o_custkey % 7 = 3 then o_orderpriority || ' ' || o_orderstatus end) as id, max(case when o_custkey % 7 = 1 or o_custkey % 7 = 4 then o_orderpriority || ' ' || o_orderstatus end) as opens from orders group by 1, 2), "
    "s as (select *, count(*) filter (opens is not null) over (partition by sheet order by r) as segment from c) select sheet, cast(count(distinct segment) as bigint) as messages, count(*) as rows from s where segment > 0 group by sheet"
)
def matrix_messages(spark, sf):
    """Message matrices read from workbooks: a row with a name opens a message, which the rows after it belong to."""
    cells = workbooks.sheet_cells(_workbooks(spark, sf)).select(F.concat_ws("/", "relpath", "sheet").alias("sheet"), "row", "col", "value")
    doubled = cells.unionByName(cells.where("col in (1, 4)").withColumn("col", F.lit(9)))
    spec = {"structured": {"kind": "can_matrix", "structured_rules": {"columns": {"name": 9, "id": 9, "first": 1}, "column_header_row": -1}}}
    found = sh.structured(spec, doubled)["messages"]
    return found.groupBy("sheet").agg(F.countDistinct("segment").alias("messages"), F.count(F.lit(1)).alias("rows"))

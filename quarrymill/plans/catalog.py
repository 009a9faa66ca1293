"""Queries over the Parquet tables: each operator applied to a whole table, beside SQL written from its definition.

Tables that the operators need and the data lacks (Markdown lines, repository paths, tickets) are projections of
tables that are there; a projection's text is the same in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cdc, events as ev, lines as ln, modules as mo, records as rc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- projections

MD_ORDER = "l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus"
MD_TEXT = """case when l_partkey % 122 = 0 then '~~~' when l_partkey % 183 = 0 then '```text' when l_partkey % 61 = 0 then '```' when l_partkey % 23 = 0 then '' when l_partkey % 47 = 1 then concat('## ', cast(l_partkey % 7 + 1 as string), '.', cast(l_linenumber as string), ' Part ', l_returnflag)
 when l_partkey % 47 = 2 then concat('### Item ', l_linestatus) when l_partkey % 47 = 3 then '| --- | --- |' when l_partkey % 47 = 4 then '| a | b |' when l_partkey % 47 = 5 then '##### Deep'
 when l_partkey % 53 = 7 then concat('Page ', cast(l_partkey % 9 as string)) when l_partkey % 59 = 8 then 'trailing blank ' when l_partkey % 67 = 9 then '# Title'
 else concat('row ', cast(l_partkey as string), ' of flag ', l_returnflag, ' ', l_linestatus) end"""
MD_SQL = f"md as (select l_suppkey as docno, cast(row_number() over (partition by l_suppkey order by {MD_ORDER}) as integer) as line, {MD_TEXT} as text from lineitem)"
LINES_SQL = "ls as (select doc_id as docno, cast(unnest(generate_series(1, len(p))) as integer) as line, unnest(p) as text from (select doc_id, string_split(text, chr(10)) as p from documents))"
# a block is closed by the mark that opened it: fence lines are walked one by one
FENCE_SQL = r"""
fl as (select docno, line, regexp_extract(text, '^\s*(```|~~~)', 1) as mark, row_number() over (partition by docno order by line) as i from md where regexp_matches(text, '^\s*(```|~~~)')),
fo as (
  select docno, i, line, mark as open, '' as was from fl where i = 1
  union all select fl.docno, fl.i, fl.line, case fo.open when '' then fl.mark when fl.mark then '' else fo.open end, fo.open from fo join fl on fl.docno = fo.docno and fl.i = fo.i + 1),
fe as (
  select md.docno, md.line, md.text, fo.line is not null and fo.line = md.line as is_fence, coalesce(fo.open, '') <> '' or (fo.line is not null and fo.line = md.line) as fenced, coalesce(fo.was, '') as was
  from md asof left join fo on md.docno = fo.docno and md.line >= fo.line)"""
HEAD_SQL = r"he as (select docno, line, length(regexp_extract(text, '^(#{1,6})\s+(.*?)\s*$', 1)) as depth, trim(regexp_extract(text, '^(#{1,6})\s+(.*?)\s*$', 2)) as text from fe where not fenced and regexp_matches(text, '^#{1,6}\s+'))"
HEADS = f"with recursive {MD_SQL}, {FENCE_SQL}, {HEAD_SQL} "

REL = "concat('src', cast(p_partkey % 5 as string), case when p_partkey % 11 = 0 then '' else concat('/Mod', cast(p_partkey % 7 as string)) end, case when p_partkey % 3 = 0 then concat('/sub', cast(p_partkey % 2 as string)) else '' end, '/f', cast(p_partkey as string), case when p_size % 3 = 0 then '.py' when p_size % 3 = 1 then '.c' else '.md' end)"
FILES_SQL = f"files as (select {REL} as rel, cast(p_size * 40000 as bigint) as size, cast(p_size as bigint) as loc, md5(cast(p_partkey as string)) as hash from part)"
MODULES = [("api", "src0/"), ("api-core", "src0/mod1/"), ("web", "SRC1/"), ("web-sub", "src1/mod2/sub0/"), ("gone", "src9/"), ("tools", "src2/mod3/")]
MODULES_SQL = "modules(id, prefix) as (values " + ", ".join(f"('{i}', '{p}')" for i, p in MODULES) + ")"
ROUTED_SQL = "routed as (select rel, max_by(id, (length(prefix), id)) as module from (select f.rel, f.size, m.id, m.prefix from files f left join modules m on starts_with(lower(f.rel), lower(m.prefix))) group by rel)"


def md_lines(spark: SparkSession, sf: str) -> DataFrame:
    # rows are dealt by docno itself, so that later windows need no other shuffle, and get their texts after it
    w = Window.partitionBy("docno").orderBy(*[c.strip() for c in MD_ORDER.split(",")])
    rows = table(spark, sf, "lineitem").withColumn("docno", F.col("l_suppkey")).withColumn("line", F.row_number().over(w))
    return rows.select("docno", "line", F.expr(MD_TEXT).alias("text"))


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return ln.to_lines(table(spark, sf, "documents"))


def repo_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.expr(REL).alias("rel"), F.expr("cast(p_size * 40000 as bigint)").alias("size"), F.col("p_size").cast("long").alias("loc"), F.md5(F.col("p_partkey").cast("string")).alias("hash"))


def repo_modules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODULES, "id string, prefix string")


# ---- lines


@query(f"with {LINES_SQL} select docno, count(*) as lines, cast(sum(length(text)) as bigint) as chars, max(length(text)) as longest from ls group by docno")
def line_stats(spark, sf):
    return ln.line_stats(doc_lines(spark, sf))


@query(HEADS + "select docno, line, depth, text from he")
def headings(spark, sf):
    return ln.headings(md_lines(spark, sf))


@query(HEADS + "select docno, depth, count(*) as n from he group by docno, depth")
def level_histogram(spark, sf):
    return ln.level_histogram(ln.headings(md_lines(spark, sf)))


@query(f"with {MD_SQL}, b as (select *, lag(trim(text) = '') over (partition by docno order by line) as pb from md) select docno, cast(row_number() over (partition by docno order by line) as integer) as line, case when trim(text) = '' then '' else text end as text from b where not (trim(text) = '' and coalesce(pb, false))")
def collapse_blank(spark, sf):
    return ln.collapse_blank(md_lines(spark, sf))


COLLAPSE = "select docno, row_number() over (partition by docno order by line) as line, text from (select *, lag(text = '') over (partition by docno order by line) as pb from {0}) where not (text = '' and coalesce(pb, false))"


@query(
    f"with {MD_SQL}, a as ({COLLAPSE.format('md')}), g as (select a.*, (select arg_max(b.text, b.line) from a b where b.docno = a.docno and b.line < a.line and b.text <> '| --- | --- |') as prev from a), "
    f"k as (select docno, line, text from g where text <> '| --- | --- |' or coalesce(starts_with(prev, '|'), false)), z as ({COLLAPSE.format('k')}) select docno, cast(line as integer) as line, text from z"
)
def orphan_separators(spark, sf):
    return ln.drop_orphan_separators(md_lines(spark, sf))


@query(f"with {MD_SQL} select docno, line, text from md where not regexp_matches(trim(text), '^(Page [0-9]+|# Title$)')")
def footers(spark, sf):
    return ln.drop_footers(md_lines(spark, sf), ["Page [0-9]+", "# Title$"])


@query(f"with {MD_SQL}, h as (select docno, min(line) as hit from md where line <= 10 and regexp_replace(text, '[\\s_.#-]+', '', 'g') = 'Deep' group by docno) select md.* from md left join h using (docno) where hit is null or line <> hit")
def duplicate_title(spark, sf):
    lines = md_lines(spark, sf)
    return ln.drop_duplicate_title(lines, lines.select("docno").distinct().withColumn("title", F.lit("De-ep")))


TOC = "concat(case when p_partkey % 3 = 0 then concat(cast(p_size as string), '.', cast(p_partkey % 9 as string), ' ') else '' end, p_name, case when p_partkey % 5 = 0 then ' ' else '.....' end, cast(p_partkey % 900 as string))"


@query(
    f"with t as (select p_partkey // 50 as docno, p_partkey as line, {TOC} as text from part), m as (select *, trim(regexp_extract(text, '^(.*?)\\.{{4,}}\\s*(\\d+)\\s*$', 1)) as head from t where regexp_matches(text, '^(.*?)\\.{{4,}}\\s*(\\d+)\\s*$')), "
    "n as (select *, regexp_extract(head, '^(\\d+(?:\\.\\d+)*)\\.?\\s*(.*)$', 1) as num from m) "
    "select docno, line, nullif(num, '') as num, case when num <> '' then trim(regexp_extract(head, '^(\\d+(?:\\.\\d+)*)\\.?\\s*(.*)$', 2)) else head end as title, cast(regexp_extract(text, '(\\d+)\\s*$', 1) as bigint) as page from n"
)
def table_of_contents(spark, sf):
    return ln.table_of_contents(table(spark, sf, "part").select(F.expr("p_partkey div 50").alias("docno"), F.col("p_partkey").alias("line"), F.expr(TOC).alias("text")))


@query(f"with recursive {MD_SQL}, {FENCE_SQL} select docno, line, case when not fenced and regexp_matches(text, '^#{{1,6}}\\s') then repeat('#', cast(least(length(regexp_extract(text, '^(#+)', 1)) + 2, 6) as integer)) || regexp_replace(text, '^#+', '') else text end as text from fe")
def demoted(spark, sf):
    return ln.demote(md_lines(spark, sf), by=2)


NEAREST = HEADS + ", ne as (select m.docno, m.line, m.text, h.text as section, h.line as section_line from md m asof left join (select * from he where depth >= 2) h on m.docno = h.docno and m.line >= h.line) "


@query(NEAREST + "select docno, line, text, section, section_line from ne")
def nearest_heading(spark, sf):
    return ln.nearest_heading(md_lines(spark, sf))


TERMS = [("flag a", ["flag A"]), ("sevens", ["row 7", "row 17", "7 of"]), ("open", ["A O", "N O"])]
TERMS_SQL = "terms(term, keywords) as (values " + ", ".join(f"('{t}', {k})" for t, k in TERMS) + ")"
HITS = NEAREST + f", {TERMS_SQL}, hi as (select docno, term, section, count(*) as hits, min(line) as first_line from ne join terms on len(list_filter(keywords, lambda k: contains(text, k))) > 0 where section is not null group by all) "


def _hits(spark, sf):
    return ln.term_hits(md_lines(spark, sf), spark.createDataFrame(TERMS, "term string, keywords array<string>"))


@query(HITS + "select * from hi")
def term_hits(spark, sf):
    return _hits(spark, sf)


@query(
    HITS + ", r as (select *, row_number() over (partition by docno, term order by hits desc, first_line) as rank from hi), s as (select *, max(case when hits >= 2 then 1 else 0 end) over (partition by docno, term) as strong from r where rank <= 8) "
    "select docno, term, section, hits, first_line, cast(rank as integer) as rank from s where case when strong = 1 then hits >= 2 else rank <= 3 end"
)
def top_sections(spark, sf):
    return ln.top_sections(_hits(spark, sf))


CHUNKS = (
    HEADS + ", nl as (select docno, max(line) as n from md group by docno having max(line) >= 250), "
    "st as (select docno, 1 as s from nl where docno in (select docno from he) union all select st.docno, min(h.line) from st join he h on h.docno = st.docno and h.line - st.s >= 100 group by st.docno, st.s), "
    "la as (select docno, max(s) as m, count(*) as c from st group by docno), "
    "ke as (select st.docno, s, n from st join nl using (docno) join la using (docno) where not (c > 1 and s = m and n - m + 1 < 25)), "
    "ch as (select docno, cast(row_number() over w as integer) as no, s as start, coalesce(lead(s) over w - 1, n) as end, count(*) over (partition by docno) as c from ke window w as (partition by docno order by s)) "
)


@query(CHUNKS + "select docno, no, start, \"end\" from ch where c > 1")
def chunks(spark, sf):
    return ln.chunks(md_lines(spark, sf), target=100)


@query(CHUNKS + "select ch.docno, no, start, \"end\", list(h.text order by h.line)[1:5] as sections, count(h.line) as n_sections from ch join he h on h.docno = ch.docno and h.line between start and \"end\" where c > 1 group by all")
def chunk_sections(spark, sf):
    lines = md_lines(spark, sf)
    return ln.chunk_sections(ln.chunks(lines, target=100), ln.headings(lines), most=5).where("n_sections > 0")


@query(
    HEADS + r", t as (select *, case when regexp_matches(text, '^\d+(\.\d+)*') then list_transform(string_split(regexp_extract(text, '^(\d+(?:\.\d+)*)', 1), '.'), lambda x: cast(x as integer)) end as t from he), "
    "p as (select *, depth - lag(depth) over w > 2 as jump, last_value(t ignore nulls) over (partition by docno order by line rows between unbounded preceding and 1 preceding) as before from t window w as (partition by docno order by line)), "
    "a as (select docno, count(*) as headings, count_if(jump) as jumps, count_if(t < before) as disorder, count(t) as numbered from p group by docno) "
    "select docno, headings, cast(coalesce(jumps, 0) as bigint) as jumps, cast(coalesce(disorder, 0) as bigint) as disorder, round(greatest(0.0, least(1.0, 1 - abs(1 - headings / 30.0))) * (case when jumps > 0 then greatest(0.5, 1 - 0.02 * jumps) else 1.0 end) * (case when disorder > 0.05 * numbered then 0.9 else 1.0 end), 3)::double as score from a"
)
def outline_quality(spark, sf):
    return ln.outline_quality(ln.headings(md_lines(spark, sf)), F.lit(30.0))


@query(f"with {MD_SQL}, n as (select *, first_value(case when trim(text) <> '' then text end ignore nulls) over (partition by docno order by line rows between 1 following and unbounded following) as f from md) select docno, line, text from n where starts_with(text, '## ') and (f is null or starts_with(f, '## '))")
def empty_sections(spark, sf):
    return ln.empty_sections(md_lines(spark, sf))


@query(f"with {MD_SQL}, i as (select *, last_value(case when regexp_matches(text, '^#{{1,4}}\\s') then regexp_matches(text, '^#{{2,4}}\\s') and contains(text, 'Part R') end ignore nulls) over (partition by docno order by line) as inside from md) select docno, line, text from i where inside")
def section_slice(spark, sf):
    return ln.section_slice(md_lines(spark, sf), "Part R")


@query(f"with {LINES_SQL} select trim(text) as text, count(distinct docno) as docs from ls where length(trim(text)) >= 12 and not starts_with(trim(text), '#') and not starts_with(trim(text), '-') group by 1 having count(distinct docno) >= 2")
def repeated_lines(spark, sf):
    return ln.repeated_lines(doc_lines(spark, sf), boilerplate=("#", "-"))


@query(
    f"with recursive {MD_SQL}, {FENCE_SQL}, x as (select *, sum(case when regexp_matches(text, '^#\\s') and not fenced then 1 else 0 end) over (partition by docno) as h1s, lag(text) over (partition by docno order by line) as b from fe) "
    "select docno, line, 'h1_count' as kind from x where line = 1 and h1s <> 1 union all select docno, line, 'first_line' from x where line = 1 and not regexp_matches(text, '^#\\s') "
    "union all select docno, line, 'trailing_blank' from x where regexp_matches(text, '\\s$') and not regexp_matches(text, '\\S  $') "
    "union all select docno, line, 'separator_width' from x where regexp_matches(text, '^\\|[\\s\\-:|]+\\|$') and starts_with(b, '|') and length(replace(text, '|', '')) - length(text) <> length(replace(b, '|', '')) - length(b) union all select docno, line, 'too_deep' from x where regexp_matches(text, '^#{{7,}}\\s') and not fenced"
)
def markdown_faults(spark, sf):
    return ln.markdown_faults(md_lines(spark, sf))


NUM = "case when p_partkey % 4 = 0 then concat(cast(p_partkey % 6 + 1 as string), '.', cast(p_size % 4 as string)) when p_partkey % 4 = 1 then p_name when p_partkey % 4 = 2 then concat(cast(p_partkey % 3 + 1 as string), '.', cast(p_size % 3 + 1 as string), '  ', p_name) else '' end"


def _numbered(spark, sf):
    w = Window.partitionBy(F.expr("p_partkey div 50")).orderBy("p_partkey")
    return table(spark, sf, "part").select(F.expr("p_partkey div 50").alias("docno"), F.row_number().over(w).alias("line"), F.expr(NUM).alias("text"))


NUM_SQL = f"np as (select p_partkey // 50 as docno, cast(row_number() over (partition by p_partkey // 50 order by p_partkey) as integer) as line, {NUM} as text from part)"
CAND_SQL = (
    NUM_SQL + r", c1 as (select *, first_value(case when trim(text) <> '' then struct_pack(l := line, s := trim(text)) end ignore nulls) over (partition by docno order by line rows between 1 following and unbounded following) as f, "
    r"regexp_matches(trim(text), '^(\d+(\.\d+)*)(\.?)$') as single from np), c2 as (select docno, line, case when single then rtrim(trim(text), '.') else regexp_extract(trim(text), '^(\d{1,3}(?:\.\d+){0,4})[.\s、:：]{1,4}(\S.*)$', 1) end as num, "
    r"case when single then f.s else trim(regexp_extract(trim(text), '^(\d{1,3}(?:\.\d+){0,4})[.\s、:：]{1,4}(\S.*)$', 2)) end as title, case when single then f.l else line end as last, single, ends_with(trim(text), '.') as dotted from c1), "
    r"ca as (select docno, line, num, title, last from c2 where num <> '' and (not single or case when dotted then not contains(num, '.') else contains(num, '.') end) and len(list_filter(string_split(num, '.'), lambda x: cast(x as integer) < 1)) = 0 "
    r"and regexp_matches(title, '^[一-鿿A-Za-z]') and (regexp_matches(title, '[一-鿿]') or length(title) >= 4) and length(title) <= 60 and not regexp_matches(title, '[。；：,，]'))"
)


@query(f"with {CAND_SQL} select docno, line, num, title, last from ca")
def numbered_headings(spark, sf):
    return ln.numbered_headings(_numbered(spark, sf))


@query(
    f"with recursive {CAND_SQL}, t as (select docno, line, num, title, last, list_transform(string_split(num, '.'), lambda x: cast(x as integer)) as t, row_number() over (partition by docno order by line) as i from ca), "
    "w as (select docno, i, line, t as last_t, true as kept from t where i = 1 union all select t.docno, t.i, t.line, case when t.t >= w.last_t and len(t.t) <= len(w.last_t) + 1 then t.t else w.last_t end, t.t >= w.last_t and len(t.t) <= len(w.last_t) + 1 from w join t on t.docno = w.docno and t.i = w.i + 1) "
    "select docno, line, num, title, last from ca join (select docno, line from w where kept) using (docno, line)"
)
def ordered_numbers(spark, sf):
    return ln.ordered_numbers(ln.numbered_headings(_numbered(spark, sf)))


@query(
    f"with {CAND_SQL}, o as (select n.docno, n.line, n.text, c.num, c.title, max(c.last) over (partition by n.docno order by n.line) as until from np n left join ca c using (docno, line)), "
    "e as (select docno, line, unnest(case when num is null then [rtrim(text)] else ['', repeat('#', cast(least(len(string_split(num, '.')) + 1, 6) as integer)) || ' ' || num || ' ' || title, ''] end) as text, unnest(case when num is null then [0] else [0, 1, 2] end) as part from o where num is not null or until is null or line > until) "
    "select docno, cast(row_number() over (partition by docno order by line, part) as integer) as line, text from e"
)
def injected_headings(spark, sf):
    lines = _numbered(spark, sf)
    return ln.inject_headings(lines, ln.numbered_headings(lines))


# lines are walked one by one: a line joins the one before it, or starts a new one
PROSE_SQL = r"""
pr as (
  select *, row_number() over (partition by docno order by line) as i, trim(text) as t,
    trim(text) <> '' and not regexp_matches(trim(text), '^[|#>\-*+·•]') and not regexp_matches(trim(text), '^\d+(\.\d+)*[.\s、]') and not regexp_matches(trim(text), '^(图|表|注|第|Figure|Table)\s*[.\d]') and length(trim(text)) <= 200 as prose
  from ls),
jo as (
  select docno, i, 1 as g, case when prose then rtrim(text) else text end as buf, prose as open from pr where i = 1
  union all
  select docno, i, case when joins then g else g + 1 end,
    case when joins then buf || case when regexp_matches(buf, '[A-Za-z0-9]$') and regexp_matches(t, '^[A-Za-z0-9]') then ' ' else '' end || t when prose then rtrim(text) else text end, prose
  from (
    select pr.*, jo.g, jo.buf, jo.open and pr.prose and not regexp_matches(jo.buf, '[。；：！？、，）】》”\"’…；:;,.)\]}>\-—*]$') and length(jo.buf) + length(pr.t) <= 160 as joins
    from jo join pr on pr.docno = jo.docno and pr.i = jo.i + 1))
"""


@query(f"with recursive {LINES_SQL}, {PROSE_SQL} select docno, cast(g as integer) as line, arg_max(buf, i) as text from jo group by docno, g")
def joined_prose(spark, sf):
    return ln.join_prose(doc_lines(spark, sf))


# entries are walked one by one, each from the line of the last hit
LOCATED_SQL = r"""
ln as (select docno, line, text, row_number() over (partition by docno order by line) - 1 as k from np),
en as (select docno, line as pos, num, title, row_number() over (partition by docno order by line) as i from ca),
ma as (
  select en.docno, en.i, ln.k from en join ln on ln.docno = en.docno
    and regexp_matches(ln.text, '^[\s|\-*#>]*' || replace(num, '.', '\.') || '($|[^0-9.]|\.($|[^0-9]))')
    and contains(regexp_replace(ln.text, '[\s|]', '', 'g'), regexp_replace(title, '[\s|]', '', 'g'))),
wa as (
  select docno, 0 as i, 0 as pos, cast(null as bigint) as hit from (select distinct docno from en)
  union all
  select docno, i, greatest(pos, coalesce(hit, pos)), hit from (
    select wa.docno, wa.i + 1 as i, wa.pos, coalesce(min(case when ma.k >= wa.pos and ma.k < wa.pos + 1200 then ma.k end), min(ma.k)) as hit
    from wa join en on en.docno = wa.docno and en.i = wa.i + 1 left join ma on ma.docno = en.docno and ma.i = en.i group by wa.docno, wa.i, wa.pos))
"""


# long documents, so that the window from the last hit ends before the text does
LONG_NUM = NUM.replace("p_partkey % 4 ", "(p_partkey {0} 40) % 4 ")
LONG_SQL = f"np as (select p_partkey % 40 as docno, cast(row_number() over (partition by p_partkey % 40 order by p_partkey) as integer) as line, {LONG_NUM.format('//')} as text from part)"


@query(f"with recursive {CAND_SQL.replace(NUM_SQL, LONG_SQL)}, {LOCATED_SQL} select wa.docno, ln.line, en.num, en.title from wa join en on en.docno = wa.docno and en.i = wa.i join ln on ln.docno = wa.docno and ln.k = wa.hit")
def located_entries(spark, sf):
    part = table(spark, sf, "part").select(F.expr("p_partkey % 40").alias("docno"), "p_partkey", F.expr(LONG_NUM.format("div")).alias("text"))
    lines = part.select("docno", F.row_number().over(Window.partitionBy("docno").orderBy("p_partkey")).alias("line"), "text")
    entries = ln.numbered_headings(lines).select("docno", F.col("line").alias("pos"), "num", "title")
    return ln.locate_entries(lines, entries)


# ---- events

FRAMES_SQL = "fr as (select event_id as seq, event_type as cmd, cast(user_id % 2 as string) as dir, value, user_id, ts, props from events)"


def frames(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("cmd"), (F.col("user_id") % 2).cast("string").alias("dir"), "value", "user_id", "ts", "props")


@query(f"with {FRAMES_SQL} select cmd, count(*) as n, min(seq) as first_seq, round(100.0 * count(*) / (select count(*) from fr), 1)::double as share from fr group by cmd")
def frame_digest(spark, sf):
    return ev.digest(frames(spark, sf), "cmd", "seq")


@query(f"with {FRAMES_SQL} select user_id, count(*) as n, min(seq) as first_seq, round(100.0 * count(*) / (select count(*) from fr), 1)::double as share from fr group by user_id order by n desc, first_seq limit 25")
def frame_top(spark, sf):
    return ev.top(ev.digest(frames(spark, sf), "user_id", "seq"), 25)


@query(f"with {FRAMES_SQL} select cmd, arg_min(dir, seq) as dir, arg_min(props, seq) as props, min(seq) as seq from fr group by cmd")
def frame_examples(spark, sf):
    return ev.first_examples(frames(spark, sf), "cmd", "seq", "dir", "props", "seq")


@query(f"with {FRAMES_SQL}, r as (select user_id, seq, cmd, count(*) over (partition by user_id) as hits, row_number() over (partition by user_id order by seq) as nth from fr where user_id in (3, 7, 11)) select user_id, seq, cmd, hits, cast(nth as integer) as nth from r where nth <= 60")
def hits_per_id(spark, sf):
    ids = spark.createDataFrame([(3,), (7,), (11,)], "user_id long")
    return ev.hits_per_id(frames(spark, sf), ids, "user_id", "seq", 60).select("user_id", "seq", "cmd", "hits", "nth")


@query(f"with {FRAMES_SQL} select seq, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, cmd from fr where contains(strftime(ts, '%Y-%m-%d %H:%M:%S'), '15:30') or contains(strftime(ts, '%Y-%m-%d %H:%M:%S'), '09:05') order by seq limit 200")
def near_times(spark, sf):
    at = frames(spark, sf).withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return ev.near_times(at, "at", ["15:30", "09:05"], 200, "seq").select("seq", "at", "cmd")


@query(f"with {FRAMES_SQL}, s as (select user_id, seq, cmd, sum(case when cmd = (select min(event_type) from events) then 1 else 0 end) over (partition by user_id order by seq) as segment from fr) select user_id, cast(segment as bigint) as segment, count(*) as n, min(seq) as first_seq from s group by user_id, segment")
def segments(spark, sf):
    f = frames(spark, sf)
    first = f.agg(F.min("cmd")).first()[0]
    return ev.segments(f, "user_id", "seq", F.col("cmd") == first).groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


GRID = "ce as (select cast(o_orderkey // 600 as string) as sheet, cast(o_orderkey % 60 as integer) as \"row\", cast(o_orderkey % 7 as integer) as col, min(case when o_orderkey % 5 = 0 then ' ' when o_orderkey % 3 = 0 then cast(o_orderkey as string) else o_orderpriority end) as value from orders group by 1, 2, 3)"


def cells(spark, sf):
    value = F.expr("case when o_orderkey % 5 = 0 then ' ' when o_orderkey % 3 = 0 then cast(o_orderkey as string) else o_orderpriority end")
    keys = [F.expr("cast(o_orderkey div 600 as string)").alias("sheet"), F.expr("cast(o_orderkey % 60 as int)").alias("row"), F.expr("cast(o_orderkey % 7 as int)").alias("col")]
    return table(spark, sf, "orders").groupBy(*keys).agg(F.min(value).alias("value"))


@query(f"with {GRID}, v as (select sheet, \"row\", col, value, row_number() over (partition by sheet, col, value order by \"row\") as k from ce where trim(value) <> '') select sheet, col, string_agg(value, '<br>' order by \"row\") as header from v where k = 1 group by sheet, col")
def merged_header(spark, sf):
    return ev.merged_header(cells(spark, sf))


@query(
    f"with {GRID}, f as (select * from ce where trim(value) <> ''), r as (select sheet, \"row\", dense_rank() over (partition by sheet order by \"row\") as r from f group by sheet, \"row\"), c as (select sheet, col, dense_rank() over (partition by sheet order by col) as c from f group by sheet, col) "
    "select r.sheet, cast(r as integer) as \"row\", cast(c as integer) as col, coalesce(value, '') as value from r join c on r.sheet = c.sheet left join ce on ce.sheet = r.sheet and ce.\"row\" = r.\"row\" and ce.col = c.col"
)
def clean_grid(spark, sf):
    return ev.clean_grid(cells(spark, sf))


@query(f"with {GRID}, f as (select sheet, \"row\", min(col) as c, arg_min(value, col) as v, count(*) as n from ce where trim(value) <> '' group by sheet, \"row\") select sheet, \"row\" from f where n >= 2 and c <= 2 and regexp_matches(trim(v), '^[0-9]+$')")
def data_rows(spark, sf):
    return ev.data_rows(cells(spark, sf))


@query("select n_nationkey, concat_ws('/', case when n_nationkey % 2 = 0 then 'even' end, case when n_nationkey % 3 = 0 then 'three' end, case when n_regionkey = 1 then 'one' end) as senders from nation")
def flagged_names(spark, sf):
    flag = lambda c: F.when(c, " S ").otherwise("")
    rows = table(spark, sf, "nation").select("n_nationkey", flag(F.col("n_nationkey") % 2 == 0).alias("even"), flag(F.col("n_nationkey") % 3 == 0).alias("three"), flag(F.col("n_regionkey") == 1).alias("one"))
    return rows.select("n_nationkey", ev.flagged_names(rows, ["even", "three", "one"]).alias("senders"))


# ---- records


@query("select o_orderkey, o_orderpriority, o_orderstatus, o_orderdate from orders where o_orderstatus = 'O' and contains(lower(o_orderpriority), 'ur') and o_orderdate >= timestamp '1995-01-01'")
def conjunction(spark, sf):
    o = table(spark, sf, "orders")
    return o.where(rc.conjunction({"o_orderstatus": "O"}, {"o_orderpriority": "UR"}, since={"o_orderdate": "1995-01-01"})).select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")


@query("select o_orderkey, o_orderdate, (select count(*) from orders where o_orderstatus = 'F') as total, true as truncated from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 50 offset 100")
def search_page(spark, sf):
    rows = table(spark, sf, "orders").where(rc.conjunction({"o_orderstatus": "F"})).select("o_orderkey", "o_orderdate")
    return rc.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 50, 100)


@query("select c_custkey, c_name from customer where contains(lower(c_name), '11') or contains(lower(c_mktsegment), 'auto')")
def text_filter(spark, sf):
    c = table(spark, sf, "customer")
    return rc.text_filter(c, "11", "c_name").unionByName(rc.text_filter(c, "AUTO", "c_mktsegment").where("not contains(c_name, '11')")).select("c_custkey", "c_name")


@query(
    "with r as (select *, row_number() over (partition by conv_id order by turn) as k, count(*) over (partition by conv_id) as total from conversations) "
    "select conv_id, list(concat(cast(turn as string), ':', case when length(text) > 40 then concat(substr(text, 1, 40), '…[', cast(length(text) as string), ']') else text end) order by turn) filter (k <= 3) as children, max(total) as total, max(total) > 3 as cut from r group by conv_id"
)
def comments(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", tx.truncated("text", 40, "…[{n}]").alias("body"))
    few = rc.with_children(c.select("conv_id").distinct(), c, "conv_id", "turn", 3)
    return few.withColumn("children", F.transform("children", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["body"])))


WANTED = ["3", "FRANCE", "NATION_5", "none", "7", "7"]


@query("with w(wanted) as (values " + ", ".join(f"('{x}')" for x in WANTED) + "), h as (select wanted, count(distinct n_nationkey) as n, min(n_nationkey) as k from (select distinct wanted from w) join nation on wanted = cast(n_nationkey as string) or wanted = n_name group by wanted) select w.wanted, case when n = 1 then k end as n_nationkey, case when n = 1 then 'ok' when n > 1 then 'ambiguous' else 'missing' end as status from w left join h using (wanted)")
def resolved(spark, sf):
    w = spark.createDataFrame([(x,) for x in WANTED], "wanted string")
    return rc.resolve(w, table(spark, sf, "nation").select("n_nationkey", "n_name"), key="n_nationkey", name="n_name")


@query(
    "with p as (select o_orderkey as record, unnest(['a', 'b', 'c']) as id, unnest([case when o_orderkey % 3 = 0 then '1' end, case when o_orderkey % 5 = 0 then ' ' else o_orderstatus end, case when o_orderkey % 7 = 0 then '[]' else 'x' end]) as value from orders) "
    "select o_orderkey as record, id from orders, (values ('a'), ('b'), ('d')) f(id) where not exists (select 1 from p where p.record = o_orderkey and p.id = f.id and value is not null and trim(value) not in ('', '[]', '{}', 'null', '\"\"'))"
)
def missing_required(spark, sf):
    values = F.array(F.expr("case when o_orderkey % 3 = 0 then '1' end"), F.expr("case when o_orderkey % 5 = 0 then ' ' else o_orderstatus end"), F.expr("case when o_orderkey % 7 = 0 then '[]' else 'x' end"))
    payload = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record"), F.posexplode(values).alias("k", "value")).withColumn("id", F.element_at(F.array(*map(F.lit, "abc")), F.col("k") + 1)).drop("k")
    fields = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "id string, required boolean")
    return rc.missing_required(fields, payload)


@query(
    "with b as (select o_orderkey, o_orderstatus as s, o_orderpriority as p from orders where o_orderkey % 5 <> 0), a as (select o_orderkey, 'P' as s, case when o_orderkey % 2 = 0 then o_orderpriority end as p from orders where o_orderkey % 7 <> 0), "
    "j as (select coalesce(b.o_orderkey, a.o_orderkey) as o_orderkey, b.s as bs, a.s as ns, b.p as bp, a.p as np from b full join a on a.o_orderkey = b.o_orderkey) "
    "select o_orderkey, 'o_orderstatus' as field, bs as before, ns as after from j where bs is distinct from ns union all select o_orderkey, 'o_orderpriority', bp, np from j where bp is distinct from np"
)
def planned_changes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    after = o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.lit("P")).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))
    return rc.planned_changes(o.where("o_orderkey % 5 <> 0"), after, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("select o_orderkey as key, o_orderstatus as from_status, t as to_status, case when o_orderstatus = t then 'skip' when (o_orderstatus, t) in (('O', 'P'), ('P', 'F')) then 'apply' else 'refuse' end as action from (select *, case when o_orderkey % 2 = 0 then 'F' else 'P' end as t from orders)")
def planned_transitions(spark, sf):
    o = table(spark, sf, "orders")
    allowed = spark.createDataFrame([("O", "P"), ("P", "F")], "status string, target string")
    return rc.planned_transitions(o.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")), o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise("P").alias("target")), allowed)


def _receipts(spark, sf):
    tickets = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"))
    receipts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.when(F.max("o_orderstatus") == "P", "error").otherwise("ok").alias("status"))
    return rc.receipt_status(tickets, receipts)


RECEIPTS = "r as (select c_custkey as key, c_name as title, s.status, case when s.status is null then 'missing' when s.status = 'ok' then 'ok' else 'failed' end as state from customer left join (select o_custkey, case when max(o_orderstatus) = 'P' then 'error' else 'ok' end as status from orders group by o_custkey) s on o_custkey = c_custkey)"


@query(f"with {RECEIPTS} select key, title, status, state from r")
def receipts(spark, sf):
    return _receipts(spark, sf)


@query(f"with {RECEIPTS} select cast(count_if(state = 'ok') as bigint) as ok, cast(count_if(state = 'failed') as bigint) as failed, cast(count_if(state = 'missing') as bigint) as missing from r")
def receipt_totals(spark, sf):
    return rc.rollup(_receipts(spark, sf), "state", ["ok", "failed", "missing"])


@query("with f as (select distinct conv_id as key, split_part(text, ' ', 1) as filename from conversations) select key, filename from f where not exists (select 1 from conversations c where c.conv_id = f.key and c.turn > 0 and contains(lower(c.text), lower(f.filename)))")
def not_mentioned(spark, sf):
    c = table(spark, sf, "conversations")
    return rc.not_mentioned(c.select(F.col("conv_id").alias("key"), F.split_part("text", F.lit(" "), F.lit(1)).alias("filename")).distinct(), c.where("turn > 0").select(F.col("conv_id").alias("key"), F.col("text").alias("body")))


# ---- modules


@query(f"with {FILES_SQL}, {MODULES_SQL}, {ROUTED_SQL} select rel, module from routed")
def longest_prefix(spark, sf):
    return mo.longest_prefix(repo_files(spark, sf).select("rel"), repo_modules(spark))


DIRS = f"with {FILES_SQL}, d as (select *, case when contains(rel, '/') then split_part(rel, '/', 1) else '' end as dir from files), "


@query(DIRS.rstrip(", ") + " select dir, count(*) as files, cast(sum(size) as bigint) as bytes, cast(sum(case when size <= 1000000 then loc else 0 end) as bigint) as loc, false as loc_approx from d group by dir")
def dir_stats(spark, sf):
    return mo.dir_stats(repo_files(spark, sf))


@query(DIRS + "s as (select dir, split_part(rel, '/', 2) as sub, count(*) as files from d where len(string_split(rel, '/')) > 2 group by all), r as (select *, cast(row_number() over (partition by dir order by files desc, sub) as integer) as rank from s) select * from r where rank <= 4")
def subdir_stats(spark, sf):
    return mo.subdir_stats(repo_files(spark, sf), 4)


@query(DIRS + r"e as (select dir, regexp_extract(rel, '(\.[^./]+)$', 1) as ext, count(*) as n from d group by all) select dir, arg_min(ext, (-n, ext)) as ext, max(n) as n from e group by dir")
def dominant_extension(spark, sf):
    return mo.dominant_extension(repo_files(spark, sf))


@query(
    DIRS + f"st as (select dir, count(*) as files from d group by dir), ch as (select concat('src', cast(user_id % 5 as string)) as dir, count(*) as churn from events where ts >= timestamp '2024-01-31' - interval 20 days group by 1) "
    "select dir, files, coalesce(churn, 0) as churn, files * (1 + coalesce(churn, 0)) as weight from st left join ch using (dir)"
)
def ranked_dirs(spark, sf):
    changes = table(spark, sf, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string"), F.lit("/x")).alias("path"), "ts")
    stats = mo.dir_stats(repo_files(spark, sf)).select("dir", "files")
    return mo.ranked_dirs(stats, mo.churn(changes, F.lit("2024-01-31").cast("timestamp_ntz"), 20))


@query(f"with {FILES_SQL}, {MODULES_SQL}, {ROUTED_SQL} select module, count(*) as files, left(sha256(string_agg(rel || ':' || left(hash, 16), chr(10) order by rel)), 32) as src_hash from routed join files using (rel) where module is not null group by module")
def module_hash(spark, sf):
    return mo.module_hash(repo_files(spark, sf), repo_modules(spark))


@query(
    f"with {FILES_SQL}, {MODULES_SQL}, {ROUTED_SQL}, c as (select r.* from routed r join files f using (rel) where f.size % 280000 = 0), t as (select split_part(rel, '/', 1) as name, count(*) as n from files group by 1) "
    "select 'changed' as kind, module as name, count(*) as n from c where module is not null group by module union all select case when n >= 15 then 'new' else 'small-new' end, name, n from t where name in (select split_part(rel, '/', 1) from c where module is null and contains(rel, '/'))"
)
def routed_changes(spark, sf):
    files = repo_files(spark, sf)
    return mo.route_changes(files.where("size % 280000 = 0"), repo_modules(spark), files)


@query(f"with {FILES_SQL}, {MODULES_SQL} select id from modules m where not exists (select 1 from files where starts_with(lower(rel), lower(prefix)))")
def deleted_modules(spark, sf):
    return mo.deleted_modules(repo_modules(spark), repo_files(spark, sf))


@query(
    f"with {FILES_SQL}, u as (select string_split(rel, '/')[1:len(string_split(rel, '/')) - 1] as d from files), l as (select d, count(*) as loose from u group by d), a as (select distinct d[1:n] as d from u, range(1, 4) r(n) where n <= len(d)), "
    "b as (select a.d, len(a.d) as depth, coalesce(loose, 0) as loose from a left join l using (d)), d3 as (select *, 0 as children from b where depth = 3 and loose >= 2), "
    "d2 as (select b.*, (select count(*) from d3 where d3.d[1:2] = b.d) as children from b where depth = 2), e2 as (select * from d2 where loose >= 2 or children >= 2), d1 as (select b.*, (select count(*) from e2 where e2.d[1:1] = b.d) as children from b where depth = 1) "
    "select array_to_string(d, '/') as dir, cast(depth as integer) as depth, loose, cast(children as bigint) as children from (select * from d3 union all select * from e2 union all select * from d1)"
)
def emitted_dirs(spark, sf):
    return mo.emitted_dirs(repo_files(spark, sf), 3)


@query(f"with {FILES_SQL}, c as (select p_partkey as doc, case when p_partkey % 2 = 0 then {REL} else concat('mod', cast(p_partkey % 3 as string), '/', p_name) end as path from part), b(base) as (values (''), ('src1/'), ('lib/')) select doc, path from c where not exists (select 1 from b join files f on f.rel = concat(base, path))")
def dead_paths(spark, sf):
    named = F.expr(f"case when p_partkey % 2 = 0 then {REL} else concat('mod', cast(p_partkey % 3 as string), '/', p_name) end")
    candidates = table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), named.alias("path"))
    return mo.missing_paths(candidates, repo_files(spark, sf).select("rel"), spark.createDataFrame([("",), ("src1/",), ("lib/",)], "base string"))


@query("select c_custkey, case when c_custkey % 3 = 0 then (case when n > 0 then 'UPDATE' else 'NOOP' end) when c_nationkey % 2 = 0 then 'ADOPT' else 'INIT' end as mode from (select c_custkey, c_nationkey, (select count(*) from orders where o_custkey = c_custkey) as n from customer)")
def run_mode(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", mo.mode(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") % 2 == 0, F.coalesce("n", F.lit(0))).alias("mode"))


# ---- state

CUR_SQL = "cu as (select concat('d/', cast(case when p_partkey % 9 = 1 then p_partkey + 1000000 else p_partkey end as string)) as relpath, md5(cast(case when p_partkey % 10 = 3 then -p_partkey else p_partkey end as string)) as hash from part where p_partkey % 8 <> 2)"
OLD_SQL = "ol as (select concat('d/', cast(p_partkey as string)) as relpath, md5(cast(p_partkey as string)) as hash, p_partkey % 12 = 5 as retired, lpad(cast(p_partkey as string), 2, '0') as docno from part where p_partkey % 7 <> 4 and p_partkey > 5)"


def _current(spark, sf):
    return table(spark, sf, "part").where("p_partkey % 8 <> 2").select(
        F.expr("concat('d/', cast(case when p_partkey % 9 = 1 then p_partkey + 1000000 else p_partkey end as string))").alias("relpath"), F.expr("md5(cast(case when p_partkey % 10 = 3 then -p_partkey else p_partkey end as string))").alias("hash")
    )


def _state(spark, sf):
    return table(spark, sf, "part").where("p_partkey % 7 <> 4 and p_partkey > 5").select(
        F.expr("concat('d/', cast(p_partkey as string))").alias("relpath"), F.expr("md5(cast(p_partkey as string))").alias("hash"), F.expr("p_partkey % 12 = 5").alias("retired"), cdc.docno(F.col("p_partkey")).alias("docno")
    )


CHANGES = (
    f"with {CUR_SQL}, {OLD_SQL.replace('lpad(cast(p_partkey as string), 2, ' + chr(39) + '0' + chr(39) + ')', 'case when p_partkey < 100 then lpad(cast(p_partkey as string), 2, ' + chr(39) + '0' + chr(39) + ') else cast(p_partkey as string) end')}, "
    "fresh as (select *, row_number() over (partition by hash order by relpath) as n from cu where relpath not in (select relpath from ol where not retired)), "
    "lost as (select *, row_number() over (partition by hash order by retired, relpath) as n from ol where relpath not in (select relpath from cu)), "
    "pa as (select f.relpath, f.hash, l.relpath as from_path from fresh f left join lost l using (hash, n)), "
    "ch as (select case when c.hash = o.hash then 'unchanged' else 'modified' end as kind, c.relpath, null::varchar as from_path, c.hash, o.hash as old_hash from cu c join ol o on c.relpath = o.relpath and not retired "
    "union all select case when from_path is null then 'added' else 'renamed' end, relpath, from_path, hash, case when from_path is not null then hash end from pa "
    "union all select 'removed', relpath, null, null, hash from lost where not retired and relpath not in (select from_path from pa where from_path is not null)) "
)


@query(CHANGES + "select kind, relpath, from_path, hash, old_hash from ch")
def change_set(spark, sf):
    return cdc.change_set(_current(spark, sf), _state(spark, sf).drop("docno"))


@query(CHANGES + "select kind, count(*) as n from ch group by kind")
def change_counts(spark, sf):
    return rc.counted(cdc.change_set(_current(spark, sf), _state(spark, sf).drop("docno")), "kind")


@query(
    CHANGES + ", k as (select c.relpath, docno from ch c join ol on coalesce(from_path, c.relpath) = ol.relpath where kind in ('unchanged', 'modified', 'renamed')), a as (select relpath, row_number() over (order by relpath) as r from ch where kind = 'added'), "
    "f as (select n, row_number() over (order by n) as r from range(1, (select count(*) from ol) + (select count(*) from a) + 1) t(n) where n not in (select cast(docno as bigint) from ol)) "
    "select relpath, docno from k union all select relpath, case when n < 100 then lpad(cast(n as string), 2, '0') else cast(n as string) end from a join f using (r)"
)
def assigned_numbers(spark, sf):
    changes = cdc.change_set(_current(spark, sf), _state(spark, sf).drop("docno"))
    return cdc.assign_numbers(changes, _state(spark, sf), changes.where("kind = 'added'").count())


@query("with o as (select s_suppkey as id, s_name as v from supplier where s_suppkey % 3 <> 0), n as (select s_suppkey as id, upper(s_name) as v from supplier where s_suppkey % 2 = 0) select * from n union all select * from o where id not in (select id from n)")
def refreshed_baseline(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("v"))
    return cdc.baseline(s.where("id % 3 <> 0"), s.where("id % 2 = 0").withColumn("v", F.upper("v")))


@query("select coalesce(a.id, b.id) as id, case when a.id is null then 'new' when b.id is null then 'deleted' else 'changed' end as state from (select s_suppkey as id, md5(s_name) as h from supplier where s_suppkey % 5 <> 0) a full join (select s_suppkey as id, md5(case when s_suppkey % 4 = 0 then 'x' else s_name end) as h from supplier where s_suppkey % 7 <> 0) b on a.id = b.id where a.h is distinct from b.h")
def changed_hashes(spark, sf):
    s = table(spark, sf, "supplier")
    old = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("id"), F.md5("s_name").alias("src_hash"))
    new = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("id"), F.md5(F.when(F.col("s_suppkey") % 4 == 0, "x").otherwise(F.col("s_name"))).alias("src_hash"))
    return cdc.changed_hashes(old, new)


@query("select p_name as name, cast(p_partkey as string) as docno from part where p_partkey % 3 <> 0 and p_partkey % 5 <> 0 and p_name <> 'keep'")
def orphan_products(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("docno"))
    return cdc.orphans(p.select("name", "docno"), p.where("p_partkey % 3 = 0"), p.where("p_partkey % 5 = 0"), ["keep"])


@query(
    "with s as (select concat('s', lpad(cast(s_suppkey as string), 8, '0')) as relpath, case when s_suppkey % 4 = 0 then cast(s_suppkey * 2 as string) end as declared from supplier), p as (select cast(s_suppkey * 2 as string) as docno from supplier), "
    "n as (select relpath, docno from s join p on declared = docno), l as (select relpath, row_number() over (order by relpath) as r from s where relpath not in (select relpath from n)), f as (select docno, row_number() over (order by cast(docno as integer)) as r from p where docno not in (select docno from n)) "
    "select relpath, docno from n union all select relpath, docno from l join f using (r)"
)
def adopted(spark, sf):
    s = table(spark, sf, "supplier")
    sources = s.select(F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("relpath"), F.when(F.col("s_suppkey") % 4 == 0, (F.col("s_suppkey") * 2).cast("string")).alias("declared"))
    return cdc.adopt(sources, s.select((F.col("s_suppkey") * 2).cast("string").alias("docno")))


@query("select o_orderkey, o_orderkey % 11 = 0 or ((o_orderkey % 7 = 0 or o_orderkey % 5 <> 0) and not (o_orderkey % 3 = 0)) as due from orders")
def due_documents(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").withColumn("stages", F.create_map(F.lit("convert"), F.when(k % 5 == 0, "ok").otherwise("error")))
    return rows.select("o_orderkey", cdc.needs_stage("convert", k % 11 == 0, k % 7 == 0, F.lit(True), False, k % 3 == 0, True).alias("due"))


@query(
    "with u as (select concat('f', cast(l_partkey as string)) as rel, 0 as list, l_linenumber as pos from lineitem where l_returnflag = 'R' union all select concat('f', cast(p_partkey as string)), 1, 0 from part where p_size > 40), "
    "r as (select *, row_number() over (partition by rel order by list, pos) as n from u) select rel, cast(list as integer) as list, cast(pos as bigint) as pos from r where n = 1"
)
def union_of_changes(spark, sf):
    a = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("rel"), F.col("l_linenumber").alias("pos"))
    b = table(spark, sf, "part").where("p_size > 40").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("rel"), F.lit(0).alias("pos"))
    return cdc.union_paths(a, b)


@query("select c_custkey from customer except select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
def unused_numbers(spark, sf):
    state = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return cdc.unlisted(table(spark, sf, "customer"), state.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# ---- scalar functions


@query(
    r"select p_partkey, trim(regexp_replace(replace(replace(concat(p_name, '| x', chr(10), chr(9), ' y '), chr(10), '<br>'), '|', '/'), '[ \t]+', ' ', 'g')) as cell, "
    r"trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') as slug, case when length(p_type) > 8 then left(p_type, 8) || '…' else p_type end as short, "
    r"replace(replace(replace(concat('<', p_name, '&\"'), '&', '&amp;'), '<', '&lt;'), '\"', '&quot;') as html, replace(replace(concat(p_brand, '/a:b'), '/', '_'), ':', '_') as safe, '0x' || coalesce(nullif(ltrim(lower(to_hex(p_partkey)), '0'), ''), '0') as hex_id from part"
)
def scalar_texts(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", tx.cell(F.concat("p_name", F.lit("| x\n\t y "))).alias("cell"), tx.slug("p_brand").alias("slug"), tx.truncated("p_type", 8).alias("short"),
        tx.html_escaped(F.concat(F.lit("<"), "p_name", F.lit('&"'))).alias("html"), tx.safe_name(F.concat("p_brand", F.lit("/a:b"))).alias("safe"), tx.hex_id(F.concat(F.lit("0X00"), F.hex("p_partkey"))).alias("hex_id"),
    )


@query("select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as loc, sha256(text) as sha, sha1('blob ' || octet_length(encode(text))::varchar || chr(0) || text) as blob from documents")
def content_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.line_count("text").alias("loc"), F.sha2("text", 256).alias("sha"), tx.blob_hash("text").alias("blob"))


EXTS = "['.PNG', '.mp4', '.tar.gz', '.log', '.xlsx', '', '.docx', '.py', '.weird', '.log.3', '.pdf', '.md']"
FILE = f"concat('f', cast(p_partkey as string), ({EXTS})[cast(p_partkey % 12 as integer) + 1])"


@query(
    f"with f as (select p_partkey, {FILE} as name from part) select p_partkey, name, case when ends_with(name, '.pdf') then 'pdf' when ends_with(name, '.xlsx') then 'excel' when ends_with(name, '.docx') then 'office' when ends_with(name, '.md') then 'markdown' when ends_with(name, '.py') then 'code' else 'other' end as kind, "
    "case when ends_with(name, '.PNG') then 'image' when ends_with(name, '.mp4') then 'video' when ends_with(name, '.tar.gz') then 'archive' when not contains(name, '.') or regexp_matches(name, '\\.log(\\.\\d+)?$') then case when p_partkey % 5 = 0 then 'log5aa5' else 'log_other' end when p_partkey % 5 = 0 then 'log5aa5' else 'unknown' end as attachment from f"
)
def file_kinds(spark, sf):
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.element_at(F.array(*[F.lit(x.strip(" '")) for x in EXTS.strip("[]").split(",")]), (F.col("p_partkey") % 12).cast("int") + 1))
    rows = table(spark, sf, "part").select("p_partkey", name.alias("name"), F.when(F.col("p_partkey") % 5 == 0, "data:0x5a 0xa5 0x00").otherwise("5a00 a5").alias("content"))
    return rows.select("p_partkey", "name", tx.source_kind("name").alias("kind"), tx.attachment_kind("name", F.col("content")).alias("attachment"))


@query(
    "with t as (select o_orderkey, lpad(lower(to_hex(o_orderkey % 4096)), 3, '0') as h, cast(o_orderkey % 24 as string) as hh, lpad(cast(o_orderkey % 60 as string), 2, '0') as mm from orders) "
    "select o_orderkey, list_distinct_ordered as ids, [lpad(hh, 2, '0') || ':' || mm] as times, concat('[WB', cast(o_orderkey % 9 as string), '1]t') as summary from (select *, case when '0x' || coalesce(nullif(ltrim(h, '0'), ''), '0') = '0x2315' then ['0x2315'] else ['0x2315', '0x' || coalesce(nullif(ltrim(h, '0'), ''), '0')] end as list_distinct_ordered from t)"
)
def hints(spark, sf):
    k = F.col("o_orderkey")
    note = F.concat(F.lit("监听了"), F.lpad(F.lower(F.hex(k % 4096)), 3, "0"), F.lit("和0x2315 in 2026 see image-15-44-34-916.png at 2026-09-10 时间"), (k % 24).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    code = F.concat(F.when(k % 2 == 0, F.lit("【WB")).otherwise("WB"), (k % 9).cast("string"), F.when(k % 2 == 0, F.lit("1】t")).otherwise("1_t"))
    return table(spark, sf, "orders").select("o_orderkey", tx.id_hints(note).alias("ids"), tx.time_hints(note).alias("times"), tx.summary_code(code).alias("summary"))


@query(
    "select page_id, list_distinct_links as links, 'p' || page_id::varchar as title from (select page_id, [url, 'a b.md'] as list_distinct_links from pages)"
)
def page_links(spark, sf):
    text = F.concat(F.lit("see [x]("), "url", F.lit(") and ![y](<a b.md>)"))
    return table(spark, sf, "pages").select("page_id", tx.links(text).alias("links"), tx.display_name(F.lit(" "), F.concat(F.lit("p"), F.col("page_id").cast("string"))).alias("title"))


@query("select o_orderkey, [cast(o_orderkey % 5 as integer), cast(o_orderkey % 12 as integer)] as num, [cast(o_orderkey % 5 as integer), cast(o_orderkey % 12 as integer)] < [2, 10] as before from orders")
def section_numbers(spark, sf):
    n = tx.number_tuple(F.concat((F.col("o_orderkey") % 5).cast("string"), F.lit("."), (F.col("o_orderkey") % 12).cast("string"), F.lit(".")))
    return table(spark, sf, "orders").select("o_orderkey", n.alias("num"), (n < F.array(F.lit(2), F.lit(10))).alias("before"))


@query("select c_custkey, case when c_custkey % 4 = 0 then null else c_name end as who, case when c_custkey % 3 = 0 then 'ok' else 'bad: ' || c_mktsegment end as state from customer")
def receipt_fields(spark, sf):
    k = F.col("c_custkey")
    text = F.concat(F.lit("State：bad: "), "c_mktsegment", F.lit("\nno field\n"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Key: "), "c_name", F.lit("\n"))), F.when(k % 3 == 0, "state: ok\n").otherwise(" \n"))
    m = tx.receipt_fields(text)
    return table(spark, sf, "customer").select("c_custkey", m["key"].alias("who"), m["state"].alias("state"))


# every text is given characters to repair: radicals, full-width forms, a symbol of the private area, one of it without a meaning
REPAIRED = [(0x2ECB, 0x8F66), (0x2F42, 0x6587), (0xFF21, 0x41), (0xFF11, 0x31), (0xFF05, 0x25), (0xFF0C, 0xFF0C), (0xE000, None), (0xE123, None)]
REPAIR_SQL = "concat(" + ", ".join(["text", *(f"chr({b or 32})" if b else "''" for _, b in REPAIRED)]) + ")"


@query(f"select doc_id, {REPAIR_SQL} as normal, 4 as repairs from documents where not regexp_matches(text, '[^\\x00-\\x7FÀ-ÿ]') union all select doc_id, null, null from documents where text is null")
def normalised(spark, sf):
    odd = F.concat("text", F.lit("".join(chr(a) for a, _ in REPAIRED)))
    return table(spark, sf, "documents").select("doc_id", tx.normalised(odd).alias("normal"), tx.repairs(odd).alias("repairs"))

"""Text as ordered lines: rows (docno, line, text) with line counted from 1, windows never wider than a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_order() -> WindowSpec:
    return Window.partitionBy("docno").orderBy("line")


def up_to() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


#: A table separator row, and list, table and quote marks that no prose line starts with.
SEPARATOR = r"^\|[\s\-:|]+\|$"
#: Fixed value: a heading's marks and text.
HEADING = r"^(#{1,6})\s+(.*?)\s*$"
NOT_PROSE = r"^[|#>\-*+·•]"
#: Fixed value: line ends after which wrapped lines are not rejoined.
SENTENCE_END = r"[。；：！？、，）】》”\"’…；:;,.)\]}>\-—*]$"


def to_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a line; a closing line feed leaves one empty line."""
    return docs.select(F.col(doc).alias("docno"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "text")).select("docno", (F.col("pos") + 1).alias("line"), "text")


def line_stats(lines: DataFrame) -> DataFrame:
    return lines.groupBy("docno").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


#: The marks of a fenced block.
FENCE = r"^\s*(```|~~~)"


def with_fence(lines: DataFrame, keep_open: bool = False) -> DataFrame:
    """lines with is_fence and fenced. A block of ``` or ~~~ is closed by the mark that opened it; the other mark is text in it.

    A line's state is 0 outside blocks, 1 in a ``` block, 2 in a ~~~ block. A fence line takes state s to m - s modulo 3, m being 1
    for ``` and 2 for ~~~: it swaps 0 with its own block and leaves the other one. So the state after n fences is
    (-1)^n times the sum of (-1)^k m_k, which two running sums give. keep_open adds `opened`: the mark of a block that
    the line opens, else blank.
    """
    mark = F.regexp_extract("text", FENCE, 1)
    rows = lines.withColumn("__m", F.when(mark == "```", 1).when(mark == "~~~", 2).otherwise(0))
    rows = rows.withColumn("__n", F.sum((F.col("__m") > 0).cast("int")).over(up_to()))
    sign = F.when(F.col("__n") % 2 == 0, 1).otherwise(-1)
    rows = rows.withColumn("__s", F.pmod(sign * F.sum(sign * F.col("__m")).over(up_to()), F.lit(3)))
    is_fence = F.col("__m") > 0
    opened = [F.when(is_fence & (F.col("__s") == F.col("__m")), mark).otherwise("").alias("opened")] if keep_open else []
    return rows.select(*lines.columns, is_fence.alias("is_fence"), ((F.col("__s") > 0) | is_fence).alias("fenced"), *opened)


def headings(lines: DataFrame, min_depth: int = 1) -> DataFrame:
    """Headings outside fences: docno, line, depth, text."""
    found = with_fence(lines).where(~F.col("fenced")).withColumn("mark", F.regexp_extract("text", HEADING, 1))
    return found.where(F.length("mark") >= min_depth).select("docno", "line", F.length("mark").alias("depth"), F.trim(F.regexp_extract("text", HEADING, 2)).alias("text"))


def _collapsed(lines: DataFrame) -> DataFrame:
    """collapse_blank by the lines' old numbers, so that what follows needs no other sort."""
    blank = F.trim("text") == ""
    kept = lines.withColumn("blank", blank).withColumn("after", F.lag("blank").over(in_order())).where(~(F.col("blank") & F.coalesce("after", F.lit(False))))
    return kept.select("docno", "line", F.when(F.col("blank"), "").otherwise(F.col("text")).alias("text"))


def _renumbered(lines: DataFrame) -> DataFrame:
    return lines.select("docno", F.row_number().over(in_order()).alias("line"), "text")


def collapse_blank(lines: DataFrame) -> DataFrame:
    """Of a run of blank lines the first stays, emptied; lines are numbered anew."""
    return _renumbered(_collapsed(lines))


def drop_orphan_separators(lines: DataFrame) -> DataFrame:
    """Separator rows that no table row precedes go; blanks are collapsed before and after, lines numbered once: one sort serves all."""
    once = _collapsed(lines)
    separator = F.trim("text").rlike(SEPARATOR)
    # a separator after a kept separator follows a table row; so only the last line that isn't a separator decides
    last = F.last(F.when(~separator, F.col("text")), ignorenulls=True).over(before())
    good = ~separator | F.coalesce(F.ltrim(last).startswith("|"), F.lit(False))
    return collapse_blank(once.withColumn("good", good).where("good").drop("good"))


def next_solid(lines: DataFrame, solid: Column, name: str) -> DataFrame:
    """lines with the next value of solid that isn't null after each line, in one pass: a frame up to the document's end would
    be read anew for every line."""
    return lines.withColumn("__solid", solid).withColumn(name, F.expr("lead(__solid) ignore nulls over (partition by docno order by line)")).drop("__solid")


#: Page marks that are dropped where no patterns are given.
PAGE_MARKS = [r"第\s*\d+\s*页\s*/?\s*共\s*\d+\s*页$", r"\d+\s*/\s*\d+$", r"Page\s*\d+\s*(?:of\s*\d+)?$", r"\d{1,4}$"]


def drop_footers(lines: DataFrame, patterns: list[str] = PAGE_MARKS) -> DataFrame:
    """Lines whose trimmed text begins with a match of any pattern go."""
    return lines.where(~F.trim("text").rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")") | (F.trim("text") == ""))


def drop_duplicate_title(lines: DataFrame, titles: DataFrame, first: int = 10) -> DataFrame:
    """The first of the first lines that repeats the document's title, punctuation aside, goes. titles: docno, title."""
    key = lambda c: F.regexp_replace(c, r"[\s_\-–—·．.#]+", "")
    joined = lines.join(titles, "docno", "left")
    same = (F.col("line") <= first) & (key("text") == key("title")) & (key("title") != "") & ~F.ltrim("text").startswith("|")
    hit = F.min(F.when(same, F.col("line"))).over(Window.partitionBy("docno"))
    return joined.withColumn("hit", hit).where("hit is null or line <> hit").select(*lines.columns)


#: An entry of a table of contents, and the number an entry or a heading starts with.
CONTENTS_ENTRY, LEADING_NUMBER = r"^(.*?)\.{4,}\s*(\d+)\s*$", r"^(\d+(?:\.\d+)*)\.?\s*(.*)$"
#: The two layouts of numbered headings, a number alone on its line and a number before its title.
NUMBER_ALONE, NUMBER_INLINE = r"^(\d+(?:\.\d+)*)(\.?)$", r"^(\d{1,3}(?:\.\d+){0,4})[.\s、:：]{1,4}(\S.*)$"


def table_of_contents(lines: DataFrame) -> DataFrame:
    """`title....page` lines: docno, line, num (null without one), title, page."""
    pattern, number = CONTENTS_ENTRY, LEADING_NUMBER
    found = lines.where(F.col("text").rlike(pattern)).withColumn("head", F.trim(F.regexp_extract("text", pattern, 1)))
    num = F.regexp_extract("head", number, 1)
    return found.select("docno", "line", F.when(num != "", num).alias("num"), F.when(num != "", F.trim(F.regexp_extract("head", number, 2))).otherwise(F.col("head")).alias("title"), F.regexp_extract("text", pattern, 2).cast("long").alias("page"))


#: How a title begins, the script whose titles may be short, its least and greatest length, and marks it doesn't hold.
TITLE_START, SHORT_SCRIPT, TITLE_LENGTH, NOT_IN_TITLE = r"^[\u4e00-\u9fffA-Za-z]", r"[\u4e00-\u9fff]", (4, 60), "[。；：,，]"


def plausible_title(c: Column) -> Column:
    least, most = TITLE_LENGTH
    return c.rlike(TITLE_START) & (c.rlike(SHORT_SCRIPT) | (F.length(c) >= least)) & (F.length(c) <= most) & ~c.rlike(NOT_IN_TITLE)


def numbered_headings(lines: DataFrame) -> DataFrame:
    """Candidates `1.1` alone before a title line, or `1.1 title`: docno, line, num, title, last (line consumed)."""
    text = F.trim("text")
    rows = next_solid(lines.withColumn("s", text), F.when(text != "", F.struct(F.col("line"), text.alias("s"))), "following")
    alone, inline = NUMBER_ALONE, NUMBER_INLINE
    num = F.coalesce(F.nullif(F.regexp_extract("s", alone, 1), F.lit("")), F.regexp_extract("s", inline, 1))
    single, dotted = F.col("s").rlike(alone), F.col("s").rlike(r"\.$")
    title = F.when(single, F.col("following.s")).otherwise(F.trim(F.regexp_extract("s", inline, 2)))
    parts = F.split("num", r"\.")
    rows = rows.withColumn("num", num).where("num <> ''").withColumn("title", title).withColumn("last", F.when(single, F.col("following.line")).otherwise(F.col("line")))
    shape = ~single | F.when(dotted, F.size(parts) == 1).otherwise(F.size(parts) >= 2)
    return rows.where(shape & F.forall(parts, lambda p: p.cast("int") >= 1) & plausible_title(F.col("title"))).select("docno", "line", "num", "title", "last")


def ordered_numbers(candidates: DataFrame) -> DataFrame:
    """Of numbered candidates those that never fall behind the last kept number nor skip a level below it."""
    tuple_of = lambda n: F.transform(F.split(F.rtrim(n, F.lit(".")), r"\."), lambda p: p.cast("int"))
    rows = candidates.groupBy("docno").agg(F.sort_array(F.collect_list(F.struct("line", tuple_of(F.col("num")).alias("t")))).alias("rows"))
    start = F.struct(F.lit(None).cast("array<int>").alias("last"), F.array().cast("array<int>").alias("kept"))
    fits = lambda acc, x: acc["last"].isNull() | ((x["t"] >= acc["last"]) & (F.size(x["t"]) <= F.size(acc["last"]) + 1))
    step = lambda acc, x: F.when(fits(acc, x), F.struct(x["t"].alias("last"), F.concat(acc["kept"], F.array(x["line"])).alias("kept"))).otherwise(acc)
    kept = rows.select("docno", F.explode(F.aggregate("rows", start, step, lambda acc: acc["kept"])).alias("line"))
    return candidates.join(kept, ["docno", "line"], "left_semi")


def residual(raw: Column, num: Column, title: Column) -> Column:
    """What a heading's line holds besides its marks, number and title."""
    rest = F.regexp_replace(F.trim(raw), F.concat(F.lit(r"^[\s|\-*#>]*"), F.replace(num, F.lit("."), F.lit(r"\.")), F.lit(r"\.?\s*")), F.lit(""))
    at = F.instr(rest, title)
    cut = F.concat(F.substr(rest, F.lit(1), at - 1), F.substr(rest, at + F.length(title)))
    return F.when((title != "") & (at > 0), F.trim(cut, F.lit(" |"))).otherwise(rest)


def inject_headings(lines: DataFrame, heads: DataFrame, table_split: bool = True) -> DataFrame:
    """Heading rows become `## num title` between blank lines; consumed rows go; lines are numbered anew. A column level
    gives a heading its rank, else its number does.

    A heading in a table row splits the table: an empty header row and separator of its width follow, then the row, and a
    separator right after it goes. Of other heading lines what is neither number nor title stays as a line of its own.
    """
    level = F.least(F.size(F.split("num", r"\.")) + 1, F.lit(6))
    if "level" in heads.columns:
        level = F.coalesce("level", level)
    head = F.concat_ws(" ", F.repeat(F.lit("#"), level), F.trim(F.regexp_replace(F.concat_ws(" ", "num", "title"), r"\s+", " ")))
    marked = heads.select("docno", "line", "last", "num", "title", head.alias("head"))
    own = lines.join(marked, ["docno", "line"], "left")
    in_table = F.col("head").isNotNull() & F.ltrim("text").startswith("|") & F.lit(table_split)
    rows = own.withColumn("split", in_table).withColumn("until", F.max("last").over(up_to()))
    orphan = F.coalesce(F.lag("split").over(in_order()), F.lit(False)) & F.trim("text").rlike(SEPARATOR)
    rows = rows.withColumn("orphan", orphan)
    rows = rows.where(F.col("head").isNotNull() | ((F.col("until").isNull() | (F.col("line") > F.col("until"))) & ~F.col("orphan")))
    width = F.greatest(F.size(F.split(F.trim(F.trim("text"), F.lit("|")), r"\|")), F.lit(2))
    table = F.array(F.lit(""), F.col("head"), F.lit(""), F.concat(F.lit("|"), F.repeat(F.lit("  |"), width)), F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width)), F.rtrim("text"))
    rest = residual(F.col("text"), F.col("num"), F.col("title"))
    rest = F.when((F.length(rest) > 2) & ~rest.rlike(SEPARATOR), F.array(rest)).otherwise(F.array().cast("array<string>"))
    new = F.when(F.col("split"), table).when(F.col("head").isNotNull(), F.concat(F.array(F.lit(""), F.col("head"), F.lit("")), rest)).otherwise(F.array(F.rtrim("text")))
    out = rows.select("docno", "line", F.posexplode(new).alias("part", "text"))
    return out.select("docno", F.row_number().over(Window.partitionBy("docno").orderBy("line", "part")).alias("line"), "text")


def hybrid_outline(entries: DataFrame, numbered: DataFrame) -> DataFrame:
    """Headings found by a table of contents, and of the numbered ones those on other lines: docno, line, num, title, last, origin."""
    a = entries.select("docno", "line", "num", "title", F.col("line").alias("last"), F.lit("toc").alias("origin"))
    b = numbered.join(entries.select("docno", "line"), ["docno", "line"], "left_anti").select("docno", "line", "num", "title", "last", F.lit("numbered").alias("origin"))
    return a.unionByName(b)


def outline_strategy(docs: DataFrame, numbered: DataFrame, entries: DataFrame, heads: DataFrame, least: int = 3) -> DataFrame:
    """docno, strategy, n: numbered headings where there are `least`, else contents entries where there are two, else the source's own, else none."""
    count = lambda rows, name: rows.groupBy("docno").agg(F.count(F.lit(1)).alias(name))
    rows = docs.select("docno").distinct()
    for part, name in ((numbered, "numbered"), (entries, "toc"), (heads, "source")):
        rows = rows.join(count(part, name), "docno", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    kind = F.when(F.col("numbered") >= least, "numbered").when(F.col("toc") >= 2, "toc").when(F.col("source") > 0, "source").otherwise("none")
    n = F.when(kind == "numbered", F.col("numbered")).when(kind == "toc", F.col("toc")).when(kind == "source", F.col("source")).otherwise(0)
    return rows.select("docno", kind.alias("strategy"), n.cast("long").alias("n"))


#: The marks that may stand before a heading's number, and the blanks that comparing titles leaves out.
BEFORE_NUMBER, BLANK_OR_BAR = r"(?U)^[\s|\-*#>]*([0-9]+(?:\.[0-9]+)*)", r"(?U)[\s|]"


#: Entries that are walked before their hits join the ones found before; appending to all of them one by one is quadratic.
WALKED = 256


def first_at(at: Column, k: Column) -> Column:
    """The index in `at`, an array of structs in order of their k, of the first with this k or a larger one: a binary search."""
    halves = F.sequence(F.lit(1), F.ceil(F.log2(F.size(at) + 1)).cast("int"))
    middle = lambda s: F.shiftright(s["lo"] + s["hi"], 1)
    before = lambda s: F.get(at, middle(s))["k"] < k
    half = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(before(s), F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi")))
    return F.aggregate(halves, F.struct(F.lit(0).alias("lo"), F.size(at).alias("hi")), half, lambda s: s["lo"])


def locate_entries(lines: DataFrame, entries: DataFrame, window: int = 1200) -> DataFrame:
    """Where numbered entries of a table of contents stand in the body: found in order from the last hit within a window,
    else from the top. entries: docno, pos, num, title.

    A line can only hold the entry whose number it begins with, so lines meet entries by document and number, once for all
    entries of one number and title; what stays is a walk over each document's entries that finds the next fitting line by halves.
    """
    flat = lambda c: F.regexp_replace(c, BLANK_OR_BAR, "")
    placed = lines.withColumn("k", F.row_number().over(in_order()) - 1)
    numbers = placed.select("docno", "k", "line", F.regexp_extract("text", BEFORE_NUMBER, 1).alias("num"), flat("text").alias("flat")).where("num <> ''")
    wanted = entries.where("num is not null").select("docno", "pos", "num", "title")
    names = wanted.select("docno", "num", "title").distinct().withColumn("want", flat("title"))
    met = names.join(numbers, ["docno", "num"]).where(F.col("flat").contains(F.col("want")))
    fits = met.groupBy("docno", "num", "title").agg(F.sort_array(F.collect_list(F.struct("k", F.col("line").cast("int").alias("line")))).alias("at"))
    fits = fits.withColumn("q", F.row_number().over(Window.partitionBy("docno").orderBy("num", "title")) - 1)
    told = fits.groupBy("docno").agg(F.sort_array(F.collect_list(F.struct("q", "num", "title", "at"))).alias("told"))
    asked = wanted.join(fits.select("docno", "num", "title", "q"), ["docno", "num", "title"])
    block = F.floor((F.row_number().over(Window.partitionBy("docno").orderBy("pos", "num", "title")) - 1) / WALKED)
    asked = asked.select("docno", block.alias("b"), "pos", "q").groupBy("docno", "b").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "q"))), lambda x: x["q"]).alias("asked"))
    asked = asked.groupBy("docno").agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "asked"))), lambda x: x["asked"]).alias("asked"))
    none = F.array().cast("array<struct<line:int,q:int>>")

    def step(acc: Column, q: Column) -> Column:
        at = F.get("told", q)["at"]
        near = F.get(at, first_at(at, acc["k"]))
        hit = F.when(near["k"] < acc["k"] + window, near).otherwise(F.get(at, F.lit(0)))
        return F.aggregate(F.array(hit), acc, lambda a, h: F.struct(F.greatest(a["k"], h["k"]).alias("k"), F.concat(a["found"], F.array(F.struct(h["line"].alias("line"), q.alias("q")))).alias("found")))

    def walk(acc: Column, block: Column) -> Column:
        walked = F.aggregate(block, F.struct(acc["k"].alias("k"), none.alias("found")), step)
        return F.aggregate(F.array(walked), acc, lambda a, w: F.struct(w["k"].alias("k"), F.concat(a["found"], w["found"]).alias("found")))

    found = F.aggregate("asked", F.struct(F.lit(0).alias("k"), none.alias("found")), walk, lambda acc: acc["found"])
    hits = asked.join(told, "docno").select("docno", "told", F.explode(found).alias("hit"))
    named = F.get("told", F.col("hit.q"))
    return hits.select("docno", "hit.line", named["num"].alias("num"), named["title"].alias("title"))


def outline(lines: DataFrame, specs: DataFrame, manual: DataFrame | None = None, least: int = 3, window: int = 1200) -> DataFrame:
    """Headings by each document's own strategy: docno, line, num, title, level, last, origin; lines count from its body's start.

    specs: docno, strategy, toc_from, toc_to (lines of the contents; null: before the body, for `auto` anywhere), body_start (from 1).
    Strategies: `toc` locates the contents' entries in the body; `numbered` takes numbered headings; `hybrid` adds to the entries
    the numbered headings on other lines; `manual` takes `manual` (docno, line, level, title); `source` takes the text's own
    headings; `auto` takes numbered ones where there are `least`, else entries where there are two, else the source's own.
    Contents and body are told apart by line, so an entry is never found in the contents themselves.
    """
    kind = F.coalesce("strategy", F.lit("auto"))
    start = F.when(kind.isin("manual", "source"), 1).otherwise(F.coalesce("body_start", F.lit(1)))
    full = specs.select("docno", kind.alias("strategy"), start.cast("int").alias("start"), "toc_from", F.when(kind == "auto", F.col("toc_to")).otherwise(F.coalesce("toc_to", start - 1)).alias("toc_to"))
    placed = lines.join(full, "docno")
    inside = (F.col("line") >= F.coalesce("toc_from", F.lit(1))) & F.coalesce(F.col("line") <= F.col("toc_to"), F.lit(True))
    contents = table_of_contents(placed.where(F.col("strategy").isin("toc", "hybrid", "auto") & inside))
    body = placed.where(F.col("line") >= F.col("start")).select("docno", (F.col("line") - F.col("start") + 1).cast("int").alias("line"), "text", "strategy")
    searched = body.where("strategy in ('toc', 'hybrid', 'auto')").drop("strategy")
    located = locate_entries(searched, contents.withColumnRenamed("line", "pos"), window)
    numbered = ordered_numbers(numbered_headings(body.where("strategy in ('numbered', 'hybrid', 'auto')").drop("strategy")))
    own = headings(body.where("strategy in ('source', 'auto')").drop("strategy"))

    auto = full.where("strategy = 'auto'").select("docno")
    chosen = outline_strategy(auto, numbered, contents, own, least).select("docno", F.col("strategy").alias("used"))
    used = full.join(chosen, "docno", "left").select("docno", F.coalesce("used", "strategy").alias("used"))
    of = lambda rows, kinds: rows.join(used.where(F.col("used").isin(*kinds)).select("docno"), "docno", "left_semi")
    level = F.least(F.size(F.split("num", r"\.")) + 1, F.lit(6)).alias("level")
    rows = hybrid_outline(of(located, ["toc", "hybrid"]), of(numbered, ["numbered", "hybrid"]))
    rows = rows.select("docno", "line", "num", "title", level, "last", "origin")
    blank = F.lit(None).cast("string").alias("num")
    rows = rows.unionByName(of(own, ["source"]).select("docno", "line", blank, F.col("text").alias("title"), F.col("depth").alias("level"), F.col("line").alias("last"), F.lit("source").alias("origin")))
    if manual is not None:
        rows = rows.unionByName(of(manual, ["manual"]).select("docno", F.col("line").cast("int").alias("line"), blank, "title", F.col("level").cast("int").alias("level"), F.col("line").cast("int").alias("last"), F.lit("manual").alias("origin")))
    return rows


#: Starts of numbered lines and of captions, which are no prose, and the longest prose line.
NUMBERED_LINE, CAPTION, LONGEST_PROSE = r"^\d+(\.\d+)*[.\s、]", r"^(图|表|注|第|Figure|Table)\s*[.\d]", 200


def is_prose(c: Column) -> Column:
    t = F.trim(c)
    return (t != "") & ~t.rlike(NOT_PROSE) & ~t.rlike(NUMBERED_LINE) & ~t.rlike(CAPTION) & (F.length(t) <= LONGEST_PROSE)


#: Lines that are folded together: what is done so far is copied once a block, not once a line.
FOLDED = 256


def join_prose(lines: DataFrame, longest: int = 160) -> DataFrame:
    """Hard-wrapped prose lines are rejoined up to `longest` characters, a greedy fold over each document's lines, block by block."""
    rows = lines.groupBy("docno").agg(F.sort_array(F.collect_list(F.struct("line", "text", is_prose(F.col("text")).alias("prose")))).alias("rows"))
    state = lambda done, buf, open_, any_: F.struct(done.alias("done"), buf.alias("buf"), open_.alias("open"), any_.alias("any"))
    none = F.array().cast("array<string>")
    glue = lambda a, x: F.when(a.rlike("[A-Za-z0-9]$") & x.rlike("^[A-Za-z0-9]"), F.concat_ws(" ", a, x)).otherwise(F.concat(a, x))

    def step(acc: Column, row: Column) -> Column:
        text = F.trim(row["text"])
        joins = acc["any"] & acc["open"] & row["prose"] & ~acc["buf"].rlike(SENTENCE_END) & (F.length(acc["buf"]) + F.length(text) <= longest)
        done = F.when(acc["any"] & ~joins, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"])
        buf = F.when(joins, glue(acc["buf"], text)).otherwise(F.when(row["prose"], F.rtrim(row["text"])).otherwise(row["text"]))
        return state(done, buf, row["prose"], F.lit(True))

    def block(acc: Column, rows: Column) -> Column:
        folded = F.aggregate(rows, state(none, acc["buf"], acc["open"], acc["any"]), step)
        return F.aggregate(F.array(folded), acc, lambda a, x: state(F.concat(a["done"], F.array(x["done"])), x["buf"], x["open"], x["any"]))

    firsts = F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / FOLDED).cast("int"))
    blocks = F.transform(firsts, lambda i: F.slice("rows", i * FOLDED + 1, F.lit(FOLDED)))
    start = state(F.array().cast("array<array<string>>"), F.lit(""), F.lit(False), F.lit(False))
    folded = rows.select("docno", F.aggregate(blocks, start, block, lambda a: F.concat(F.flatten(a["done"]), F.array(a["buf"]))).alias("out"))
    return folded.select("docno", F.posexplode("out").alias("pos", "text")).select("docno", (F.col("pos") + 1).alias("line"), "text")


def demote(lines: DataFrame, by: int = 1, only_top: bool = False) -> DataFrame:
    """Headings outside fences lose rank, six marks at most; only_top: just H1 becomes H2."""
    hashes = F.regexp_extract("text", r"^(#{1,6})\s", 1)
    deeper = F.least(F.length(hashes) + by, F.lit(6))
    hit = ~F.col("fenced") & (F.length(hashes) == 1 if only_top else hashes != "")
    new = F.concat(F.repeat(F.lit("#"), deeper.cast("int")), F.expr(r"regexp_replace(text, '^#+', '')"))
    return with_fence(lines).select("docno", "line", F.when(hit, new).otherwise(F.col("text")).alias("text"))


def nearest_heading(lines: DataFrame, min_depth: int = 2) -> DataFrame:
    """Lines with the section and section_line of the last heading up to them; lines before any have null. One window pass."""
    mark = F.regexp_extract("text", HEADING, 1)
    head = F.when(~F.col("fenced") & (F.length(mark) >= min_depth), F.struct(F.trim(F.regexp_extract("text", HEADING, 2)).alias("section"), F.col("line").alias("section_line")))
    rows = with_fence(lines).withColumn("at", F.last(head, ignorenulls=True).over(up_to()))
    return rows.select("docno", "line", "text", F.col("at.section").alias("section"), F.col("at.section_line").alias("section_line"))


def term_hits(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """Lines that hold any keyword of a term, counted by section: docno, term, section, hits, first_line. terms: term, keywords."""
    placed = nearest_heading(lines).where("section is not null")
    hit = placed.join(terms, F.exists("keywords", lambda k: F.col("text").contains(k)))
    return hit.groupBy("docno", "term", "section").agg(F.count(F.lit(1)).alias("hits"), F.min("line").alias("first_line"))


def top_sections(hits: DataFrame, k: int = 8, at_least: int = 2, fallback: int = 3) -> DataFrame:
    """Top k by hits, ties by first line; of these the strong ones, or the first few where none is strong."""
    same = Window.partitionBy("docno", "term")
    ranked = hits.withColumn("rank", F.row_number().over(same.orderBy(F.desc("hits"), "first_line"))).where(F.col("rank") <= k)
    strong = F.max((F.col("hits") >= at_least).cast("int")).over(same)
    return ranked.withColumn("strong", strong).where(F.when(F.col("strong") == 1, F.col("hits") >= at_least).otherwise(F.col("rank") <= fallback)).drop("strong")


def chunks(lines: DataFrame, target: int = 350, least: int = 250) -> DataFrame:
    """Greedy cuts at headings once a chunk spans `target` lines; a short tail joins the last: docno, no, start, end."""
    sizes = lines.groupBy("docno").agg(F.max("line").alias("n")).where(F.col("n") >= least)
    bounds = headings(lines).groupBy("docno").agg(F.sort_array(F.collect_list("line")).alias("bounds"))
    cut = F.aggregate("bounds", F.array(F.lit(1)), lambda acc, h: F.when(h - F.element_at(acc, -1) >= target, F.concat(acc, F.array(h))).otherwise(acc))
    rows = sizes.join(bounds, "docno").withColumn("starts", cut)
    tail = F.col("n") - F.element_at("starts", -1) + 1
    rows = rows.withColumn("starts", F.when((F.size("starts") > 1) & (tail < target // 4), F.slice("starts", 1, F.size("starts") - 1)).otherwise(F.col("starts"))).where(F.size("starts") > 1)
    rows = rows.select("docno", "n", "starts", F.posexplode("starts").alias("pos", "start"))
    return rows.select("docno", (F.col("pos") + 1).alias("no"), "start", F.coalesce(F.get("starts", F.col("pos") + 1) - 1, F.col("n")).alias("end"))


def chunk_sections(cut: DataFrame, heads: DataFrame, most: int = 40) -> DataFrame:
    """chunks with the headings they hold, in order, at most `most`. Both sides are keyed by document."""
    inside = cut.join(heads.select("docno", "line", "text"), "docno").where(F.col("line").between(F.col("start"), F.col("end")))
    listed = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("line", "text"))), 1, most), lambda x: x["text"])
    return cut.join(inside.groupBy("docno", "no").agg(listed.alias("sections"), F.count(F.lit(1)).alias("n_sections")), ["docno", "no"], "left")


def level_histogram(heads: DataFrame) -> DataFrame:
    return heads.groupBy("docno", "depth").agg(F.count(F.lit(1)).alias("n"))


def outline_quality(heads: DataFrame, expected: Column | None = None) -> DataFrame:
    """Coverage times jump penalty times order penalty, three decimals: docno, headings, jumps, disorder, score."""
    num = F.regexp_extract("text", r"^(\d+(?:\.\d+)*)", 1)
    t = F.when(num != "", F.transform(F.split(num, r"\."), lambda p: p.cast("int")))
    rows = heads.withColumn("t", t).withColumn("jump", F.col("depth") - F.lag("depth").over(in_order()) > 2).withColumn("before", F.last("t", ignorenulls=True).over(before()))
    # with no number before, nothing is out of order
    sums = rows.groupBy("docno").agg(
        F.count(F.lit(1)).alias("headings"), F.count_if(F.col("jump")).alias("jumps"), F.count_if(F.col("t") < F.col("before")).alias("disorder"), F.count("t").alias("numbered")
    )
    cover = F.lit(1.0) if expected is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(1 - F.col("headings") / expected)))
    jumps = F.when(F.col("jumps") > 0, F.greatest(F.lit(0.5), 1 - 0.02 * F.col("jumps"))).otherwise(1.0)
    order = F.when(F.col("disorder") > 0.05 * F.col("numbered"), 0.9).otherwise(1.0)
    return sums.select("docno", "headings", "jumps", "disorder", F.round(cover * jumps * order, 3).alias("score"))


def empty_sections(lines: DataFrame) -> DataFrame:
    """`## ` lines that only blanks separate from the next one, or from the end."""
    # without blanks the next line decides, and only such lines' texts are sorted
    rows = lines.where(F.trim("text") != "").select("docno", "line", F.when(F.col("text").startswith("## "), F.col("text")).alias("text"))
    rows = rows.withColumn("ends", F.lead(F.col("text").isNotNull(), 1, True).over(in_order()))
    return rows.where(F.col("text").isNotNull() & F.col("ends")).select("docno", "line", "text")


def section_slice(lines: DataFrame, title: str) -> DataFrame:
    """Lines from a heading of rank 2 to 4 whose text holds title to before the next heading of rank 1 to 4."""
    head = F.col("text").rlike(r"^#{1,4}\s")
    opens = F.col("text").rlike(r"^#{2,4}\s") & F.col("text").contains(title)
    island = F.last(F.when(head, opens), ignorenulls=True).over(up_to())
    return lines.withColumn("inside", island).where(F.coalesce("inside", F.lit(False))).select("docno", "line", "text")


def repeated_lines(lines: DataFrame, least: int = 12, files: int = 2, boilerplate: tuple[str, ...] = ()) -> DataFrame:
    """Trimmed lines of at least `least` characters that stand in several documents: text, docs."""
    t = lines.select("docno", F.trim("text").alias("text")).where(F.length("text") >= least)
    for p in boilerplate:
        t = t.where(~F.col("text").startswith(p))
    # pairs first, so a line that all documents share is counted from partial sums
    return t.distinct().groupBy("text").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= files)


def markdown_faults(lines: DataFrame) -> DataFrame:
    """docno, kind, line: not exactly one H1, first line no H1, stray trailing blanks, table separators of another width, more than six heading marks."""
    whole = Window.partitionBy("docno")
    h1 = F.col("text").rlike(r"^#\s")
    rows = with_fence(lines).withColumn("h1s", F.sum((h1 & ~F.col("fenced")).cast("int")).over(whole)).withColumn("before", F.lag("text").over(in_order()))
    pipes = lambda c: F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))
    faults = F.array(
        F.when((F.col("line") == 1) & (F.col("h1s") != 1), "h1_count"),
        F.when((F.col("line") == 1) & ~h1, "first_line"),
        F.when(F.col("text").rlike(r"\s$") & ~F.col("text").rlike(r"\S  $"), "trailing_blank"),
        F.when(F.trim("text").rlike(SEPARATOR) & F.ltrim("before").startswith("|") & (pipes(F.trim("text")) != pipes(F.trim("before"))), "separator_width"),
        F.when(F.col("text").rlike(r"^#{7,}\s") & ~F.col("fenced"), "too_deep"),
    )
    return rows.select("docno", "line", F.explode(F.array_compact(faults)).alias("kind"))


def over_budget(lines: DataFrame, budgets: DataFrame, default: int = 80) -> DataFrame:
    """docno, lines, budget of documents with more lines than their budget. budgets: docno, budget."""
    sizes = lines.groupBy("docno").agg(F.count(F.lit(1)).alias("lines")).join(budgets, "docno", "left")
    return sizes.withColumn("budget", F.coalesce("budget", F.lit(default))).where(F.col("lines") > F.col("budget"))


def bare_fences(lines: DataFrame) -> DataFrame:
    """docno, line of fences that open a block without naming its language."""
    return with_fence(lines, keep_open=True).where(F.col("is_fence") & (F.col("opened") != "") & (F.trim("text") == F.col("opened"))).select("docno", "line")

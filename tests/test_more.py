"""Odd cases of operators that the registered queries' data doesn't hold."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import text as tx
from quarrymill.operators import cdc, evidence as evd, events as ev, lines as ln, modules as mo, sheets as sh
from quarrymill.plans import catalog, more, tickets  # noqa: F401  (tickets adds to the catalog)
from quarrymill.sources import html_text, inputs


def doc(spark, *texts):
    return spark.createDataFrame([(1, n + 1, t) for n, t in enumerate(texts)], "docno int, line int, text string")


def test_a_fence_is_closed_by_its_own_mark(spark):
    lines = doc(spark, "```", "~~~", "# in", "```", "# out", "~~~ py", "```", "# in too", "  ~~~", "## also out", "```", "# open to the end")
    assert [(r.line, r.text) for r in ln.headings(lines).orderBy("line").collect()] == [(5, "out"), (10, "also out")]
    assert [r.line for r in ln.bare_fences(lines).orderBy("line").collect()] == [1, 11]
    assert [r.section_line for r in ln.nearest_heading(lines, 1).orderBy("line").collect()] == [None] * 4 + [5] * 5 + [10] * 3


def test_localised_leaves_other_text_alone(spark):
    bodies = ["hello! world", "wow! see !a.png! end", "!A.PNG!!b.log!", "[b.log] and ![c.pdf]", "", None, "!", "x!a b.png!y"]
    texts = spark.createDataFrame([("K", i, b) for i, b in enumerate(bodies)], "key string, id int, body string")
    files = spark.createDataFrame([("K", "a.png", "l/a"), ("K", "B.log", "l/b"), ("Z", "c.pdf", "l/c")], "key string, filename string, local string")
    got = {r.id: r.body for r in evd.localised(texts, files).collect()}
    assert got == {0: "hello! world", 1: "wow! see [l/a] end", 2: "[l/a][l/b]", 3: "[l/b] and ![c.pdf]", 4: "", 5: None, 6: "!", 7: "x!a b.png!y"}


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_ranked_equals_sorting(spark, parts):
    rng = random.Random(parts)
    keys = [f"d/{rng.randint(0, 10**6)}" for _ in range(500)] + ["d/same"] * 3
    rows = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)
    got = sorted((r.rank, r.k) for r in cdc.ranked(rows, "k", parts=parts).collect())
    assert got == [(n + 1, k) for n, k in enumerate(sorted(keys))]
    assert cdc.ranked(rows.limit(0), "k").count() == 0
    used = spark.createDataFrame([(1,), (2,), (5,), (900,)], "n int")
    assert [r.n for r in cdc.free_numbers(used, 4).orderBy("rank").collect()] == [3, 4, 6, 7]


def test_hits_of_a_frequent_id(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    got = ev.hits_per_id(rows, spark.createDataFrame([(0,), (0,), (7,)], "k long"), "k", "id", 3).orderBy("id").collect()
    assert [(r.id, r.nth, r.hits) for r in got] == [(0, 1, 500), (2, 2, 500), (4, 3, 500)]


def test_specs_and_structure(spark):
    assert sh.normalised_spec({"structured": "generic", "a": 1}) == ("generic", {"structured": "generic", "a": 1})
    assert sh.normalised_spec({"structured": {"kind": "can_matrix", "a": 2}, "a": 1})[1]["a"] == 2
    assert sh.normalised_spec({}) == ("", {}) and sh.structured({}, None) == {}
    grid = [["Title", "", ""], ["No", "Name", "Unit"], ["", "long", "kg"], ["note", "", ""], ["1", "x", "y"], ["z", "z", ""]]
    cells = spark.createDataFrame([("s", r + 1, c + 1, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "sheet string, row int, col int, value string")
    made = sh.structured({"structured": {"type": "sheets", "sheet_titles": {"s": "S"}}}, cells)
    assert [r.part for r in made["parts"].orderBy("row").collect()] == ["pre", "header", "header", "note", "body", "body"]
    assert [tuple(r) for r in made["index"].collect()] == [("s", "S", "No|Name<br>long|Unit<br>kg", 2)]
    assert sorted(r.text for r in made["notes"].collect()) == ["Title", "note"]
    matrix = [["", "Name", "", "Id"], ["", "M1", "", "0x2"], ["", "", "sig", ""], ["", "M2", "", "0x1"]]
    cells = spark.createDataFrame([("s", r, c, v) for r, row in enumerate(matrix) for c, v in enumerate(row)], "sheet string, row int, col int, value string")
    rows = sh.structured({"structured": {"kind": "can_matrix", "structured_rules": {"columns": {"signal": 2}}}}, cells)["messages"]
    assert [(r.message, r.nth) for r in rows.orderBy("row").collect()] == [("M1", 1), ("M1", 2), ("M2", 1)]
    assert [(r.message, r.signal) for r in sh.signal_table(rows, ["signal"]).collect()] == [("M1", "sig")]


def test_guards_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, "summary: x"), (2, "y")], "id int, text string")
    assert rows.where("id = 1").select(tx.must_hold("text", "summary")).first()[0] == "summary: x"
    with pytest.raises(Exception, match="lacks"):
        rows.select(tx.must_hold("text", "summary")).collect()
    path = f"file://{tmp_path}/raw"
    assert cdc.snapshot(rows, path, "id", "text").count() == 2
    assert cdc.snapshot(rows.unionByName(spark.createDataFrame([(2, "new")], "id int, text string")), path, "id", "text").count() == 3


def test_root_configuration_names(spark):
    names = {"setup.py": True, "Dockerfile.dev": True, "a.config.mjs": True, "tsconfig.base.json": True, "readme.md": False, "xsetup.py": False, "cargo.toml2": False}
    rows = spark.createDataFrame([(n,) for n in names], "rel string").select("rel", mo.is_root_config("rel").alias("x")).collect()
    assert {r.rel: r.x for r in rows} == names


def test_commented_json(spark, tmp_path):
    text = '﻿{ // note "x"\n "a": "http://x/*no*/ \\" ,]", /* b\n */ "l": [1, 2, ], "o": {"k": 1,},\n}'
    assert inputs.parse_jsonc(text.lstrip("﻿")) == {"a": 'http://x/*no*/ " ,]', "l": [1, 2], "o": {"k": 1}}
    with pytest.raises(ValueError):
        inputs.parse_jsonc("{} /* open")
    (tmp_path / "c.json").write_text(text)
    assert inputs.read_config(spark, f"file://{tmp_path}/c.json", {"o": {"d": 2}, "z": 1})["o"] == {"d": 2, "k": 1}


def test_markdown_of_odd_pages(spark):
    html = "<H2 class=x>A &lt;b&gt;</h2><p>x<b>y</b> <a title=t href=\"/u\">l <i>i</i></a><br/>z</p><script>1</p></script><!-- <p> --><ul><li>one<li>two</ul>"
    rows = spark.createDataFrame([(html,), (None,), ("",), ("plain  text",)], "html string").select(html_text.html_markdown("html")).collect()
    assert [r[0] for r in rows] == ["## A <b>\nxy [l i](/u)\nz\n- one\n- two", "", "", "plain text"]


def test_long_comments_tell_their_own_length(spark, tmp_path):
    """A text longer than a comment's usual limit was cut twice, so its mark told the length of the first cut."""
    spark.createDataFrame([(1, 0, "user", "x" * 2500), (1, 1, "user", "short"), (2, 0, "user", "y" * 31)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = more.flat_comments(spark, str(tmp_path)).orderBy("conv_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, ["x" * 30 + "…[2500]", "short"], False), (2, 1, ["y" * 30 + "…[31]"], False)]


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orphan_separators_sort_once(spark):
    """Renumbering between the windows made a second sort, which a task holds beside the first."""
    assert executed(ln.drop_orphan_separators(doc(spark, "a", "", "", "| --- |", "| b |", "| --- |"))).count("Sort [") == 1


def test_what_follows_is_read_once(spark):
    """A frame up to the end of a document is read anew for every line; the next solid line needs one pass."""
    lines = doc(spark, "## a", "", "## b", "text", "## c", "  ")
    assert [r.line for r in ln.empty_sections(lines).orderBy("line").collect()] == [1, 5]
    for found in (ln.empty_sections(lines), ln.numbered_headings(lines)):
        assert "unboundedfollowing" not in executed(found).lower()


def test_empty_sections_shuffle_and_sort_little(spark):
    """Lines were shuffled a second time, by another name of their document, and twice sorted with their texts."""
    plan = executed(catalog.QUERIES["empty_sections"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange hashpartitioning") == 1
    lines = doc(spark, "## a", " ", None, "## b", "## c", "x", "##", "## ", None)
    assert [tuple(r) for r in ln.empty_sections(lines).select("line", "text").orderBy("line").collect()] == [(1, "## a"), (4, "## b"), (8, "## ")]


def test_findings_read_what_follows_once(spark, tmp_path):
    """lint_findings takes its empty sections from the same step."""
    sf = "/root/testdata/sf0.001"
    assert "unboundedfollowing" not in executed(catalog.QUERIES["lint_findings"](spark, sf)).lower()


def test_located_entries_search_long_documents():
    """Forty documents of all parts: short ones never end the window from the last hit, which made the job smaller."""
    assert "p_partkey % 40 as docno" in catalog.ORACLES["located_entries"] and "p_partkey // 50" not in catalog.ORACLES["located_entries"]


def test_change_sets_do_not_pass_through_the_driver(spark):
    """Paths made from narrow columns were taken for small tables and broadcast."""
    sf = "/root/testdata/sf0.001"
    assert "BroadcastExchange" not in executed(catalog.QUERIES["change_set"](spark, sf))

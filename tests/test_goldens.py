"""Small goldens of the line, text, state and module operators."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import text as tx
from quarrymill.operators import cdc, events, evidence, lines as ln, modules as mo, records as rc


def lines_of(spark, texts, docno="d"):
    return spark.createDataFrame([(docno, i + 1, t) for i, t in enumerate(texts)], "docno string, line int, text string")


def heads_at(spark, at, n):
    return lines_of(spark, ["## h" if i + 1 in at else "x" for i in range(n)])


@pytest.mark.parametrize(
    "at,n,want",
    [
        ([1, 200, 380, 500, 760], 800, [(1, 379), (380, 800)]),
        ([1, 380, 760], 1000, [(1, 379), (380, 759), (760, 1000)]),
        ([1, 360, 720], 780, [(1, 359), (360, 780)]),
        ([1, 300], 420, []),
        ([1, 100, 200], 249, []),
    ],
)
def test_chunks(spark, at, n, want):
    assert [(r.start, r.end) for r in ln.chunks(heads_at(spark, at, n)).orderBy("no").collect()] == want


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text,want",
    [
        ("监听了3D5和583", ["0x3d5", "0x583"]),
        ("bus 0x2315 then 583", ["0x2315", "0x583"]),
        ("in 2026 see image-15-44-34-916.png at 2026-09-10 15:44:34", []),
        ("0x03d5 0x3D5", ["0x3d5"]),
        ("face bad 0x0", ["0x0", "0xface", "0xbad"]),
        (None, []),
    ],
)
def test_id_hints(spark, text, want):
    assert one(spark, text, tx.id_hints) == want


@pytest.mark.parametrize("text,want", [("时间15:30", ["15:30"]), ("9:05:07 and 09:05:07", ["09:05:07"]), ("25:10", []), ("1:2", []), ("12:34:56:78", [])])
def test_time_hints(spark, text, want):
    assert one(spark, text, tx.time_hints) == want


@pytest.mark.parametrize("text,want", [("WB101_x_y", "[WB101]x_y"), ("【WB101】t", "[WB101]t"), ("[WB101]t", "[WB101]t"), ("x WB101_y", "x WB101_y"), ("A_b", "A_b")])
def test_summary_code(spark, text, want):
    assert one(spark, text, tx.summary_code) == want


@pytest.mark.parametrize("text,want", [("Ａ１％，", "A1%，"), ("⻋⽂", "车文"), ("", "·"), ("", ""), ("é　x", "é　x")])
def test_normalised(spark, text, want):
    assert one(spark, text, tx.normalised) == want


@pytest.mark.parametrize("text,want", [("0x3D5", "0x3d5"), ("3D5", "0x3d5"), ("0x03d5", "0x3d5"), ("0", "0x0")])
def test_hex_id(spark, text, want):
    assert one(spark, text, tx.hex_id) == want


def test_truncation_marker_tells_the_length(spark):
    assert one(spark, "x" * 4001, lambda c: tx.truncated(c, 4000, "…[{n}]")) == "x" * 4000 + "…[4001]"
    assert one(spark, "x" * 4000, lambda c: tx.truncated(c, 4000)) == "x" * 4000


def test_ordered_numbers(spark):
    c = spark.createDataFrame([("d", i, n) for i, n in enumerate(["1", "1.1", "1.1.1.1", "1.2", "1.1", "2"])], "docno string, line int, num string")
    assert [r.num for r in ln.ordered_numbers(c).orderBy("line").collect()] == ["1", "1.1", "1.2", "2"]


@pytest.mark.parametrize("levels,texts,expected,want", [([2, 3, 2], ["1 a", "1.1 b", "2 c"], 3, 1.0), ([2, 3, 2], ["1 a", "1.1 b", "2 c"], 4, 0.75), ([2, 5, 2], ["1 a", "1.1.1.1 b", "2 c"], None, 0.98), ([2, 2], ["2 a", "1 b"], None, 0.9)])
def test_outline_quality(spark, levels, texts, expected, want):
    h = spark.createDataFrame([("d", i, d, t) for i, (d, t) in enumerate(zip(levels, texts))], "docno string, line int, depth int, text string")
    assert ln.outline_quality(h, None if expected is None else F.lit(float(expected))).first().score == want


def test_headings_skip_fences_of_both_kinds(spark):
    got = ln.headings(lines_of(spark, ["# A", "```", "# no", "```", "## B", "~~~", "# no", "~~~", "### C ", "#no"])).orderBy("line").collect()
    assert [(r.text, r.line, r.depth) for r in got] == [("A", 1, 1), ("B", 5, 2), ("C", 9, 3)]


def test_top_sections_fall_back(spark):
    rows = [("d1", "t", s, n, i) for i, (s, n) in enumerate([("a", 2), ("b", 3), ("c", 1)])] + [("d2", "t", s, 1, i) for i, s in enumerate("dcba")]
    hits = spark.createDataFrame(rows, "docno string, term string, section string, hits long, first_line int")
    got = {}
    for r in ln.top_sections(hits).orderBy("docno", "rank").collect():
        got.setdefault(r.docno, []).append(f"{r.section}{r.hits}")
    assert got == {"d1": ["b3", "a2"], "d2": ["d1", "c1", "b1"]}


def test_orphan_separator_goes_and_blanks_collapse(spark):
    got = ln.drop_orphan_separators(lines_of(spark, ["x", "", "| --- |", "", "y", "| a |", "| --- |", "| --- |"])).orderBy("line").collect()
    assert [r.text for r in got] == ["x", "", "y", "| a |", "| --- |", "| --- |"]


def test_prose_is_rejoined(spark):
    got = ln.join_prose(lines_of(spark, ["a wrapped", "line here.", "next", "# head", "漢字", "漢字", "x" * 159, "y"])).orderBy("line").collect()
    assert [r.text for r in got] == ["a wrapped line here.", "next", "# head", "漢字漢字", "x" * 159 + " y"]


def changes(spark, current, state):
    c = spark.createDataFrame(current, "relpath string, hash string")
    s = spark.createDataFrame(state, "relpath string, hash string, retired boolean")
    return sorted((r.kind, r.relpath, r.from_path) for r in cdc.change_set(c, s).collect())


def test_change_sets(spark):
    five = [(f"f{i}", f"h{i}", False) for i in range(1, 6)]
    now = [(p, h) for p, h, _ in five]
    kinds = lambda x: [k for k in x if k[0] != "unchanged"]
    assert kinds(changes(spark, now, five)) == []
    assert kinds(changes(spark, [("f1", "new"), *now[1:]], five)) == [("modified", "f1", None)]
    assert kinds(changes(spark, [("moved", "h1"), *now[1:]], five)) == [("renamed", "moved", "f1")]
    assert kinds(changes(spark, [*now, ("copy", "h1")], five)) == [("added", "copy", None)]
    assert kinds(changes(spark, [*now, ("back", "h9")], [*five, ("old", "h9", True)])) == [("renamed", "back", "old")]


def test_numbers_of_retired_documents_never_return(spark):
    state = spark.createDataFrame([(f"f{i}", f"h{i}", i == 3, f"0{i}") for i in range(1, 6)], "relpath string, hash string, retired boolean, docno string")
    now = spark.createDataFrame([(f"f{i}", f"h{i}") for i in (1, 2, 4, 5)] + [("new", "hn")], "relpath string, hash string")
    got = dict(tuple(r) for r in cdc.assign_numbers(cdc.change_set(now, state.drop("docno")), state, 1).collect())
    assert got == {"f1": "01", "f2": "02", "f4": "04", "f5": "05", "new": "06"}


def test_longest_prefix_ignores_case(spark):
    m = spark.createDataFrame([("x", "a/"), ("y", "a/b/")], "id string, prefix string")
    got = mo.longest_prefix(spark.createDataFrame([("A/B/c.py",), ("ab/c",), ("a/x",)], "rel string"), m).collect()
    assert {r.rel: r.module for r in got} == {"A/B/c.py": "y", "ab/c": None, "a/x": "x"}


def test_new_directories_by_size(spark):
    files = spark.createDataFrame([(f"big/{i}",) for i in range(15)] + [(f"few/{i}",) for i in range(14)] + [("api/a",), ("web/w",)], "rel string")
    m = spark.createDataFrame([("api", "api/"), ("web", "web/"), ("worker", "worker/")], "id string, prefix string")
    changed = spark.createDataFrame([("api/a",), ("api/b",), ("web/w",), ("big/1",), ("few/1",)], "rel string")
    assert {(r.kind, r.name) for r in mo.route_changes(changed, m, files).collect()} == {("changed", "api"), ("changed", "web"), ("new", "big"), ("small-new", "few")}


def test_merging_smallest_modules():
    assert mo.merge_to([("a", 5), ("b", 1), ("c", 2), ("d", 9)], 2) == [("a+b+c", 8), ("d", 9)]


def test_required_and_pages(spark):
    f = spark.createDataFrame([("a", True), ("b", True), ("c", True)], "id string, required boolean")
    p = spark.createDataFrame([("r", "a", "1"), ("r", "b", "")], "record string, id string, value string")
    assert {r.id for r in rc.missing_required(f, p).collect()} == {"b", "c"}
    rows = rc.page(spark.range(120), [F.col("id")], 50).collect()
    assert len(rows) == 50 and rows[0].total == 120 and rows[0].truncated
    with pytest.raises(ValueError):
        rc.conjunction()


def test_receipts(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    r = spark.createDataFrame([("a", "ok"), ("b", "boom")], "key string, status string")
    assert tuple(rc.rollup(rc.receipt_status(t, r), "state", ["ok", "failed", "missing"]).first()) == (1, 1, 1)


def test_repeated_lines(spark):
    a = lines_of(spark, ["a line of text", "short", "- a listed line"], "1").unionByName(lines_of(spark, ["a line of text", "a line of text", "- a listed line"], "2"))
    assert [tuple(r) for r in ln.repeated_lines(a, boilerplate=("-",)).collect()] == [("a line of text", 2)]


def test_top_ties_follow_first_occurrence(spark):
    e = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "z")], "seq long, cmd string")
    assert [r.cmd for r in events.top(events.digest(e, "cmd", "seq"), 2).collect()] == ["z", "x"]


def test_paths_and_links(spark):
    assert one(spark, "`a/b.py` `x` `/cmd` `http://x/y` `a\\b.c.` `../x/y` `f(x)/y`", tx.local_paths) == ["a/b.py", "a/b.c"]
    assert one(spark, "[a](x.md) ![b](<c d.png>) [e](#f)", tx.links) == ["x.md", "c d.png", "#f"]


def test_configuration_hash_and_merge():
    a = evidence.config_hash({"b": 1, "a": [1], "_note": "x"})
    assert a == evidence.config_hash({"a": [1], "b": 1}) != evidence.config_hash({"a": [1], "b": 2}) and len(a) == 16
    assert evidence.merged_config({"a": {"x": 1, "y": 2}, "l": [1]}, {"a": {"y": 3}, "l": [2]}) == {"a": {"x": 1, "y": 3}, "l": [2]}


def test_bins_are_bounded():
    sizes = [(f"d{i}", ".c", 9) for i in range(6)] + [("e", ".py", 99)]
    assert evidence.binned(sizes) == [(".c", ["d0", "d1", "d2"]), (".c", ["d3", "d4", "d5"]), (".py", ["e"])]

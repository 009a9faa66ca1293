import random
import re

from pyspark.sql import functions as F

from quarrymill.operators import lines as ln
from quarrymill.sources import sinks

LINES = "docno int, line int, text string"


def located(lines, entries, window):
    """The walk over entries, line by line."""
    out, at = [], 0
    flat = [re.sub(r"[\s|]", "", t) for t in lines]
    for num, title in entries:
        head, want = re.compile(r"[\s|\-*#>]*" + re.escape(num) + r"(?!\.?\d)"), re.sub(r"[\s|]", "", title)
        fits = [k for k, t in enumerate(lines) if head.match(t) and want in flat[k]]
        hit = next((k for k in fits if at <= k < at + window), fits[0] if fits else None)
        if hit is not None:
            at = max(at, hit)
            out.append((hit + 1, num, title))
    return out


def test_entries_are_located_as_by_a_walk(spark):
    rng = random.Random(4)
    rows, entries, want = [], [], []
    for doc in range(12):
        text = [f"{rng.choice(['', '## ', '| ', '　- '])}{rng.choice(['1', '1.1', '1.10', '2', '2.1.3', '11', ''])}{rng.choice(['', '.', ' ', ' .', '.4'])} {rng.choice(['Al pha', 'Be|ta', 'Gamma', ''])}" for _ in range(rng.randint(1, 60))]
        asked = [(rng.choice(["1", "1.1", "1.10", "2", "2.1.3", "9"]), rng.choice(["Alpha", "Beta", "G amma", ""])) for _ in range(rng.randint(0, 15))]
        rows += [(doc, k + 1, t) for k, t in enumerate(text)]
        entries += [(doc, k * 10, n, t) for k, (n, t) in enumerate(asked)]
        want += [(doc, *x) for x in located(text, asked, 7)]
    entries.append((3, 999, None, "no number"))
    got = ln.locate_entries(spark.createDataFrame(rows, LINES), spark.createDataFrame(entries, "docno int, pos int, num string, title string"), window=7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_entries_of_one_name_share_their_lines(spark, monkeypatch):
    """Each entry had a list of its own of all lines that fit its name, so the rows before the walk grew with their square."""
    monkeypatch.setattr(ln, "WALKED", 4)
    rng = random.Random(8)
    text = [f"{rng.choice(['1', '1.1'])} {rng.choice(['Alpha', 'Beta', ''])}" for _ in range(90)]
    asked = [(rng.choice(["1", "1.1", "2"]), rng.choice(["Alpha", "Beta"])) for _ in range(61)]
    lines = spark.createDataFrame([(0, k + 1, t) for k, t in enumerate(text)], LINES)
    for window in (1, 5, 1200):
        got = ln.locate_entries(lines, spark.createDataFrame([(0, k, *x) for k, x in enumerate(asked)], "docno int, pos int, num string, title string"), window)
        assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(located(text, asked, window))
    met = max(int(line.rsplit(": ", 1)[1]) for line in joined_rows(got))
    assert met < 4 * len(text)


def joined_rows(frame):
    """The numbers of rows that the joins of an executed plan made."""
    out, left = [], [frame._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.nodeName()
        left += [node.executedPlan()] if kind.startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in kind else []
        left += [node.children().apply(k) for k in range(node.children().size())]
        if "Join" in kind:
            out.append(f"{kind}: {node.metrics().apply('numOutputRows').value()}")
    return out


SENTENCE_END = re.compile(r"[。；：！？、，）】》”\"’…；:;,.)\]}>\-—*]$")


def joined(lines, longest=160):
    out, open_ = [], False
    for text in lines:
        t = text.strip(" ")
        prose = bool(t) and not re.match(r"[|#>\-*+·•]|\d+(\.\d+)*[.\s、]|(图|表|注|第|Figure|Table)\s*[.\d]", t) and len(t) <= 200
        if out and open_ and prose and not SENTENCE_END.search(out[-1]) and len(out[-1]) + len(t) <= longest:
            gap = " " if re.search("[A-Za-z0-9]$", out[-1]) and re.match("[A-Za-z0-9]", t) else ""
            out[-1] += gap + t
        else:
            out.append(text.rstrip(" ") if prose else text)
        open_ = prose
    return out


def test_prose_is_joined_across_blocks(spark):
    rng = random.Random(2)
    docs = {d: [rng.choice(["a line", "its end.", "# head", "", "漢字", "  more words here  ", "- item", "x" * 150, "1. one", "and"]) for _ in range(n)] for d, n in enumerate([1, 2, ln.FOLDED - 1, ln.FOLDED, ln.FOLDED + 1, 3 * ln.FOLDED + 5])}
    rows = [(d, k + 1, t) for d, lines in docs.items() for k, t in enumerate(lines)]
    got = {}
    for r in ln.join_prose(spark.createDataFrame(rows, LINES)).orderBy("docno", "line").collect():
        got.setdefault(r.docno, []).append(r.text)
    assert got == {d: joined(lines) for d, lines in docs.items()}


def test_outline_by_strategy(spark):
    text = ["Contents", "1 Alpha....1", "1.1 Beta....2", "3 Lost....9", "1 Alpha", "words", "1.1 Beta", "1.2 Gamma", "# Own", "2 Delta"]
    rows = [(d, k + 1, t) for d in range(6) for k, t in enumerate(text)] + [(6, 1, "# Only"), (6, 2, "words"), (7, 1, "One....1"), (7, 2, "1 Two....2")]
    kinds = ["toc", "numbered", "hybrid", "manual", "source", "auto", "auto", None]
    specs = spark.createDataFrame([(d, k, None, None, 5 if d < 6 else None) for d, k in enumerate(kinds)], "docno int, strategy string, toc_from int, toc_to int, body_start int")
    manual = spark.createDataFrame([(3, 2, 4, "Mine"), (0, 1, 1, "not asked")], "docno int, line int, level int, title string")
    got = {}
    for r in ln.outline(spark.createDataFrame(rows, LINES), specs, manual).orderBy("docno", "line").collect():
        got.setdefault(r.docno, []).append((r.line, r.num, r.title, r.level, r.origin))
    toc = [(1, "1", "Alpha", 2, "toc"), (3, "1.1", "Beta", 3, "toc")]
    numbered = [(1, "1", "Alpha", 2, "numbered"), (3, "1.1", "Beta", 3, "numbered"), (4, "1.2", "Gamma", 3, "numbered"), (6, "2", "Delta", 2, "numbered")]
    assert got[0] == toc and got[1] == numbered and got[5] == numbered
    assert got[2] == sorted(toc + numbered[2:])
    assert got[3] == [(2, None, "Mine", 4, "manual")] and got[4] == [(9, None, "Own", 1, "source")] and got[6] == [(1, None, "Only", 1, "source")]
    assert got[7] == [(2, "1", "Two", 2, "toc")]


def test_manual_headings_take_their_level(spark):
    lines = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], LINES)
    heads = spark.createDataFrame([(1, 2, None, "Mine", 4, 2)], "docno int, line int, num string, title string, level int, last int")
    assert [r.text for r in ln.inject_headings(lines, heads).orderBy("line").collect()][:3] == ["a", "", "#### Mine"]


def test_index_keeps_the_best_places(spark):
    rows = [("t", d, f"s{d}", (d * 7) % 31 + 1, d, 1) for d in range(40)] + [("u", 1, "a", 5, 3, 2), ("u", 1, "b", 2, 9, 1)]
    got = {r.term: r for r in sinks.inverted_index(spark.createDataFrame(rows, "term string, docno int, section string, hits long, first_line int, rank int").repartition(6)).collect()}
    want = sorted(range(40), key=lambda d: (-((d * 7) % 31 + 1), d))[:12]
    assert got["t"].places == [f"{d}:s{d}:{d}" for d in want] and got["t"].docs == 40
    assert got["u"].places == ["1:b:9"] and got["u"].docs == 1
    plan = sinks.inverted_index(spark.createDataFrame(rows, "term string, docno int, section string, hits long, first_line int, rank int"))._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_headings_deeper_than_six_are_faults(spark):
    rows = [(1, 1, "# A"), (1, 2, "####### seven"), (1, 3, "```"), (1, 4, "######## fenced"), (1, 5, "```"), (1, 6, "#######no")]
    assert [tuple(r) for r in ln.markdown_faults(spark.createDataFrame(rows, LINES)).collect()] == [(1, 2, "too_deep")]


def test_fences_by_a_walk(spark):
    rng = random.Random(9)
    rows, want = [], []
    for doc in range(20):
        open_ = ""
        for line in range(1, rng.randint(2, 60)):
            text = rng.choice(["```", "~~~", "```py", " ~~~ x", "words", "# h"])
            mark = (re.match(r"\s*(```|~~~)", text) or [None, ""])[1]
            was = open_
            open_ = mark if mark and not was else "" if mark and mark == was else was
            rows.append((doc, line, text))
            want.append((doc, line, bool(mark), bool(open_ or mark), mark if mark and not was else ""))
    got = ln.with_fence(spark.createDataFrame(rows, LINES), keep_open=True)
    assert sorted(tuple(r) for r in got.select("docno", "line", "is_fence", "fenced", "opened").collect()) == want

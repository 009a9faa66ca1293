from pyspark.sql import functions as F

from quarrymill.functions import text as tx
from quarrymill.operators import evidence as evd, modules as mo, planned as pl
from quarrymill.sources import scans


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_one_unknown_watcher_fails_alone(spark):
    users = spark.createDataFrame([(1, "Ann"), (2, "Bo"), (3, "Bo")], "id long, name string")
    wanted = spark.createDataFrame([("K1", "Ann", "add"), ("K1", "Bo", "add"), ("K1", "who", "add"), ("K1", "2", "add"), ("K1", "2", "add"), ("K2", "1", "add"), ("K2", "3", "remove")], "key string, who string, op string")
    plan = pl.planned_watchers(wanted, users, spark.createDataFrame([("K2", 1), ("K9", 3)], "key string, id long"))
    assert told(plan.select("key", "who", "action", "reason")) == [
        ("K1", "2", "add", None), ("K1", "Ann", "add", None), ("K1", "Bo", "fail", "user is ambiguous"), ("K1", "who", "fail", "user is missing"),
        ("K2", "1", "skip", "watches already"), ("K2", "3", "skip", "doesn't watch"),
    ]
    assert told(pl.plan_outcome(plan, "who", most=1)) == [("K1", 2, 0, 2, ["Bo: user is ambiguous"]), ("K2", 0, 2, 0, [])]


def test_attachments_need_exactly_one_file(spark):
    wanted = spark.createDataFrame([("K", "a"), ("K", "b"), ("K", "c"), ("K", "d")], "key string, filename string")
    files = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("d", 1)], "filename string, size int")
    there = spark.createDataFrame([("K", "d")], "key string, filename string")
    assert told(pl.planned_attachments(wanted, files, there)) == [("K", "a", "upload", None), ("K", "b", "fail", "2 files of that name"), ("K", "c", "fail", "no such file"), ("K", "d", "skip", "attached already")]
    assert told(pl.planned_attachments(wanted, files, there, replace=True).where("filename = 'd'")) == [("K", "d", "replace", None)]


def test_answers_that_lack_parts(spark):
    rows = spark.createDataFrame([(1, "{}"), (2, None), (3, "broken"), (4, '{"transitions":[{"id":"7"}],"watchCount":3}')], "k int, sent string")
    assert told(pl.transitions(rows)) == [(4, "7", None, None, None, False, [])]
    assert told(pl.watchers(rows).select("k", F.coalesce("watch_count", F.lit(-1)), "watchers")) == [(1, -1, []), (2, -1, []), (3, -1, []), (4, 3, [])]


def test_findings_are_bounded_by_kind(spark):
    a = spark.createDataFrame([(k, k) for k in range(30)], "subject int, detail int")
    got = evd.findings({"a": a, "b": a.where("subject < 3"), "none": a.where("subject > 99")}, {"a": 12})
    assert got.where("kind = 'a'").count() == 12 and {r.total for r in got.where("kind = 'a'").collect()} == {30} and got.where("kind = 'b'").count() == 3


def test_findings_check_once(spark):
    """Ranks and totals read every check's rows once; they were read once for each."""
    a = spark.range(3000).select((F.col("id") % 1400).alias("subject"), (F.col("id") % 7).cast("string").alias("detail"))
    b = spark.createDataFrame([(None, "x"), ("y", None), ("y", None), ("z", "w")], "subject string, detail string")
    got = evd.findings({"a": a, "b": b}, {"a": 300}, default=3)
    assert got._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    key = lambda r: ((r[0] is not None, r[0] or ""), (r[1] is not None, r[1] or ""))
    want = []
    for kind, rows, most in (("a", a, 300), ("b", b, 3)):
        found = sorted([(None if r.subject is None else str(r.subject), r.detail) for r in rows.collect()], key=key)
        want += [(kind, n + 1, *r, len(found)) for n, r in enumerate(found[:most])]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == want


def test_modules_by_churn_then_files(spark):
    modules = spark.createDataFrame([("a", "x/"), ("b", "x/y/"), ("c", "z/"), ("d", "none/")], "id string, prefix string")
    files = spark.createDataFrame([("x/1",), ("x/y/1",), ("X/Y/2",), ("z/1",)], "rel string")
    changes = spark.createDataFrame([("z/1", "2024-01-30"), ("z/1", "2024-01-29"), ("x/1", "2023-01-01"), ("gone/1", "2024-01-30")], "path string, day string").select("path", F.col("day").cast("timestamp").alias("ts"))
    got = mo.ranked_modules(files, changes, modules, F.lit("2024-01-31").cast("timestamp"), 90)
    assert told(got.select("rank", "id", "churn", "files")) == [(1, "c", 2, 1), (2, "b", 0, 2), (3, "a", 0, 1), (4, "d", 0, 0)]


def test_paths(spark):
    pairs = [("a/b/c", "a/b"), ("a", "a/b"), ("a/b", "a/b"), ("x", ""), ("", "q"), ("./a//b", "a\\c")]
    got = [r.p for r in spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").select("k", tx.relative_to("a", "b").alias("p")).orderBy("k").collect()]
    assert got == ["c", "..", ".", "x", "..", "../b"]
    assert spark.range(1).select(tx.casefolded(F.lit(".\\Straße/ΣΑΣ")).alias("p")).first().p.startswith("strasse/")


def test_a_directory_takes_what_is_below_and_counts_stop(spark, tmp_path):
    for n in ("d/a", "d/e/b", "f"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    files = scans.scan_files(spark, str(tmp_path), ["d/", "*"])
    assert {r.relpath: r.spec_index for r in files.collect()} == {"d/a": 0, "d/e/b": 0, "f": 1}
    assert scans.capped_count(files, 2) == (2, True) and scans.capped_count(files, 3) == (3, False)

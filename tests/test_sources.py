import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrymill.sources import scans, sinks
from quarrymill.streaming import incremental


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a.md": "# A", "x/b.md": "b", "x/y/c.txt": "c", "x/out/d.md": "own", "node_modules/e.js": "e", "f.min.js": "f", "g.js": "g"}.items():
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path / "in")


def test_first_glob_owns_a_file(spark, tree):
    got = scans.scan_files(spark, tree, ["x/**/*.md", "**/*.md", "**/*.txt"], excludes=["^node"], internal=["x/out"])
    assert {r.relpath: r.spec_index for r in got.collect()} == {"x/b.md": 0, "a.md": 1, "x/y/c.txt": 2}
    only = scans.scan_files(spark, tree, ["**/*"], extensions=[".TXT"])
    assert [r.relpath for r in only.collect()] == ["x/y/c.txt"]


def test_source_tree_is_pruned_and_capped(spark, tree):
    files = scans.scan_files(spark, tree, ["**/*"])
    assert [r.relpath for r in scans.source_tree(files, ["node_modules"], [".js"]).collect()] == ["g.js"]
    (row,) = scans.source_tree(files, [], [".js"], cap=1).collect()
    assert row.approx


def test_texts_are_decoded_with_replacement(spark):
    files = spark.createDataFrame([("a", bytearray("é".encode()))], "relpath string, content binary")
    assert scans.read_texts(files).first().text == "é"


def test_json_lines_skip_what_is_broken(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2, "b": "x"}\n')
    assert sorted(r.a for r in scans.json_lines(spark, str(tmp_path / "x.jsonl"), "a int, b string").collect()) == [1, 2]


def archive(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, data in names.items():
            z.writestr(n, data)
    return out.getvalue()


def test_archives_nest_and_refuse_climbing(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("deep.log")
        info.size = 4
        t.addfile(info, io.BytesIO(b"deep"))
    data = archive({"ok.txt": b"ok", "../evil": b"no", "/abs": b"no", "inner.tgz": tar.getvalue()})
    files = spark.createDataFrame([("a.zip", bytearray(data)), ("plain.log", bytearray(b"p")), ("bad.7z", bytearray(b"zz"))], "relpath string, content binary")
    got = {r.relpath: bytes(r.content) for r in scans.expand_archives(files).collect()}
    assert got == {"plain.log": b"p", "a.zip!/ok.txt": b"ok", "a.zip!/inner.tgz!/deep.log": b"deep"}


def test_exact_name_must_be_unique(spark):
    files = spark.createDataFrame([("a",), ("b",), ("b",)], "filename string")
    assert scans.unique_by_name(files, "a").count() == 1
    with pytest.raises(Exception):
        scans.unique_by_name(files, "b").collect()


def test_sinks_are_guarded(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b")], "n int, t string")
    out = sinks.write_new(df, str(tmp_path / "out"), [str(tmp_path / "in")], run_date="2026-01-01")
    assert spark.read.parquet(out).count() == 1
    with pytest.raises(Exception):
        sinks.write_new(df, str(tmp_path / "out"), run_date="2026-01-01")
    with pytest.raises(PermissionError):
        sinks.write_new(df, str(tmp_path / "in/x"), [str(tmp_path / "in")])
    assert [r.value for r in sinks.markdown_table(df, [F.col("n")], ["n", "t"]).collect()] == ["| n | t |", "| --- | --- |", "| 1 | a/b |"]
    assert sinks.html_rows(df, ["t"]).first().value == "<tr><td>a|b</td></tr>"
    assert df.select(sinks.filled("n={n} {x}", {"n": F.col("n").cast("string")}).alias("v")).first().v == "n=1 {x}"


def test_stream_of_changes(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("a", "1"), ("b", "1")], "relpath string, hash string").coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema("relpath string, hash string").parquet(src)
    run = lambda: incremental.apply_changes(read(), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([("a", "2")], "relpath string, hash string").coalesce(1).write.mode("append").parquet(src)
    run()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert {r.relpath: r.hash for r in incremental.latest(log).collect()} == {"a": "2", "b": "1"}


def test_digest_stream_equals_the_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = incremental.digest_stream(stream, "event_type", "ts", "1 day", "100 days").writeStream.format("memory").queryName("digest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(str(r.d), r.event_type): r["count"] for r in e.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").count().collect()}
    got = {(str(r.start), r.event_type): r.n for r in spark.table("digest").collect()}
    assert got == want

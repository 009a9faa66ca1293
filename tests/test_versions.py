import os
import subprocess
import sys
import threading
from pathlib import Path

import pytest

from quarrymill.sources import versions as v

ROOT = str(Path(__file__).resolve().parents[1])


@pytest.fixture
def store(spark, tmp_path):
    return v.Versions(spark, f"file://{tmp_path}/t")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_versions_are_read_whole(spark, store):
    assert store.head() is None and store.read() is None
    assert store.commit(spark.range(3), None) == 1 and store.commit(spark.range(5), 1) == 2
    assert ids(store.read()) == [0, 1, 2, 3, 4] and ids(store.read(1)) == [0, 1, 2] and store.about(2)["from"] == 1


def test_one_of_two_writers_wins(spark, store):
    store.commit(spark.range(1), None)
    store.commit(spark.range(2), 1)
    with pytest.raises(v.Conflict):
        store.commit(spark.range(9), 1)
    assert ids(store.read()) == [0, 1] and store.unpublished() == []


def test_writers_at_once_lose_no_row_and_double_none(spark, store):
    store.commit(spark.range(0), None)
    failed = []

    def add(k):
        try:
            store.update(lambda there: there.unionByName(spark.range(k, k + 1)), f"writer {k}", tries=20)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and ids(store.read()) == [0, 1, 2, 3, 4, 5] and store.head() == 7 and store.unpublished() == []


def test_a_batch_told_again_changes_nothing(spark, store):
    store.commit(spark.range(2), None, "a")
    add = lambda there: there.unionByName(spark.range(7, 8))
    assert store.update(add, "b") == 2 and store.update(add, "b") == 2 and store.commit(spark.range(50), 2, "a") == 2
    assert ids(store.read()) == [0, 1, 7]


def test_a_writer_killed_between_its_steps(spark, store):
    """A process of its own writes the data and dies before it publishes: readers see the version before, and the next writer goes on."""
    store.commit(spark.range(2), None)
    code = (
        "import os; from pyspark.sql import SparkSession; from quarrymill.sources.versions import Versions\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"store = Versions(spark, {store.root!r}); store._claim = lambda *a: os._exit(9)\n"
        "store.commit(spark.range(5), 1)"
    )
    assert subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": ROOT}, capture_output=True, timeout=120).returncode == 9
    assert ids(store.read()) == [0, 1] and store.head() == 1
    (left,) = store.unpublished()
    assert store.commit(spark.range(3), 1) == 2
    store.discard([left])
    assert store.unpublished() == [] and ids(store.read()) == [0, 1, 2]


def test_a_claim_elsewhere_is_a_rename_without_overwriting(spark, tmp_path):
    """The same by Hadoop's file context, as on stores that aren't a local disk."""
    store = v.Versions(spark, f"file://{tmp_path}/t")

    class Elsewhere:
        def __getattr__(self, name):
            return (lambda: "hdfs") if name == "getScheme" else getattr(fs, name)

    fs, store._fs = store._fs, Elsewhere()
    assert store._claim("000000000001", "{}") and not store._claim("000000000001", "other")
    assert store._text("000000000001") == "{}" and store._listed("drafts") == []


def test_contents_are_added_once(spark, store):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, "")], "k int, body string")
    v.add_contents(store, rows, "k", "body")
    found = v.add_contents(store, spark.createDataFrame([(1, "a"), (1, "b")], "k int, body string"), "k", "body")
    assert sorted((r.k, r.body or "") for r in found.collect()) == [(1, "a"), (1, "b"), (2, "")]

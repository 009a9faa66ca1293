import datetime
import json
import os
import re

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from quarrymill.operators import records as rc
from quarrymill.sources import tracker as tr

SCHEMA = "key long, status string, assignee string, due date, cost decimal(8,2), score double, seen timestamp_ntz"


@pytest.fixture(scope="module")
def export(spark, tmp_path_factory):
    day = datetime.date(2024, 1, 1)
    rows = [(k, "open" if k % 3 else "done", None if k < 40 else f"u{k % 5}", day + datetime.timedelta(days=k), None, k / 7 if k % 2 else None, datetime.datetime(2024, 1, 1, 0, k % 60)) for k in range(100)]
    df = spark.createDataFrame(rows, SCHEMA.replace("decimal(8,2)", "string")).withColumn("cost", (F.col("key") / 4).cast("decimal(8,2)"))
    path = f"file://{tmp_path_factory.mktemp('tracker')}/x"
    tr.export_pages(df.repartition(4), path, "key", page=10)
    return df, path


def reader(spark, path, *tests):
    df = spark.createDataFrame([], SCHEMA)
    r = tr.TrackerReader(df.schema, path, "key", 2)
    assert list(r.pushFilters(list(tests))) == []
    return r


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_a_trackers_own(spark, export):
    (body,) = [r.value for r in spark.read.text(f"{export[1]}/pages").where("page = 3").collect()]
    page = json.loads(body)
    assert (page["start_at"], page["total"], len(page["issues"])) == (30, 100, 10) and page["issues"][0]["key"] == "30" and page["issues"][0]["fields"]["status"] == "done"


def test_all_comes_back(spark, export):
    df, path = export
    got = tr.search(spark, path, df.schema, "key")
    assert got.exceptAll(df).isEmpty() and df.exceptAll(got).isEmpty()


def test_pages_opened(spark, export):
    """The pages of a search's tasks, out of ten."""
    opened = lambda *t: [len(p.files) for p in reader(spark, export[1], *t).partitions()]
    assert opened() == [2] * 5
    assert opened(ds.GreaterThanOrEqual(("key",), 35), ds.LessThan(("key",), 50)) == [2]
    assert opened(ds.EqualTo(("due",), datetime.date(2024, 1, 1))) == [1]
    assert opened(ds.IsNull(("assignee",))) == [2, 2] and sum(opened(ds.IsNotNull(("assignee",)))) == 6
    assert sum(opened(ds.In(("key",), (5, 95, None)))) == 2 and opened(ds.EqualTo(("key",), 500)) == [0]
    assert sum(opened(ds.StringStartsWith(("status",), "zz"))) == 0 and sum(opened(ds.StringContains(("status",), "pen"))) == 10


@pytest.mark.parametrize(
    "condition",
    ["status = 'done' and due >= date'2024-02-01'", "assignee is null and key > 20", "key in (3, 4, 77)", "score < 5.0", "cost <= 7.25 and status like 'op%'", "assignee like '%3%'", "seen > timestamp_ntz'2024-01-01 00:30:00'", "key = 1 or key = 99", "lower(status) = 'open' and not (key < 90)", "key > 1000"],
)
def test_equals_a_filter(spark, export, condition):
    df, path = export
    got = tr.search(spark, path, df.schema, "key", F.expr(condition))
    assert sorted(r.key for r in got.collect()) == sorted(r.key for r in df.where(condition).collect())


def test_conditions_leave_the_plan(spark, export):
    """Sorts of conditions that the reader takes are not evaluated by Spark again; others are."""
    df, path = export
    taken = tr.search(spark, path, df.schema, "key", rc.conjunction({"status": "done"}, since={"due": datetime.date(2024, 2, 1)}))
    assert "BatchScan tracker" in plan(taken) and "Filter" not in re.sub("RuntimeFilters", "", plan(taken))
    assert "Filter" in re.sub("RuntimeFilters", "", plan(tr.search(spark, path, df.schema, "key", rc.conjunction(contains={"status": "DONE"}))))


def test_pages_that_are_not_needed_are_not_read(spark, export, tmp_path):
    df, _ = export
    path = f"{tmp_path}/x"
    tr.export_pages(df, f"file://{path}", "key", page=10)
    for n in (0, 9):
        (file,) = [f for f in os.listdir(f"{path}/pages/page={n}") if f.startswith("part")]
        open(f"{path}/pages/page={n}/{file}", "w").write("broken")
    search = lambda c: tr.search(spark, f"file://{path}", df.schema, "key", F.expr(c)).count()
    assert search("key between 10 and 89") == 80
    with pytest.raises(Exception):
        search("key >= 89")


def test_one_search_under_two_conditions(spark, export):
    df, path = export
    found = tr.search(spark, path, df.schema, "key", F.col("status") == "open")
    a, b = found.where("key < 30"), found.where("key >= 70")
    assert a.unionByName(b).count() == 40 and a.count() == b.count() == 20 and found.count() == 66

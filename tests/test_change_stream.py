import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarrymill.operators import cdc
from quarrymill.streaming import renames as rn

STATE = [("a", "1", False), ("b", "2", False), ("c", "3", False), ("d", "4", True), ("e", "5", True), ("f", "6", False), ("g", "6", False), ("r", "8", True), ("s", "8", True), ("v", "V", True)]
#: r and v are retired paths that are there again, v as it was, s one whose content returns under two paths; i is a copy of what stays.
NOW = [("a", "1"), ("b", "2x"), ("c2", "3"), ("d2", "4"), ("e", "9"), ("n", "5"), ("h", "6"), ("z", "77"), ("r", "80"), ("t", "8"), ("u", "8"), ("i", "1"), ("v", "V")]
COLUMNS = ["kind", "relpath", "from_path", "hash", "old_hash"]


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_batch(spark, tmp_path, seed):
    """Observations in any order and told again, over micro-batches, then replayed after all was told."""
    spark.conf.set(*rn.STORE_CONF)
    state = spark.createDataFrame(STATE, "relpath string, hash string, retired boolean")
    gone = [p for p, _, retired in STATE if not retired and p not in dict(NOW)]
    told = [(p, h, 100 + k) for k, (p, h) in enumerate(NOW)] + [(p, None, 130 + k) for k, p in enumerate(gone)]
    rng = random.Random(seed)
    told += rng.sample(told, 8)
    rng.shuffle(told)
    size = 6
    parts = [told[k : k + size] for k in range(0, len(told), size)]
    for k, part in enumerate([*parts, [(None, None, 9_000)], told]):  # the replay is older than the watermark and ignored
        df = spark.createDataFrame(part, "relpath string, hash string, s long").select("relpath", "hash", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    stream = spark.readStream.schema("relpath string, hash string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = rn.change_stream(stream, state, "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
    out.trigger(availableNow=True).start().awaitTermination()
    want = rows(cdc.change_set(spark.createDataFrame(NOW, "relpath string, hash string"), state))
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == want
    assert {r[0] for r in want} == {"unchanged", "modified", "renamed", "added", "removed"}


def test_a_content_costs_few_messages():
    """Each call on the state is a message to the JVM: one a path and few a content, and no frame is made for it."""
    calls = []

    class Told:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, method):
            return lambda *a: calls.append((self.name, method)) or (iter([(("a",), ("fresh", None)), (("b",), ("gone", None))]) if method == "iterator" else None)

    p = rn.PairedRenames(1000)
    p.paths, p.closes, p.handle = Told("paths"), Told("closes"), Told("handle")
    said = Row("relpath", "role", "was", "at")
    rows = [said("a", "fresh", None, 5), said("b", "gone", "h", 9), said("a", "fresh", None, 7)]
    assert list(p.handleInputRows(("h",), iter(rows), None)) == []
    assert calls == [("paths", "updateValue")] * 2 + [("closes", "get"), ("handle", "registerTimer"), ("closes", "update")]
    calls.clear()
    assert [tuple(r) for r in p.handleExpiredTimer(("h",), None, None)] == [("renamed", "a", "b", "h", "h")]
    assert calls == [("paths", "iterator"), ("paths", "clear"), ("closes", "clear")]

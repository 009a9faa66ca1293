import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarrymill.llm import common, substring_dedup as sd

from .util import ODD, docs, shuffle_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, ws in texts:
        for at in range(len(ws) - size + 1):
            k = tuple(ws[at : at + size])
            if i is not None:
                least[k] = min(least.get(k, i), i)
    out = []
    for i, ws in texts:
        gone = set()
        for at in range(len(ws) - size + 1):
            if i is not None and least[tuple(ws[at : at + size])] < i:
                gone |= set(range(at, at + size))
        kept = [w for n, w in enumerate(ws) if n not in gone]
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


def rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefg") * rng.randint(1, 2)
    out = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)]
    passage = " ".join(word() for _ in range(30))
    out += [(100 + i, f"{word()} {passage}\n{word()}") for i in range(40)]
    out += [(200, "z " * 500), (201, "z " * 300), (202, "q " * 300), (300, passage), (300, passage + " tail"), (None, passage), (301, "\tx\x1cy  " * 20)]
    return out + ODD


@pytest.mark.parametrize("size", [3, 13])
@pytest.mark.parametrize("sketch", [{}, {"max_sketch_bytes": 1 << 17, "cells_per_window": 1}])
def test_equals_brute_force(spark, size, sketch):
    data = rows(size)
    got = sd.kept_digests(docs(spark, data, extra=True).repartition(5), size, **sketch).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(data, size)


def test_small_flushes_settle_the_same(spark, monkeypatch):
    data = rows(1)
    monkeypatch.setattr(sd, "FLUSH", 50)
    got = sd.kept_digests(docs(spark, data).coalesce(1), 3).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(data, 3)


def test_cut_text_keeps_columns_and_blanks(spark):
    p = " ".join(f"w{i}" for i in range(20))
    data = [(1, p), (2, f"  new\n{p} end\n"), (3, p), (4, ""), (5, None), (6, "short")]
    got = {r.doc_id: r for r in sd.cut_repeats(docs(spark, data, extra=True)).collect()}
    assert set(got) == {1, 2, 4, 5, 6}
    assert got[2].text == "  new\nend\n" and got[2].n_chars == 10 and got[1].text == p and got[5].text is None
    assert sd.cut_repeats(docs(spark, [])).count() == 0
    assert sd.cut_repeats(docs(spark, data)).columns == docs(spark, data).columns


def test_a_sketch_larger_than_a_map_is_held_in_turns(spark):
    """A full map called nearly all windows repeated; in turns the same starts are found from few rows."""
    rng = random.Random(3)
    texts = [" ".join(f"{rng.randrange(1 << 30):x}" for _ in range(2000)) for _ in range(60)]
    rows = [(k, t + " " + texts[0][:400]) for k, t in enumerate(texts)]
    df = docs(spark, rows)
    total, small = sum(len(t) for _, t in rows), 1 << 14
    bits, turns = sd.sketch_turns(total, 8, 1 << 17)
    assert turns == 1 and bits == 20 and sd.sketch_turns(64 * total, 8, 1 << 17)[1] > 1 and sd.sketch_turns(10**10, 8, small << 13)[0] == 33
    key = df.select(F.col("doc_id").cast("long"), "text").withColumn("text_key", sd._text_key("text"))
    merged = sd.merge_sketches(sd.partition_sketches(key, 13, 22))
    whole = sd._turn_rows(key, merged, 13, 22, 1, 0).select("h", "g", "doc_id").collect()
    parts = [r for t in range(4) for r in sd._turn_rows(key, merged, 13, 22, 4, t).select("h", "g", "doc_id").collect()]
    assert sorted(r for r in map(tuple, parts) if r[1]) == sorted(r for r in map(tuple, whole) if r[1]) and len(parts) > 60


def test_a_turn_leaves_its_starts_alone(spark, monkeypatch):
    """Every turn's rows, maps and the sketch's shuffle files stayed on disk together until the texts were cut."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.randrange(1 << 30):x}" for _ in range(2500)) for _ in range(110)]
    rows = [(k, t + " " + texts[k // 2][:300]) for k, t in enumerate(texts)]
    assert sd.sketch_turns(sum(len(t) for _, t in rows), 8, 1 << 17)[1] > 1
    made, left = [], []

    def materialise(df, name):
        made.append(df)
        out = common.materialise(df, name)
        for _ in range(50):  # they go beside the next work
            if (now := shuffle_bytes(spark)) < before + 100_000:
                break
            time.sleep(0.1)
        left.append(now)
        return out

    spark.sparkContext._jvm.System.gc()
    before = shuffle_bytes(spark)
    monkeypatch.setattr(sd, "materialise", materialise)
    found = sd.repeated_starts(docs(spark, rows), 13, max_sketch_bytes=1 << 17)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()  # read from what the turns left
    assert len(made) == 3 and max(left) < before + 100_000
    monkeypatch.undo()
    got = sd.kept_digests(docs(spark, rows), max_sketch_bytes=1 << 17).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, 13)

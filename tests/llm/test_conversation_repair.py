import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.llm import conversation_repair as cr

ROWS = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def by_rounds(codes):
    """(cost, audit) by rounds over rows, the least of each grammar state kept: no queue, no trie."""
    least = {"": (0, ""), "s": None, "u": None, "a": None}

    def better(state, found):
        if least[state] is None or found < least[state]:
            least[state] = found

    def inserts():
        for state in ("", "s", "a"):
            if least[state]:
                better("u", (least[state][0] + 2, least[state][1] + "I"))
        if least["u"]:
            better("a", (least["u"][0] + 2, least["u"][1] + "I"))

    inserts()
    for initial, fault in zip(codes[::2], codes[1::2]):
        was, least = least, dict.fromkeys(least)
        for state, x in was.items():
            if x is None:
                continue
            better(state, (x[0] + 3, x[1] + "D"))
            if fault != "d":
                then = "a" if state == "u" else "u"
                better(then, (x[0] + 2 + (fault == "t"), x[1] + "R"))
                if initial == then or (initial == "s" and state == ""):
                    better(initial, (x[0] + (fault == "t"), x[1] + "K"))
        inserts()
    return min(x for x in (least[""], least["a"]) if x)


@given(st.lists(st.tuples(st.sampled_from("sua-"), st.sampled_from("kkktd")), max_size=14))
@settings(max_examples=400, deadline=None)
def test_cheapest_edits(rows):
    codes = "".join(a + b for a, b in rows)
    assert cr.cheapest_edits(codes) == by_rounds(codes)


def test_long_conversation():
    rng = random.Random(5)
    codes = "".join(rng.choice("uuaas-") + rng.choice("kkkkktd") for _ in range(3000))
    assert cr.cheapest_edits(codes) == by_rounds(codes)


@given(st.lists(st.text("DIKR", max_size=40), min_size=2, max_size=6))
@settings(max_examples=200, deadline=None)
def test_audits_are_ordered_as_texts(texts):
    root = cr.Audit()
    for text in texts:
        at = root
        for letter in text:
            at = at.then(letter)
        assert at.letters() == text
    nodes = []
    for text in texts:
        at = root
        for letter in text:
            at = at.then(letter)
        nodes.append(at)
    for a, x in zip(nodes, texts):
        for b, y in zip(nodes, texts):
            assert (a is b) == (x == y) and (a is b or (a < b) == (x < y))


def brute(rows):
    out = {}
    for c, t, r, x in rows:
        kept = out.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            kept.extend([(t is not None, t or 0, "user" if kind == 4 else r, x)] * (1 + (kind == 3)))
    found = {}
    for c, kept in out.items():
        kept.sort()
        seen, codes, n, told = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, []
        for i, (_, _, r, x) in enumerate(kept):
            fault = "blank" if not x.strip(BLANKS) else "duplicate" if (r, x) in seen else "truncated" if x.rstrip(BLANKS)[-1] not in ".!?" else None
            seen.add((r, x))
            n[fault] = n.get(fault, 0) + 1
            n["illegal"] += i > 0 and kept[i - 1][2][:1] + r[:1] not in ("su", "ua", "au")
            codes += (r[:1] if r[:1] and r[:1] in "sua" else "-") + {"blank": "d", "duplicate": "d", "truncated": "t", None: "k"}[fault]
        cost, audit = by_rounds(codes)
        i, turn = 0, "u"
        for edit in audit:
            role, text = ("user" if turn == "u" else "assistant"), ""
            if edit != "I":
                text, i = kept[i][3], i + 1
                role = kept[i - 1][2] if edit == "K" else role
            if edit != "D":
                told.append(f"{role}:{text}")
                turn = "u" if role[:1] == "s" else "a" if turn == "u" else "u"
        turns = [t for known, t, _, _ in kept if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest())
    return found


def some_rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(120), None]:
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "au\npair"])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", " \t\n", "", None, "e.g. a b.  \r\n", "漢字。", " ", "Yes.\n", f"turn {t}."])
            rows.append((c, rng.choice([t, t, t * 3, None]), role, text))
    return [*rows, *rows[:40], (500, 1, "user", "word " * 50_000), (500, 2, "assistant", "x" * 100_000 + ".")]


def test_against_brute_force(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    for name in ("pos", "gone", "rows", "edits", "first_fault", "kind", "source", "audit"):
        df = df.withColumn(name, F.lit(1))
    got = cr.repaired_digests(df).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == brute(rows) and len(got) == len({r[0] for r in rows})


def test_repaired_turns_fit_the_grammar(spark):
    df = spark.createDataFrame(some_rows(), ROWS)
    for r in cr.repair(cr.damage(df)).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in r.turns))


def test_empty(spark):
    assert cr.repaired_digests(spark.createDataFrame([], ROWS)).collect() == []


def test_all_rows_dropped(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = cr.repaired_digests(spark.createDataFrame([(gone, 0, "user", "Yes.")], ROWS)).first()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())

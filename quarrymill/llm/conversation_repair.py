"""Conversation structure repair: the cheapest edits that make a damaged conversation fit the turn grammar.

The grammar of role initials is `(s?(ua)+)?`. Edits: Keep a row (cost 0), Rerole it to user or assistant (2), Delete it (3),
Insert an empty user or assistant turn (2). Blank and duplicate rows must be deleted; a truncated row that stays costs 1
more. Dijkstra walks the implicit lattice of (rows consumed, grammar state) with the priority (cost, audit), audit being
the edits' initials so far, and stops at the first accepting end node it takes; so of equally cheap repairs the one
with the ASCII-least audit is found.

Spark orders the rows, finds their faults and builds the repaired turns; the search sees two letters a row, so a
conversation's texts never leave the JVM. A conversation is one group, since its repair is sequential and its result
one value; audits are kept as paths of a trie, so a long one costs memory by its edits alone, not by their square.

Odd rows: null roles and texts are one space, null turns come first, ties go by role and text; repeated rows are rows;
a null conv_id is a conversation; a conversation without rows gives zeros, an empty audit and no turn. Further columns
are not read.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
TRUNCATED_COST = 1
#: Grammar states: nothing yet, after a system turn, after a user turn, after an assistant turn; and what each turn leads to.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ACCEPTING = (BEGIN, ASSISTANT)
#: The turn that an inserted or reroled row makes in each state.
WANTED = {BEGIN: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}

EDITS = "struct<cost: bigint, audit: string, turns: array<struct<source: int, role: string>>>"
_TURN = pa.struct([("source", pa.int32()), ("role", pa.string())])
_EDITS = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("turns", pa.list_(_TURN))])


class Audit:
    """Edits' initials as a path of a trie: equal audits are one object, others are ordered by the letters after their fork.

    `far` is an ancestor so chosen that any depth is reached in steps of the order of its logarithm.
    """

    __slots__ = ("before", "depth", "far", "letter", "longer")

    def __init__(self, before: Audit | None = None, letter: str = "") -> None:
        self.before, self.letter, self.longer = before, letter, None
        if before is None:
            self.depth, self.far = 0, self
        else:
            self.depth, b = before.depth + 1, before.far
            self.far = b.far if before.depth - b.depth == b.depth - b.far.depth else before

    def then(self, letter: str) -> Audit:
        if self.longer is None:
            self.longer = {}
        found = self.longer.get(letter)
        if found is None:
            found = self.longer[letter] = Audit(self, letter)
        return found

    def up_to(self, depth: int) -> Audit:
        at = self
        while at.depth > depth:
            at = at.far if at.far.depth >= depth else at.before
        return at

    def __lt__(self, other: Audit) -> bool:
        a, b = self.up_to(other.depth), other.up_to(self.depth)
        if a is b:  # one begins with the other
            return self.depth < other.depth
        while a.before is not b.before:
            a, b = (a.far, b.far) if a.far is not b.far else (a.before, b.before)
        return a.letter < b.letter

    def letters(self) -> str:
        found, at = [], self
        while at.before is not None:
            found.append(at.letter)
            at = at.before
        return "".join(reversed(found))


def cheapest_edits(codes: str) -> tuple[int, str]:
    """(cost, audit) for rows given as two letters each: initial s, u, a or another; then d (must go), t (truncated) or k."""
    n, order = len(codes) // 2, 0
    heap, done = [(0, Audit(), order, 0, BEGIN)], set()
    while True:
        cost, audit, _, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ACCEPTING:
            return cost, audit.letters()
        steps = [(INSERT, 0, i, NEXT[state, WANTED[state]])]
        if i < n:
            initial, fault = codes[2 * i], codes[2 * i + 1]
            steps.append((DELETE, 0, i + 1, state))
            if fault != "d":
                more = TRUNCATED_COST if fault == "t" else 0
                steps.append((REROLE, more, i + 1, NEXT[state, WANTED[state]]))
                if (state, initial) in NEXT:
                    steps.append((KEEP, more, i + 1, NEXT[state, initial]))
        for edit, more, j, then in steps:
            if (j, then) not in done:
                order += 1
                heapq.heappush(heap, (cost + COST[edit] + more, audit.then(edit), order, j, then))


def edited_turns(codes: str, audit: str) -> list[dict]:
    """The turns that edits leave: the source row (from 0, null: inserted) and its new role (null: kept)."""
    made, i, state = [], 0, BEGIN
    for edit in audit:
        if edit != DELETE:
            turn = codes[2 * i] if edit == KEEP else WANTED[state]
            made.append({"source": None if edit == INSERT else i, "role": None if edit == KEEP else ROLES[turn]})
            state = NEXT[state, turn]
        i += edit != INSERT
    return made


def _edits(codes: pa.Array) -> pa.Array:
    found = []
    for c in codes.to_pylist():
        cost, audit = cheapest_edits(c)
        found.append({"cost": cost, "audit": audit, "turns": edited_turns(c, audit)})
    return pa.array(found, _EDITS)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged by crc32 of `conv_id:turn`; dropped ones stay, marked, for their conv_id."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(space("role"))
    copies = F.array_repeat(kind == 0, F.when(kind == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("gone"))


def with_faults(rows: DataFrame) -> DataFrame:
    """rows of `damage` with pos (order in the conversation, gone rows last), first_fault, new_turn and illegal.

    first_fault: blank, duplicate, truncated or null. illegal: the pair with the row before breaks the grammar.
    """
    order = [F.col("gone"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    told = Window.partitionBy("conv_id").orderBy(*order)
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("pos")  # not by turn: of rows alike the first is the original
    initial = F.left("role", F.lit(1))
    pair = F.concat(F.lag(initial).over(told), initial)
    # trailing blanks are cut by characters, so a long text is read once
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(solid == "", "blank").when(F.row_number().over(seen) > 1, "duplicate").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "truncated")
    turn_before = F.lag("turn").over(told)
    return rows.repartition("conv_id").withColumn("pos", F.row_number().over(told)).select(
        "*", F.when(~F.col("gone"), fault).alias("first_fault"),
        (~F.col("gone") & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(turn_before)).alias("new_turn"),
        (~F.col("gone") & pair.isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns (role, text after repair) of rows of `damage`."""
    fault = F.when(F.col("first_fault").isin("blank", "duplicate"), "d").when(F.col("first_fault") == "truncated", "t").otherwise("k")
    initial = F.left("role", F.lit(1))
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), fault)
    here = ~F.col("gone")
    turn = F.when(here, F.col("turn"))
    of = lambda kind: F.count_if(F.col("first_fault") == kind).alias(kind)
    told = with_faults(rows).groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_if("new_turn"), F.lit(0)).cast("long").alias("gaps"), of("blank"), of("duplicate"), of("truncated"),
        F.count_if("illegal").alias("illegal"),
        F.sort_array(F.collect_list(F.when(here, F.struct("pos", code.alias("code"), "role", "text")))).alias("rows"),
    )
    search = F.arrow_udf(_edits, EDITS)
    found = told.withColumn("edits", search(F.array_join(F.transform("rows", lambda r: r["code"]), "")))

    def turn_of(t: Column) -> Column:
        row = F.get("rows", t["source"])
        return F.struct(F.coalesce(t["role"], row["role"]).alias("role"), F.coalesce(row["text"], F.lit("")).alias("text"))

    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "edits.cost", "edits.audit", F.transform("edits.turns", turn_of).alias("turns"))


def repaired_digests(rows: DataFrame) -> DataFrame:
    """`repair` of the damaged rows, with the digest of its turns for the turns."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")
    return repair(damage(rows)).withColumn("repaired_sha256", F.sha2(lines, 256)).drop("turns")

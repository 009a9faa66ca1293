"""Change sets as a stream: observations of paths against a state, renames paired by content within a delay.

The batch operator `cdc.change_set` defines the result. Here observations arrive one by one, repeated or out of order; a
path that vanished and a new one with its content meet in the state of their content hash, and a timer closes that hash
once nothing came for the delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that transformWithState needs.
STORE_CONF = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STAYS = ("unchanged", "modified")
CHANGE = "kind string, relpath string, from_path string, hash string, old_hash string"
CHANGED = Row("kind", "relpath", "from_path", "hash", "old_hash")


class PairedRenames(StatefulProcessor):
    """One content hash: paths that stay with it, that are new with it, and that had it and are gone, active or retired."""

    def __init__(self, delay_ms: int) -> None:
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "relpath string", "role string, was string")
        self.closes = handle.getValueState("closes", "at long")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: Any) -> None:  # noqa: N802, N803
        self.paths.updateValue((initialState.relpath,), ("retired", None))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        told, latest = {}, None
        for row in rows:
            path = row.relpath
            if row.role == "back":  # a retired path is there again, so nothing can be a rename of it
                held = None if path in told else self.paths.getValue((path,))
                if held is not None and held[0] == "retired":
                    self.paths.removeKey((path,))
            else:
                told[path] = (row.role, row.was)
                latest = row.at if latest is None else max(latest, row.at)
        for path, role in told.items():  # every call is a message to the JVM, so each path is written once
            self.paths.updateValue((path,), role)
        if latest is not None:
            closes = latest + self.delay_ms
            before = self.closes.get()
            if before is None or closes > before[0]:
                if before is not None:
                    self.handle.deleteTimer(before[0])
                self.handle.registerTimer(closes)
                self.closes.update((closes,))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = {path[0]: (role[0], role[1]) for path, role in self.paths.iterator()}
        roles = sorted((role, path) for path, (role, _) in held.items())
        fresh = [p for r, p in roles if r == "fresh"]
        lost = [(r, p) for r, p in roles if r in ("gone", "retired")]  # active before retired, then by path
        out = [CHANGED(role, path, None, key[0], was) for path, (role, was) in held.items() if role in STAYS]
        for path, (_, source) in zip(fresh, lost):
            out.append(CHANGED("renamed", path, source, key[0], key[0]))
        out += [CHANGED("added", path, None, key[0], None) for path in fresh[len(lost) :]]
        out += [CHANGED("removed", path, None, None, key[0]) for role, path in lost[len(fresh) :] if role == "gone"]
        taken = {path for _, path in lost[: len(fresh)]}
        ended = [path for role, path in roles if role != "retired" or path in taken]  # what is still retired may be the source of a later rename
        if len(ended) == len(roles):
            self.paths.clear()
        else:
            for path in ended:
                self.paths.removeKey((path,))
        self.closes.clear()
        return iter(out)

    def close(self) -> None:
        pass


def _transitions() -> Column:
    """What an observation says, as (role, hash): that a path stays, is new, is gone, or that a retired path is there again."""
    live, known = F.col("s.retired") == F.lit(False), F.col("s.relpath").isNotNull()
    stays = F.when(F.col("o.hash").isNotNull() & live, F.when(F.col("o.hash") == F.col("s.hash"), "unchanged").otherwise("modified"))
    event = lambda role, h: F.struct(F.lit(role).alias("role"), h.alias("hash"))
    return F.array_compact(
        F.array(
            F.when(stays.isNotNull(), F.struct(stays.alias("role"), F.col("o.hash").alias("hash"))),
            F.when(F.col("o.hash").isNotNull() & ~F.coalesce(live, F.lit(False)), event("fresh", F.col("o.hash"))),
            F.when(F.col("o.hash").isNotNull() & known & ~live, event("back", F.col("s.hash"))),
            F.when(F.col("o.hash").isNull() & live, event("gone", F.col("s.hash"))),
        )
    )


def change_stream(observed: DataFrame, state: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The rows of `cdc.change_set` from a stream of observations (relpath, hash, ts); a null hash says that the path is gone.

    state: relpath, hash, retired, as the last run left it. Observations may come in any order, again, or late by less than
    `delay`. A content's changes are told once the watermark has passed its last observation by the delay; an observation without
    a path only moves time on. One stateful operator holds all, since Spark gives the operators of a union no watermark of
    their own. Needs the state store of STORE_CONF.
    """
    delay_ms = int(pd.Timedelta(delay).total_seconds() * 1000)
    told = observed.withWatermark("ts", delay).alias("o").join(state.alias("s"), F.col("o.relpath") == F.col("s.relpath"), "left")
    events = told.select(F.col("o.relpath").alias("relpath"), F.col("o.ts").alias("ts"), F.unix_millis("o.ts").alias("at"), F.col("s.hash").alias("was"), F.inline(_transitions()))
    retired = state.where("retired").select("hash", "relpath").groupBy("hash")
    return events.groupBy("hash").transformWithState(PairedRenames(delay_ms), CHANGE, "Append", "EventTime", initialState=retired)

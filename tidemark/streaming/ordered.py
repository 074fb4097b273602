"""Machines over a streaming DataFrame by state of their own kinds: what waits and what is remembered are lists, timers are Spark's.

A machine is that of machines.fold(); besides, it may have

    lists           {name in s: DDL of its rows}: parts of the state that are kept as lists
    wake()          the time at which something happens without a row, or None
    tick(now)       what happens at times before now

run() and finish() let timers of the time up to a row, or all, fire by themselves, so fold() needs nothing more and gives
the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Rows wait in a list of their key until the watermark has passed them, and go through the machine in order then."""

    def __init__(self, machine: Callable[[dict], object], columns: list[str], row: str, names: list[str], idle: int):
        self.machine, self.columns, self.names, self.idle = machine, columns, names, idle
        # kinds are read here, where there is a session, and go to the workers as they are
        kinds = {"waiting": row, "kept": "state string, last bigint, first bigint", **getattr(machine({}), "lists", {})}
        self.kinds = {name: StructType.fromDDL(kind) for name, kind in kinds.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kinds["waiting"])
        self.kept = handle.getValueState("kept", self.kinds["kept"])
        self.lists = {name: handle.getListState(name, kind) for name, kind in self.kinds.items() if name not in ("waiting", "kept")}

    def _load(self) -> tuple[object, int | None]:
        if not self.kept.exists():
            return self.machine({}), None
        state, last, _ = self.kept.get()
        state = json.loads(state) if state else {}
        for name, rows in self.lists.items():
            state[name] = [list(r) for r in rows.get()] if rows.exists() else []
        return self.machine(state), last

    def _rows(self, key: tuple, out: list[tuple]) -> Iterator[Row]:
        made = Row(*self.names)
        return (made(key[0], *r) for r in out)

    def _at(self, micros: int) -> None:
        """A timer after this time, in place of others."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(micros // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        new = [tuple(r[c] for c in ("at", "id", *self.columns)) for r in rows]
        self.waiting.appendList(new)
        first = min(r[0] for r in new)
        state, last, earliest = self.kept.get() if self.kept.exists() else (None, None, None)
        if earliest is None or first < earliest:  # else a timer stands already
            self.kept.update((state, last, first))
            self._at(max(first, timerValues.getCurrentWatermarkInMs() * 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] < settled], [r for r in rows if r[0] >= settled]
        m, last = self._load()
        out = []
        if ready:
            out += m.run([list(c) for c in zip(*(r[2:] for r in ready), strict=True)])
            last = ready[-1][0]
        if hasattr(m, "tick"):
            out += m.tick(settled)
        wake = m.wake() if hasattr(m, "wake") else None
        if ready and rest:
            self.waiting.put(rest)
        elif ready:
            self.waiting.clear()
        if not rest and wake is None and last is not None and last + self.idle < settled:
            out += m.finish()
            for state in (self.waiting, self.kept, *self.lists.values()):
                state.clear()
        else:
            state = dict(m.s)
            for name, kept in self.lists.items():
                values = [tuple(r) for r in state.pop(name, [])]
                kept.put(values) if values else kept.clear()
            times = [*([rest[0][0]] if rest else []), *([wake] if wake is not None else [])] or [last + self.idle]
            self.kept.update((json.dumps(state), last, min(times)))
            self._at(max(min(times), settled))
        return self._rows(key, out)

    def close(self) -> None:
        pass


def stream(df: DataFrame, machine: Callable[[dict], object], schema: str, late: int, idle: int, key: str = "user_id") -> DataFrame:
    """machines.fold() over a streaming DataFrame with `at` (microseconds) and `id`: rows that come up to `late` out of order give fold()'s
    rows; a key of which nothing has come for `idle`, and that waits for no timer, is finished and its state dropped.

    The state of a key is a list of rows that the watermark hasn't passed, the machine's lists, and one short value, so that
    a busy key appends what comes and reads its list when a timer fires."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    columns = [c for c in machine({}).columns if c in df.columns]
    kinds = dict(df.dtypes)
    row = ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(["at", "id", *columns]))
    names = [x.split()[0] for x in schema.split(", ")]
    timed = df.select(key, "id", *columns, *(["at"] if "at" not in columns else []), F.timestamp_micros("at").alias("_time")).withWatermark("_time", f"{late} microseconds")
    return timed.groupBy(key).transformWithState(Ordered(machine, columns, row, names, idle), StructType.fromDDL(schema), "append", "eventTime")

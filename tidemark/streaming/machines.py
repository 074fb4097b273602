"""State machines over events, one for each key, that run as a batch fold and as a streaming query.

A machine is a class with run(columns) -> output rows for the next rows of its key, in order of time, with a
state `s` of plain values, and finish() for the key's end. How rows are cut into calls makes no difference, so
fold() gives it Arrow batches as they come, and stream() what a watermark has settled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Row = tuple


class Segments:
    """Activity segments with pre-roll and post-roll, cut at a longest duration or number of frames, and periodic coverage
    when nothing happens. Rows: (reason, first time, last time, frames).

    The ends of a segment follow from places in the sorted times: the frame that reaches the longest duration, the frame
    that makes it too many, the first quiet one `post` after the last active one. So a key is walked
    from segment to segment by binary search, not frame by frame."""

    schema = "user_id long, reason string, first_at long, last_at long, n long"
    columns = ("at", "activity")

    def __init__(self, state: dict, pre: int, post: int, longest: int, heartbeat: int, threshold: float, most: int = 180):
        self.s = state or {"recent": [], "open": None, "last": None}
        self.pre, self.post, self.longest, self.heartbeat, self.threshold, self.most = pre, post, longest, heartbeat, threshold, most

    def run(self, columns: list[list]) -> list[Row]:
        s, out = self.s, []
        times = np.array([*s["recent"], *columns[0]], np.int64)
        base, n = len(s["recent"]), len(times)
        on = np.r_[np.zeros(base, bool), np.array(columns[1], float) >= self.threshold]
        keep = max(self.longest, self.heartbeat, self.pre)
        reach = lambda i, back: max(i + 1 - self.most, int(np.searchsorted(times, times[i] - back)))  # noqa: E731  first remembered frame
        was_on = s["open"]["active"] if s["open"] else np.iinfo(np.int64).min // 2
        active = np.maximum.accumulate(np.where(on, times, was_on)) if n else times
        quiet = np.flatnonzero(~on & (times - active >= self.post))
        starts = np.flatnonzero(on)
        after = lambda places, i: int(places[k]) if (k := np.searchsorted(places, i)) < len(places) else n

        i = base
        # of an open segment: when it began, and the place where its first frame is or would be
        begun, place = (s["open"]["begun"], base - s["open"]["n"]) if s["open"] else (None, 0)
        while i < n:
            if begun is None:
                idle_until = after(starts, i)
                if s["last"] is None and i < idle_until:
                    s["last"], i = int(times[i]), i + 1
                due = max(i, int(np.searchsorted(times, s["last"] + self.heartbeat))) if s["last"] is not None else n
                if due < idle_until:
                    out.append(self._emit("periodic_coverage", times[reach(due, keep)], times[due], due - reach(due, keep) + 1))
                    i = due + 1
                elif idle_until < n:
                    place = max(reach(idle_until, keep), reach(idle_until, self.pre))
                    begun, i = int(times[place]), idle_until
                else:
                    break
            else:
                full = max(i, min(place + self.most - 1, int(np.searchsorted(times, begun + self.longest))))
                still = after(quiet, i)
                end = min(full, still)
                if end >= n:
                    break
                out.append(self._emit("activity_segment_limit" if full <= still else "activity_with_pre_post_roll", begun, times[end], end - place + 1))
                begun = None
                if full <= still and on[end]:
                    place = max(reach(end, keep), reach(end, self.pre))
                    begun = int(times[place])
                i = end + 1
        s["open"] = None if begun is None else {"begun": begun, "n": n - place, "active": int(active[-1]) if n else was_on}
        s["recent"] = times[reach(n - 1, keep) :].tolist() if n else []
        return out

    def _emit(self, reason: str, first: int, last: int, frames: int) -> Row:
        self.s["last"] = int(last)
        return reason, int(first), int(last), int(frames)

    def finish(self) -> list[Row]:
        left, self.s["open"] = self.s["open"], None
        return [self._emit("source_end", left["begun"], self.s["recent"][-1], left["n"])] if left else []


class Cooldown:
    """An action is reserved unless one of the same key is pending or uncertain, or was completed within the cooldown.
    Takes (at, the status that a reservation comes to); a status of its own is complete. From one reservation
    the next is found by binary search."""

    schema = "user_id long, decision string, first_at long, last_at long, n long"
    columns = ("at", "status")

    def __init__(self, state: dict, cooldown: int):
        self.s = state or {"free": None, "n": 0}  # free: from when on an action isn't blocked (None: always), -1: never again
        self.cooldown = cooldown

    def run(self, columns: list[list]) -> list[Row]:
        times, out = columns[0], []
        status = columns[1] if len(columns) > 1 else None
        at = np.array(times, np.int64)
        i = 0
        while self.s["free"] != -1 and i < len(at):
            if self.s["free"] is not None:
                i = max(i, int(np.searchsorted(at, self.s["free"], "right")))
            if i < len(at):
                self.s["n"] += 1
                out.append(("reserved", times[i], times[i], self.s["n"]))
                self.s["free"] = -1 if status and status[i] in ("pending", "uncertain") else times[i] + self.cooldown
                i += 1
        return out

    def finish(self) -> list[Row]:
        return []


class Evidence:
    """What a condition has seen so far: an episode of intervals that are at most `gap` apart, of which the time that is
    covered counts. It is plain data, so that a machine can keep it as state."""

    def __init__(self, kept: dict | None):
        self.kept = kept if kept is not None else {}

    def clear(self) -> None:
        self.kept.clear()

    def older_than(self, end: int) -> bool:
        return self.kept.get("until", end) <= end

    def add(self, start: int, end: int, gap: int) -> int:
        """The covered time with [start, end]; a gap too wide begins a new episode."""
        episode = self.kept
        if not episode or start - gap > episode["until"]:
            episode.update(since=start, until=start, covered=0)
        if end > episode["until"]:
            episode["covered"] += end - max(start, episode["until"])
            episode["until"] = end
        return episode["covered"]


class ResponseWatch:
    """A one-shot watch with its response. Takes (at: when the event is received, length, kind, id, and, if there, how
    late it is received after its end). Output: (status, since, at, number) for each change of status:

        armed             -> expired | missed_deadline | reserved
        reserved          -> awaiting_delivery (notify), or what the response gives:
        response          -> verified | awaiting_outcome | uncertain | missed_deadline
        awaiting_outcome, uncertain -> verified | outcome_unknown

    Conditions are dicts of kind, needed (time covered), gap and resets (kinds); a deadline condition has only `due`.
    The watch is created with its first row. respond(now) says if the device confirms the command (an exception:
    uncertain, never repeated). acknowledge(now) answers awaiting_delivery. Timers fire with the next row."""

    schema = "user_id long, decision string, first_at long, last_at long, n long"
    columns = ("at", "activity", "kind", "id", "late")

    def __init__(self, state: dict, condition: dict, ttl: int, response_deadline: int, outcome: dict | None = None, within: int = 0, not_before: int = 0, deadline_at: int | None = None, max_age: int | None = None, respond: Callable[[int], bool] | None = None, notify: bool = False):
        self.s = state or {"status": "armed", "created": None, "seen": {}, "n": 0}
        self.condition, self.ttl, self.response_deadline, self.outcome, self.within = condition, ttl, response_deadline, outcome, within
        self.not_before, self.deadline_at, self.max_age = not_before, deadline_at, max_age
        self.respond, self.notify = respond or (lambda now: True), notify
        #: status -> what it does with a row; other statuses are final or wait for acknowledge()
        self.steps = {"armed": self._while_armed, "awaiting_outcome": self._while_waiting, "uncertain": self._while_waiting}

    def run(self, columns: list[list]) -> list[Row]:
        out: list[Row] = []
        for at, length, kind, _, *late in zip(*columns, strict=True):
            if self.s["created"] is None:
                self.s["created"] = at
            if step := self.steps.get(self.s["status"]):
                end = at - (late[0] if late else 0)
                out += step(at, end - int(length), end, kind)
            elif self.s["status"] != "awaiting_delivery":
                break
        return out

    def _now(self, status: str, since: int, at: int) -> list[Row]:
        self.s["status"], self.s["n"] = status, self.s["n"] + 1
        return [(status, since, at, self.s["n"])]

    def expires(self) -> int:
        times = [self.s["created"] + self.ttl, self.deadline_at]
        return min(t for t in times if t is not None)

    def _holds(self, condition: dict, start: int, end: int, kind: str, lower: int) -> int | None:
        """When the condition is met by what has been seen with this event, or None. Evidence before `lower` doesn't
        count; an event that ends before what was seen changes nothing."""
        evidence = Evidence(self.s["seen"])
        if not evidence.older_than(end):
            return None
        if kind in condition.get("resets", ()):
            evidence.clear()
        if kind != condition["kind"] or end < lower:
            return None
        beyond = evidence.add(max(start, lower), end, condition["gap"]) - condition["needed"]
        if beyond < 0:
            return None
        return end - beyond if condition["needed"] else end

    def _read(self, now: int, end: int) -> bool:
        """Whether an event counts at all: not too old when it comes, not before the watch."""
        return end >= (self.not_before or self.s["created"]) and (self.max_age is None or now - end <= self.max_age)

    def _while_armed(self, now: int, start: int, end: int, kind: str) -> list[Row]:
        if now >= self.expires():
            return self._now("expired", self.s["created"], now)
        if "due" in self.condition:
            met = self.condition["due"] if now >= self.condition["due"] else None
        else:
            met = self._holds(self.condition, start, end, kind, self.not_before or self.s["created"]) if self._read(now, end) else None
        if met is None:
            return []
        since = self.s["seen"].get("since", met)
        self.s["seen"] = {}
        if now - met > self.response_deadline:
            return self._now("missed_deadline", since, now)
        self.s["met"] = met
        return self._now("reserved", since, met) + (self._now("awaiting_delivery", met, now) if self.notify else self._act(now))

    def _act(self, now: int) -> list[Row]:
        met = self.s["met"]
        if now > min(self.expires(), met + self.response_deadline):
            return self._now("missed_deadline", met, now)
        self.s["sent"] = now
        try:
            confirmed = self.respond(now) is True
        except Exception:
            confirmed = False
        return self._done(now) if confirmed else self._now("uncertain", met, now)

    def _done(self, now: int) -> list[Row]:
        return self._now("awaiting_outcome" if self.outcome else "verified", self.s["met"], now)

    def acknowledge(self, now: int) -> list[Row]:
        if self.s["status"] != "awaiting_delivery":
            return []
        self.s["sent"] = now
        return self._done(now)

    def _while_waiting(self, now: int, start: int, end: int, kind: str) -> list[Row]:
        if not self.outcome:
            return []
        sent = self.s["sent"]
        if now > min(self.expires(), sent + self.within):
            return self._now("outcome_unknown", sent, now)
        if start < sent or not self._read(now, end) or self._holds(self.outcome, start, end, kind, sent) is None:
            return []
        return self._now("verified", sent, end)

    def finish(self) -> list[Row]:
        return []


def _columns(machine: object, names: list[str]) -> list[str]:
    return [c for c in machine.columns if c in names]


def fold(df: DataFrame, machine: Callable[[dict], object], schema: str) -> DataFrame:
    """Rows (user_id, at, id, and what else the machine takes) of each key in order of (at, id) through a machine,
    to its end. A key's rows come in batches; only the machine's state goes from one to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [x.split()[0] for x in schema.split(", ")], [pa.string() if x.split()[1] == "string" else pa.int64() for x in schema.split(", ")]
        m, key = None, None
        rows = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        for batch in batches:
            keys, out = batch.column("user_id").to_pylist(), []
            columns = [batch.column(c).to_pylist() for c in _columns(m or machine({}), batch.schema.names)]
            i = 0
            while i < len(keys):
                j = i + 1
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if m is None or keys[i] != key:
                    out += [(key, *r) for r in m.finish()] if m else []
                    m, key = machine({}), keys[i]
                out += [(key, *r) for r in m.run([c[i:j] for c in columns])]
                i = j
            if out:
                yield rows(out)
        if m and (out := [(key, *r) for r in m.finish()]):
            yield rows(out)

    return df.repartition("user_id").sortWithinPartitions("user_id", "at", "id").mapInArrow(run, schema)


def stream(df: DataFrame, machine: Callable[[dict], object], schema: str, late: int, idle: int) -> DataFrame:
    """The same over a streaming DataFrame. Rows wait in their key's state until the watermark (`late` microseconds behind
    the newest row) has passed them, so that they go through the machine in order whatever micro-batch brought
    them; a key of which nothing has come for `idle` microseconds is finished and its state dropped. The rows are
    fold()'s for input that is at most `late` out of order and has no pause over `idle` within a key."""
    columns = _columns(machine({}), df.columns)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"waiting": [], "state": {}, "last": None}
        for group in batches:
            kept["waiting"] += [list(r) for r in zip(*(group[c].tolist() for c in ("at", "id", *columns)), strict=True)]
        settled = state.getCurrentWatermarkMs() * 1000
        kept["waiting"].sort(key=lambda r: r[:2])
        ready = [r for r in kept["waiting"] if r[0] < settled]
        kept["waiting"] = kept["waiting"][len(ready) :]
        m, out = machine(kept["state"]), []
        if ready:
            out = m.run([list(c) for c in zip(*(r[2:] for r in ready), strict=True)])
            kept["last"] = ready[-1][0]
        over = not kept["waiting"] and kept["last"] is not None and kept["last"] + idle < settled
        if over:
            out += m.finish()
            state.remove()
        else:
            kept["state"] = m.s
            state.update((json.dumps(kept),))
            wake = kept["waiting"][0][0] if kept["waiting"] else kept["last"] + idle
            state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=names)

    timed = df.select("user_id", "id", *columns, *(["at"] if "at" not in columns else []), F.timestamp_micros("at").alias("_time")).withWatermark("_time", f"{late} microseconds")
    return timed.groupBy("user_id").applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)

"""Watches as a machine: any number of them in a key, over the key's events, with timers that fire without a row."""

from __future__ import annotations

import json

Row = tuple
#: Statuses in which a watch reads events, and those that can still change.
READS = ("armed", "awaiting_outcome", "uncertain")
OPEN = (*READS, "awaiting_delivery", "sent")


class Episode:
    """What a condition has seen: intervals of the same subjects, at most `gap` apart, of which the time that is covered counts."""

    def __init__(self, condition: dict, seen: dict):
        self.condition, self.seen = condition, seen

    def reads(self, event: dict) -> bool:
        """Whether an event is one that the condition asks for, whatever its kind."""
        c = self.condition
        return (
            event["confidence"] >= c.get("confidence", 0)
            and (c.get("origin") is None or c["origin"] == event.get("origin"))
            and (c.get("label") is None or c["label"] == event.get("label"))
            and set(c.get("subjects", ())) <= set(event.get("subjects", ()))
        )

    def take(self, event: dict, lower: int) -> int | None:
        """When the condition is met, with this event, or None. What ended before what was seen changes nothing, what ended before `lower`
        counts for nothing."""
        c, seen = self.condition, self.seen
        if not self.reads(event):
            return None
        about = sorted(event.get("subjects", ())) or [event.get("label")]
        if event["kind"] in c.get("resets", ()) and (not seen or seen["about"] == about and event["ended"] >= seen["until"]):
            seen.clear()
        start, end = max(lower, event["started"]), event["ended"]
        if event["kind"] != c["kind"] or end < start or seen and end < seen["until"]:
            return None
        if not seen or start > seen["until"] + c.get("gap", 0) or about != seen["about"]:
            seen.clear()
            seen.update(since=start, until=start, about=about, covered=0)
        fresh = max(start, seen["until"])
        needed, before = c.get("needed", 0), seen["covered"]
        seen.update(covered=before + max(0, end - fresh), until=max(end, seen["until"]))
        if seen["covered"] < needed:
            return None
        return fresh + max(0, needed - before) if needed else end


class Watches:
    """Rows (at, what, watch, body: JSON), in the order in which they are received:

        create  {condition, ttl, and, if wanted: not_before, deadline_at, respond_within, max_age, outcome: {condition, within}, device}
        cancel  of a watch
        event   {id, kind, started, ended, confidence, label, subjects, origin}; an id counts once
        answer  {ok, delivered}: to a response

    A condition is {kind, confidence, label, subjects, origin, needed: time covered, gap, resets: kinds}, or {due: a time}. Times are microseconds.
    Output: (watch, decision, since, at, event) for each change:

        armed                       -> expired | missed_deadline | reserved | cancelled
        reserved                    -> awaiting_delivery, or sent (device): what carries it out reads these rows
        awaiting_delivery, sent     -> verified | awaiting_outcome | uncertain (a device that doesn't confirm; never sent again)
        awaiting_outcome, uncertain -> verified | outcome_unknown

    and `repeated` or `conflict` for a create or an event whose id came before, with the same or another body. A watch reads each event once: those
    that came before it too, if they ended after its start and aren't older than max_age. Expiry, deadlines and the time for
    an outcome are timers. Watches that ended are forgotten after `forget`, events when they are too old for any watch."""

    schema = "user_id long, watch string, decision string, since long, at long, event string"
    columns = ("at", "what", "watch", "body")
    lists = {"watches": "id string, body string", "events": "id string, ended bigint, body string"}

    def __init__(self, state: dict, max_age: int = 30_000_000, forget: int = 604_800_000_000, respond_within: int = 10_000_000):
        state = {"watches": [], "events": [], **state}
        self.watches = {k: json.loads(v) for k, v in state["watches"]}
        self.events = {k: (ended, body) for k, ended, body in state["events"]}
        self.max_age, self.forget, self.respond_within = max_age, forget, respond_within

    @property
    def s(self) -> dict:
        return {"watches": [[k, json.dumps(v)] for k, v in self.watches.items()], "events": [[k, *v] for k, v in self.events.items()]}

    def run(self, columns: list[list]) -> list[Row]:
        out: list[Row] = []
        for at, what, name, body in zip(*columns, strict=True):
            out += self._until(at + 1)
            body = json.loads(body) if body else {}
            out += getattr(self, f"_{what}")(at, name, body) + self._advance(at)
        return out

    def tick(self, now: int) -> list[Row]:
        return self._until(now)

    def finish(self) -> list[Row]:
        return self._until(None)

    def wake(self) -> int | None:
        return min((t for w in self.watches.values() if (t := self._due(w)) is not None), default=None)

    def _until(self, now: int | None) -> list[Row]:
        """What timers before now say (None: all of them)."""
        out: list[Row] = []
        while (due := self.wake()) is not None and (now is None or due < now):
            out += self._advance(due)
        return out

    @staticmethod
    def _expires(w: dict) -> int:
        spec = w["spec"]
        return min(w["created"] + spec["ttl"], spec.get("deadline_at") or w["created"] + spec["ttl"])

    def _due(self, w: dict) -> int | None:
        if w["status"] == "armed":
            return min(self._expires(w), w["spec"]["condition"].get("due", self._expires(w)))
        if w["status"] in READS and w["spec"].get("outcome"):
            return min(self._expires(w), w["sent"] + w["spec"]["outcome"]["within"]) + 1
        return None

    def _now(self, name: str, status: str, since: int, at: int, event: str | None = None) -> list[Row]:
        w = self.watches[name]
        w["status"], w["changed"] = status, at
        return [(name, status, since, at, event)]

    def _create(self, at: int, name: str, spec: dict) -> list[Row]:
        if old := self.watches.get(name):
            return [(name, "repeated" if old["spec"] == spec else "conflict", old["created"], at, None)]
        created = spec.get("created", at)
        unseen = sorted(self.events, key=lambda e: (self.events[e][0], e))
        self.watches[name] = {"spec": spec, "created": created, "seen": {}, "unseen": unseen, "sent": None, "met": None}
        return self._now(name, "armed", created, at)

    def _cancel(self, at: int, name: str, _: dict) -> list[Row]:
        w = self.watches.get(name)
        return self._now(name, "cancelled", w["created"], at) if w and w["status"] == "armed" else []  # what is reserved stays

    def _event(self, at: int, _: str | None, event: dict) -> list[Row]:
        name, body = event["id"], json.dumps(event, sort_keys=True)
        if name in self.events:
            return [(None, "repeated" if self.events[name][1] == body else "conflict", event["ended"], at, name)]
        if event["ended"] > at:
            return [(None, "future", event["ended"], at, name)]
        oldest = at - max([self.max_age, *(w["spec"].get("max_age", 0) for w in self.watches.values())])
        self.events = {k: v for k, v in self.events.items() if v[0] >= oldest}
        self.watches = {k: w for k, w in self.watches.items() if w["status"] in OPEN or at - w["changed"] <= self.forget}
        if event["ended"] >= oldest:
            self.events[name] = (event["ended"], body)
            for w in self.watches.values():
                if w["status"] in OPEN:
                    w["unseen"] = [e for e in w["unseen"] if e in self.events] + [name]
        return []

    def _answer(self, at: int, name: str, answer: dict) -> list[Row]:
        w = self.watches.get(name)
        if not w or w["status"] not in ("awaiting_delivery", "sent"):
            return []
        if not answer.get("ok"):
            return self._now(name, "uncertain", w["met"], at) if w["status"] == "sent" else []
        if w["status"] == "awaiting_delivery":
            w["sent"] = answer.get("delivered", at)
        return self._now(name, "awaiting_outcome" if w["spec"].get("outcome") else "verified", w["met"], at)

    def _advance(self, now: int) -> list[Row]:
        out: list[Row] = []
        for name in sorted(n for n, w in self.watches.items() if w["status"] in READS):
            out += self._read(name, self.watches[name], now)
        return out

    def _read(self, name: str, w: dict, now: int) -> list[Row]:
        spec = w["spec"]
        condition, armed = spec["condition"], w["status"] == "armed"
        if armed and now >= self._expires(w):
            return self._now(name, "expired", w["created"], now)
        if armed and "due" in condition and now >= condition["due"]:
            return self._trigger(name, w, now, condition["due"], None)
        if not armed and (due := self._due(w)) is not None and now >= due:
            return self._now(name, "outcome_unknown", w["sent"], now)
        starts = spec.get("not_before", w["created"])
        w["unseen"].sort(key=lambda e: (self.events[e][0], e) if e in self.events else (0, e))
        while w["unseen"]:
            place = w["unseen"].pop(0)
            if place not in self.events:
                continue
            event = json.loads(self.events[place][1])
            if now - event["ended"] > spec.get("max_age", self.max_age) or event["ended"] < starts:
                continue
            if armed and "due" not in condition:
                met = Episode(condition, w["seen"]).take(event, starts)
                if met is not None:
                    return self._trigger(name, w, now, met, place)
            elif not armed and spec.get("outcome") and event["started"] >= w["sent"]:
                if Episode(spec["outcome"]["condition"], w["seen"]).take(event, w["sent"]) is not None:
                    return self._now(name, "verified", w["sent"], now, place)
        return []

    def _trigger(self, name: str, w: dict, now: int, met: int, event: str | None) -> list[Row]:
        since, w["seen"], w["met"] = w["seen"].get("since", met), {}, met
        if now > met + w["spec"].get("respond_within", self.respond_within):
            return self._now(name, "missed_deadline", since, now, event)
        out = self._now(name, "reserved", since, now, event)
        if w["spec"].get("device"):
            w["sent"] = now
        return out + self._now(name, "sent" if w["spec"].get("device") else "awaiting_delivery", met, now, event)

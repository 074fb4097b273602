"""An observer of a recording as a machine: order, memory, validation, decision and its effects, window by window."""

from __future__ import annotations

import json
from collections.abc import Callable

Row = tuple


class Observer:
    """Rows `fact` (at, entity, value: what a device says) and `window` (at, entity: the window's id, until: its end, value: JSON of what it
    shows; its "devices" are states by entity at that time). Output: (window, outcome, detail, at), first the window's own:

        recorded        its id came before: nothing happens
        out_of_order    it ends before one that was taken
        rejected        validate() finds something wrong: detail has it
        (else)          what decide() says, and then, for each of its actions: satisfied, cooldown or reserved

    decide(window, memory) gives {"outcome", and, if wanted, "observations": [[entity, value, confidence]], "actions": [[entity, value]]}.
    Memory has each entity's last value from before the window (none older than ttl). Devices' own states are
    taken in after it is read, observations after the decision: those with at least `least` confidence, on entities whose
    device didn't speak. An action whose entity has the value already is satisfied; one that was reserved within
    `cooldown` isn't reserved again."""

    schema = "user_id long, window string, outcome string, detail string, at long"
    columns = ("at", "what", "entity", "until", "value")
    lists = {"facts": "entity string, value string, at bigint", "done": "id string", "reserved": "action string, at bigint"}

    def __init__(self, state: dict, decide: Callable[[dict, dict], dict], validate: Callable[[dict], list[str]] = lambda window: [], ttl: int = 300_000_000, least: float = 0.6, cooldown: int = 60_000_000):
        self.facts = {k: (v, at) for k, v, at in state.get("facts", [])}
        self.done = {r[0] for r in state.get("done", [])}
        self.reserved = {a: at for a, at in state.get("reserved", [])}
        self.last = state.get("last")
        self.decide, self.validate, self.ttl, self.least, self.cooldown = decide, validate, ttl, least, cooldown

    @property
    def s(self) -> dict:
        return {"last": self.last, "facts": [[k, *v] for k, v in self.facts.items()], "done": [[d] for d in sorted(self.done)], "reserved": [[a, t] for a, t in self.reserved.items()]}

    def run(self, columns: list[list]) -> list[Row]:
        out: list[Row] = []
        for at, what, entity, until, value in zip(*columns, strict=True):
            if what == "fact":
                self._learn(entity, value, at)
            else:
                out += [(entity, outcome, detail, at) for outcome, detail in self._window(at, entity, until, json.loads(value))]
        return out

    def _learn(self, entity: str, value: str, at: int) -> None:
        """The last word on an entity counts; of equal times the one that came later."""
        if entity not in self.facts or at >= self.facts[entity][1]:
            self.facts[entity] = (value, at)

    def _window(self, at: int, name: str, until: int, shown: dict) -> list[tuple[str, str | None]]:
        if name in self.done:
            return [("recorded", None)]
        self.done.add(name)
        if self.last is not None and until < self.last:
            return [("out_of_order", None)]
        self.last = until
        memory = {k: v for k, (v, seen) in self.facts.items() if at - seen <= self.ttl}
        devices = shown.get("devices", {})
        for entity, value in devices.items():
            self._learn(entity, value, at)
        if wrong := self.validate(shown):
            return [("rejected", ",".join(wrong))]
        said = self.decide(shown, memory)
        for entity, value, confidence in said.get("observations", []):
            if confidence >= self.least and entity not in devices:
                self._learn(entity, value, at)
        out = [(said["outcome"], json.dumps(memory, sort_keys=True, separators=(",", ":")))]
        for entity, value in said.get("actions", []):
            action = f"{entity}={value}"
            if self.facts.get(entity, (None,))[0] == value:
                out.append(("satisfied", action))
            elif action in self.reserved and at - self.reserved[action] < self.cooldown:
                out.append(("cooldown", action))
            else:
                self.reserved[action] = at
                out.append(("reserved", action))
        return out

    def finish(self) -> list[Row]:
        return []

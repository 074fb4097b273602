"""Idempotent commands as a machine: an answer is given once and kept for whoever asks again."""

from __future__ import annotations

from collections.abc import Callable


class Commands:
    """Rows (at, digest, body) of one command id. Output: (status, answer, at): done (what execute(body, at) gives), repeated (the first answer
    again, for the same digest) or conflict (another digest). After `keep` from its first coming an id is forgotten, by a
    timer, and may be used anew. A key is a command id, so no key gets more than its own repeats."""

    schema = "user_id long, status string, answer string, at long"
    columns = ("at", "digest", "body")

    def __init__(self, state: dict, execute: Callable[[str, int], str], keep: int):
        self.s = {"digest": None, "answer": None, "until": None, **state}
        self.execute, self.keep = execute, keep

    def run(self, columns: list[list]) -> list[tuple]:
        out = []
        for at, digest, body in zip(*columns, strict=True):
            self.tick(at + 1)
            if self.s["until"] is None:
                self.s.update(digest=digest, answer=self.execute(body, at), until=at + self.keep)
                out.append(("done", self.s["answer"], at))
            elif digest == self.s["digest"]:
                out.append(("repeated", self.s["answer"], at))
            else:
                out.append(("conflict", None, at))
        return out

    def wake(self) -> int | None:
        return self.s["until"]

    def tick(self, now: int) -> list[tuple]:
        if self.s["until"] is not None and self.s["until"] < now:
            self.s.update(digest=None, answer=None, until=None)
        return []

    def finish(self) -> list[tuple]:
        return []


class QueueItem:
    """Entries (at, action, owner) of one queue item, pending when it begins. Output at its end: (status, owner, claimed_at, claims, refused).

        pending     claim -> processing, held by the owner; expire -> expired
        processing  complete, fail -> complete, failed, and crash -> pending, by the owner that holds it

    Other entries are refused and change nothing; complete, failed and expired stay. What is still processing at the end keeps its owner and the
    time of its claim."""

    schema = "user_id long, status string, owner long, claimed_at long, claims long, refused long"
    columns = ("at", "action", "owner")

    def __init__(self, state: dict):
        self.s = {"status": "pending", "owner": None, "claimed_at": None, "claims": 0, "refused": 0, **state}

    def run(self, columns: list[list]) -> list[tuple]:
        s = self.s
        for at, action, owner in zip(*columns, strict=True):
            mine = s["status"] == "processing" and owner == s["owner"]
            if s["status"] == "pending" and action == "claim":
                s.update(status="processing", owner=owner, claimed_at=at, claims=s["claims"] + 1)
            elif s["status"] == "pending" and action == "expire":
                s["status"] = "expired"
            elif mine and action in ("complete", "fail", "crash"):
                s.update(status={"complete": "complete", "fail": "failed", "crash": "pending"}[action], owner=None, claimed_at=None)
            else:
                s["refused"] += 1
        return []

    def finish(self) -> list[tuple]:
        return [tuple(self.s[c] for c in ("status", "owner", "claimed_at", "claims", "refused"))]

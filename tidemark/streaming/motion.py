"""Motion of tracked objects as a machine for fold() and stream(): when it starts, when it settles, when sight is lost."""

from __future__ import annotations


class Motion:
    """Rows: (time, relative motion, whether the camera's own motion was accounted for, a reason why the frame can't be used
    or ''). Output: (what, since, at, number).

    A phase is a run of frames that all move or all stand still. A still object has started when a moving phase
    is `confirm` frames long, since the frame before the phase; a moving one has settled when a still phase is `settle`
    long, since its first frame. A frame that can't be compared ends a still phase and counts for no other. A reason, or a pause
    over `pause`, loses sight; a track that was lost never comes back by itself, and expires after `ttl`."""

    schema = "user_id long, what string, since long, at long, n long"
    columns = ("at", "activity", "steady", "problem")

    def __init__(self, state: dict, bound: float = 0.003, confirm: int = 3, settle: int = 300_000, pause: int | None = None, ttl: int = 5_000_000):
        self.s = state or {"sight": "visible", "moves": False, "phase": None, "last": None, "n": 0}
        self.bound, self.confirm, self.settle, self.pause, self.ttl = bound, confirm, settle, pause, ttl

    def _say(self, what: str, since: int, at: int) -> list[tuple]:
        self.s["n"] += 1
        return [(what, since, at, self.s["n"])]

    def run(self, columns: list[list]) -> list[tuple]:
        s, out = self.s, []
        for at, motion, steady, problem in zip(*columns, strict=True):
            before, s["last"] = s["last"], at
            if s["sight"] == "expired":
                continue
            if s["sight"] == "uncertain":
                if at - s["lost"] > self.ttl:
                    s["sight"] = "expired"
                    out += self._say("expired", s["lost"], at)
                continue
            if problem or (self.pause is not None and before is not None and at - before > self.pause):
                s.update(sight="uncertain", lost=at, phase=None)
                out += self._say("visibility_lost", at if before is None else before, at)
                continue
            if not steady:
                if s["phase"] and not s["phase"]["moving"]:  # a still phase must begin anew
                    s["phase"] = None
                continue
            moving = motion >= self.bound
            if s["phase"] is None or s["phase"]["moving"] != moving:
                s["phase"] = {"moving": moving, "since": (at if before is None else before) if moving else at, "frames": 0}
            s["phase"]["frames"] += 1
            started = moving and not s["moves"] and s["phase"]["frames"] >= self.confirm
            settled = not moving and s["moves"] and at - s["phase"]["since"] >= self.settle
            if started or settled:
                s["moves"] = started
                out += self._say("motion_started" if started else "motion_settled", s["phase"]["since"], at)
        return out

    def finish(self) -> list[tuple]:
        return []

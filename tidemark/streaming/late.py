"""Late detections as a machine for fold() and for a stream: each is placed at the frame it was made from, and what came since is
replayed for its track."""

from __future__ import annotations

from tidemark.streaming.motion import Motion


class Replays:
    """Rows of kind `frame` (at, activity, steady, problem: see Motion) and of kind `report` (at: when it is received, track, anchor: the time of
    its frame). Output: (track, what, mode, since, at, n).

    A report waits until its anchor has come, and has expired when the anchor isn't among the last `memory` frames any more. Otherwise
    a track begins at the anchor and goes through the frames after it: `replayed` if it is in sight at the last of them and there is
    room among `most` tracks (or it is one of them), and followed live from then on; else `uncertain`. What its
    motion did in between is told once, for a track that was never followed before (mode `replay`). At most `pending` reports wait;
    one more is `dropped`, one whose anchor never comes `unavailable`."""

    schema = "user_id long, track string, what string, mode string, since long, at long, n long"
    columns = ("at", "kind", "activity", "steady", "problem", "track", "anchor")
    lists = {"frames": "at bigint, activity double, steady boolean, problem string", "pending": "track string, anchor bigint, seen bigint"}

    def __init__(self, state: dict, memory: int = 600, most: int = 64, pending: int = 128, **motion: object):
        self.s = {"frames": [], "pending": [], "tracks": {}, "known": {}, "now": None, **state}
        self.memory, self.most, self.limit, self.motion = memory, most, pending, motion

    def run(self, columns: list[list]) -> list[tuple]:
        s, out = self.s, []
        for at, kind, *values in zip(*columns, strict=True):
            s["now"] = at
            if kind == "frame":
                frame = [at, *values[:3]]
                s["frames"] = [*s["frames"][-(self.memory - 1) :], frame] if self.memory > 1 else [frame]
                for track in list(s["tracks"]):
                    out += self._follow(track, [frame], "live")
                out += self._settle()
            else:
                report = [values[3], values[4], at]
                if len(s["pending"]) >= self.limit:
                    out.append(self._say(report, "dropped", 0))
                    continue
                s["pending"].append(report)
                out += self._settle()
                if s["pending"] and s["pending"][-1] is report:
                    out.append(self._say(report, "waits", 0))
        return out

    def _say(self, report: list, what: str, n: int) -> tuple:
        return (report[0], what, "report", report[1], self.s["now"], n)

    def _follow(self, track: str, frames: list[list], mode: str) -> list[tuple]:
        machine = Motion(self.s["tracks"][track], **self.motion)
        said = machine.run([list(c) for c in zip(*frames, strict=True)]) if frames else []
        self.s["tracks"][track] = machine.s
        if machine.s["sight"] == "expired":
            del self.s["tracks"][track]
        return [(track, what, mode, since, at, n) for what, since, at, n in said]

    def _settle(self) -> list[tuple]:
        """What can be said of the reports that wait, in the order in which they came."""
        s, out, left = self.s, [], []
        for report in s["pending"]:
            track, anchor, _ = report
            place = next((i for i, f in enumerate(s["frames"]) if f[0] == anchor), None)
            if place is None:
                if not s["frames"] or anchor > s["frames"][-1][0]:
                    left.append(report)
                else:
                    out.append(self._say(report, "expired", 0))
                continue
            before = s["tracks"].pop(track, None)
            s["tracks"][track] = {"sight": "visible", "moves": False, "phase": None, "last": anchor, "n": 0}
            since = s["frames"][place + 1 :]
            said = self._follow(track, since, "replay")
            first = before is None and track not in s["known"]
            in_sight = s["tracks"].get(track, {}).get("sight") == "visible"
            room = before is not None or len(s["tracks"]) <= self.most
            if first:
                out += said
                if since:
                    s["known"][track] = 1
            if not (in_sight and room):
                s["tracks"].pop(track, None)
                if before is not None:
                    s["tracks"][track] = before
            out.append(self._say(report, "replayed" if in_sight and room else "uncertain", len(since)))
        s["pending"] = left
        return out

    def finish(self) -> list[tuple]:
        left, self.s["pending"] = self.s["pending"], []
        return [self._say(r, "unavailable", 0) for r in left]

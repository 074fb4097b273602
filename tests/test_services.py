"""Services that keep state over a key's rows: batch against definitions, and the stream against the batch."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.plans import services
from tidemark.streaming import late, machines, motion, ordered, watches

SECOND = 1_000_000


def by_key(df, key="user_id"):
    groups = defaultdict(list)
    for r in df.collect():
        groups[r[key]].append(r)
    return {k: sorted(v, key=lambda r: (r["at"], r["id"])) for k, v in groups.items()}


def streamed(spark, tmp_path, df, machine, schema, late_by, idle, batches=4):
    """The rows of a stream to which df's come out of order by less than late_by, and then one of a far time."""
    rng = random.Random(7)
    rows = sorted(df.collect(), key=lambda r: r["at"] + rng.randrange(late_by))
    size = -(-len(rows) // batches)
    last = {**rows[0].asDict(), "user_id": -1, "at": max(r["at"] for r in rows) + 20 * idle}
    for i, part in enumerate([rows[k : k + size] for k in range(0, len(rows), size)] + [[last], [{**last, "at": last["at"] + idle}]]):
        spark.createDataFrame([tuple(r) if not isinstance(r, dict) else tuple(r[c] for c in df.columns) for r in part], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:02d}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = ordered.stream(source, machine, schema, late_by, idle)
    run = out.writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination()
    return Counter(tuple(r) for r in spark.table("streamed").where("user_id >= 0").collect())


def few(df, n=4):
    return df.where(F.col("user_id") < n)


# late reports


def brute_replays(rows, memory, most, **spec):
    """Every track is run again from its anchor whenever anything is asked of it."""
    frames, waiting, live, known, out = [], [], {}, set(), []

    def course(anchor, until):
        m = motion.Motion({"sight": "visible", "moves": False, "phase": None, "last": frames[anchor][0], "n": 0}, **spec)
        part = frames[anchor + 1 : until]
        return (m.run([list(c) for c in zip(*part, strict=True)]) if part else []), m.s["sight"]

    def settle(now):
        for report in list(waiting):
            track, anchor = report
            held = range(max(0, len(frames) - memory), len(frames))
            found = [i for i in held if frames[i][0] == anchor]
            if not found:
                if frames and anchor <= frames[-1][0]:
                    waiting.remove(report)
                    out.append((track, "expired", "report", anchor, now, 0))
                continue
            waiting.remove(report)
            told, sight = course(found[0], len(frames))
            taken = sight == "visible" and (track in live or len(live) < most)
            if track not in live and track not in known:
                out.extend((track, what, "replay", since, at, n) for what, since, at, n in told)
                if found[0] < len(frames) - 1:
                    known.add(track)
            if taken:
                live[track] = found[0]
            out.append((track, "replayed" if taken else "uncertain", "report", anchor, now, len(frames) - 1 - found[0]))

    for r in rows:
        if r["kind"] == "frame":
            before = {t: course(a, len(frames))[0] for t, a in live.items()}
            frames.append((r["at"], r["activity"], r["steady"], r["problem"]))
            for track in list(live):
                told, sight = course(live[track], len(frames))
                out.extend((track, what, "live", since, at, n) for what, since, at, n in told[len(before[track]) :])
                if sight == "expired":
                    del live[track]
            settle(r["at"])
        else:
            waiting.append((r["track"], r["anchor"]))
            settle(r["at"])
            if waiting and waiting[-1] == (r["track"], r["anchor"]):
                out.append((r["track"], "waits", "report", r["anchor"], r["at"], 0))
    now = rows[-1]["at"]
    return out + [(t, "unavailable", "report", a, now, 0) for t, a in waiting]


SPEC = {"bound": 0.5, "confirm": 3, "settle": 2 * services.DAY, "pause": 15 * services.DAY, "ttl": 20 * services.DAY}


def test_replays_by_definition(spark, data):
    groups = by_key(services.replay_rows(spark, data))
    want = Counter((u, *r) for u, rows in groups.items() for r in brute_replays(rows, 12, 3, **SPEC))
    got = Counter(tuple(r) for r in services.late_replays(spark, data).collect())
    assert got == want
    said = {r[2] for r in got}
    assert {"waits", "expired", "replayed", "uncertain", "unavailable", "motion_started", "motion_settled"} <= said
    assert {r[3] for r in got} == {"report", "replay", "live"}


def test_replays_as_a_stream(spark, data, tmp_path):
    rows = few(services.replay_rows(spark, data), 3)
    batch = Counter(tuple(r) for r in machines.fold(rows, services.replays, late.Replays.schema).collect())
    got = streamed(spark, tmp_path, rows, services.replays, late.Replays.schema, 3 * services.DAY, 60 * services.DAY)
    assert got == batch and sum(batch.values()) > 20


def test_reports_beyond_the_bound():
    m = late.Replays({}, memory=5, most=1, pending=2, bound=1)
    rows = [(1, "report", None, None, None, f"t{i}", 50) for i in range(3)] + [(50, "frame", 0, True, "", None, None), (51, "report", None, None, None, "t9", 50)]
    got = [r[:3] for r in m.run([list(c) for c in zip(*rows, strict=True)])]
    assert got == [("t0", "waits", "report"), ("t1", "waits", "report"), ("t2", "dropped", "report"), ("t0", "replayed", "report"), ("t1", "uncertain", "report"), ("t9", "uncertain", "report")]


# watches


def brute_watches(rows, max_age):
    """An engine that at every instant at which anything could happen asks every watch anew, over all events, with marks of what each has
    seen."""
    made, received, out = {}, {}, []
    instants = {r["at"] for r in rows}
    for r in rows:
        body = json.loads(r["body"]) if r["body"] else {}
        if r["what"] == "create" and body:
            spec = body
            instants |= {r["at"] + spec["ttl"], r["at"] + spec["ttl"] + 1, spec.get("deadline_at", r["at"]), spec.get("deadline_at", r["at"]) + 1, spec["condition"].get("due", r["at"])}
            if spec.get("outcome"):
                for x in rows:
                    if x["what"] == "answer" and x["watch"] == r["watch"]:
                        instants |= {json.loads(x["body"])["delivered"] + spec["outcome"]["within"] + 1}
                instants |= {x["at"] + spec["outcome"]["within"] + 1 for x in rows}
                instants |= {t + spec["outcome"]["within"] + 1 for t in (spec["condition"].get("due", 0),)}

    def say(name, status, since, now, event=None):
        made[name]["status"] = status
        out.append((name, status, since, now, event))

    def fits(c, e):
        return e["confidence"] >= c.get("confidence", 0) and c.get("origin") in (None, e.get("origin")) and c.get("label") in (None, e.get("label")) and set(c.get("subjects", [])) <= set(e.get("subjects", []))

    def accumulate(c, e, p, lower):
        key = sorted(e.get("subjects", [])) or [e.get("label")]
        if e["kind"] in c.get("resets", []) and fits(c, e) and e["ended"] >= p.get("end", float("-inf")) and p.get("key") in (None, key):
            p.clear()
        if e["kind"] != c["kind"] or not fits(c, e) or e["ended"] < p.get("end", float("-inf")):
            return None
        start = max(lower, e["started"])
        if e["ended"] < start:
            return None
        if "end" not in p or start > p["end"] + c.get("gap", 0) or p["key"] != key:
            p.clear()
            p.update(key=key, start=start, end=start, parts=[])
        before = sum(b - a for a, b in p["parts"])
        fresh = max(start, p["end"])
        if e["ended"] > fresh:
            p["parts"].append((fresh, e["ended"]))
        p["end"] = max(p["end"], e["ended"])
        need = c.get("needed", 0)
        if sum(b - a for a, b in p["parts"]) < need:
            return None
        return e["ended"] if not need else fresh + max(0, need - before)

    def ask(now):
        for name in sorted(made):
            w = made[name]
            spec = w["spec"]
            expires = min(w["created"] + spec["ttl"], spec.get("deadline_at") or float("inf"))
            trigger = None
            if w["status"] == "armed" and now >= expires:
                say(name, "expired", w["created"], now)
                continue
            if w["status"] == "armed" and "due" in spec["condition"] and now >= spec["condition"]["due"]:
                trigger = (spec["condition"]["due"], None)
            if w["status"] in ("awaiting_outcome", "uncertain") and spec.get("outcome") and now > min(expires, w["sent"] + spec["outcome"]["within"]):
                say(name, "outcome_unknown", w["sent"], now)
                continue
            if trigger is None and w["status"] in ("armed", "awaiting_outcome", "uncertain"):
                starts = spec.get("not_before", w["created"])
                for _, key, e in sorted((e["ended"], key, e) for key, e in received.items() if key not in w["marks"]):
                    w["marks"].add(key)
                    if now - e["ended"] > spec.get("max_age", max_age) or e["ended"] < starts:
                        continue
                    if w["status"] == "armed":
                        if "due" in spec["condition"]:
                            continue
                        met = accumulate(spec["condition"], e, w["progress"], starts)
                        if met is not None:
                            trigger = (met, key)
                            break
                    elif spec.get("outcome") and e["started"] >= w["sent"] and accumulate(spec["outcome"]["condition"], e, w["after"], w["sent"]) is not None:
                        say(name, "verified", w["sent"], now, key)
                        break
            if trigger and w["status"] == "armed":
                since, w["met"] = w["progress"].get("start", trigger[0]), trigger[0]
                if now > trigger[0] + spec["respond_within"]:
                    say(name, "missed_deadline", since, now, trigger[1])
                else:
                    say(name, "reserved", since, now, trigger[1])
                    w["sent"] = now if spec.get("device") else None
                    say(name, "sent" if spec.get("device") else "awaiting_delivery", trigger[0], now, trigger[1])

    for now in sorted(instants):
        if now > rows[-1]["at"] + 10**14:
            break
        ask(now)
        for r in [r for r in rows if r["at"] == now]:
            body = json.loads(r["body"]) if r["body"] else {}
            name, w = r["watch"], made.get(r["watch"])
            if r["what"] == "create":
                if w:
                    out.append((name, "repeated" if w["spec"] == body else "conflict", w["created"], now, None))
                else:
                    made[name] = {"spec": body, "created": now, "marks": set(), "progress": {}, "after": {}, "sent": None, "met": None}
                    say(name, "armed", now, now)
            elif r["what"] == "cancel" and w and w["status"] == "armed":
                say(name, "cancelled", w["created"], now)
            elif r["what"] == "event":
                old = received.get(body["id"])
                if old is not None:
                    out.append((None, "repeated" if old == body else "conflict", body["ended"], now, body["id"]))
                else:
                    received[body["id"]] = body
            elif r["what"] == "answer" and w and w["status"] in ("awaiting_delivery", "sent"):
                if not body["ok"]:
                    if w["status"] == "sent":
                        say(name, "uncertain", w["met"], now)
                else:
                    if w["status"] == "awaiting_delivery":
                        w["sent"] = body["delivered"]
                    say(name, "awaiting_outcome" if w["spec"].get("outcome") else "verified", w["met"], now)
            ask(now)
    return out


def test_watches_by_definition(spark, data):
    groups = by_key(services.watch_rows(spark, data))
    want = Counter((u, *r) for u, rows in groups.items() for r in brute_watches(rows, 2 * services.DAY))
    got = Counter(tuple(r) for r in services.watch_service(spark, data).collect())
    assert got == want
    assert {"armed", "expired", "reserved", "awaiting_delivery", "sent", "verified", "awaiting_outcome", "outcome_unknown", "missed_deadline", "cancelled", "repeated", "conflict"} <= {r[2] for r in got}


def test_watches_as_a_stream(spark, data, tmp_path):
    rows = few(services.watch_rows(spark, data), 3)
    batch = Counter(tuple(r) for r in machines.fold(rows, services.watch_machine, watches.Watches.schema).collect())
    got = streamed(spark, tmp_path, rows, services.watch_machine, watches.Watches.schema, 2 * services.DAY, 60 * services.DAY)
    assert got == batch and sum(batch.values()) > 30


def one_watch(*rows, **machine):
    m = watches.Watches({}, **machine)
    return [r[1:4] for r in m.run([[r[0] for r in rows], [r[1] for r in rows], ["w"] * len(rows), [json.dumps(r[2]) for r in rows]]) + m.finish()]


def seen(i, start, end, kind="on", **rest):
    return {"id": f"e{i}", "kind": kind, "started": start, "ended": end, "confidence": 1.0, **rest}


def test_timers_fire_without_a_row():
    wait = {"condition": {"kind": "on"}, "ttl": 100}
    assert one_watch((0, "create", wait)) == [("armed", 0, 0), ("expired", 0, 100)]
    assert one_watch((0, "create", {**wait, "deadline_at": 40})) == [("armed", 0, 0), ("expired", 0, 40)]
    due = {"condition": {"due": 30}, "ttl": 100, "respond_within": 5}
    assert one_watch((0, "create", due)) == [("armed", 0, 0), ("reserved", 30, 30), ("awaiting_delivery", 30, 30)]
    after = {**wait, "device": True, "outcome": {"condition": {"kind": "off"}, "within": 20}}
    rows = [(0, "create", after), (10, "event", seen(1, 9, 10)), (12, "answer", {"ok": True})]
    assert one_watch(*rows) == [("armed", 0, 0), ("reserved", 9, 10), ("sent", 10, 10), ("awaiting_outcome", 10, 12), ("outcome_unknown", 10, 31)]
    assert one_watch(*rows, (25, "event", seen(2, 20, 25, "off")))[-1] == ("verified", 10, 25)
    assert one_watch(*rows, (40, "event", seen(2, 20, 25, "off")))[-1] == ("outcome_unknown", 10, 31)


def test_covered_time_of_a_watch():
    spec = {"condition": {"kind": "on", "needed": 30, "gap": 1, "resets": ["off"]}, "ttl": 1000, "respond_within": 50, "max_age": 500}
    make = (0, "create", spec)
    assert one_watch(make, (20, "event", seen(1, 10, 20)), (45, "event", seen(2, 35, 40)), (70, "event", seen(3, 40, 70)))[1] == ("reserved", 35, 70)  # a gap of 15 begins anew
    assert one_watch(make, (20, "event", seen(1, 1, 20)), (50, "event", seen(2, 20, 50, subjects=["b"])))[1] == ("reserved", 20, 50)  # other subjects begin anew
    assert one_watch(make, (30, "event", seen(1, 1, 30)), (31, "event", seen(2, 30, 31, "off")), (40, "event", seen(3, 31, 40)))[1][0] == "expired"
    assert one_watch(make, (9, "event", seen(1, 50, 60)))[1] == ("future", 60, 9)
    assert one_watch(make, (400, "event", seen(1, 50, 90)))[1][0] == "missed_deadline"
    assert one_watch(make, (700, "event", seen(1, 50, 90)))[1][0] == "expired"  # too old to count


def test_events_before_a_watch_count_once():
    spec = {"condition": {"kind": "on"}, "ttl": 1000, "created": 5, "respond_within": 100, "max_age": 50}
    got = one_watch((8, "event", seen(1, 6, 7)), (9, "event", seen(2, 1, 4)), (10, "create", spec), (11, "event", seen(1, 6, 7)), max_age=50)
    assert got == [("armed", 5, 10), ("reserved", 6, 10), ("awaiting_delivery", 7, 10), ("repeated", 7, 11)]


# any machine


@pytest.mark.parametrize("batches", [3])
def test_segments_as_a_stream(spark, tmp_path, batches):
    rng = random.Random(1)
    rows = [(rng.randrange(3), 10**12 + t * SECOND, i, rng.random()) for i, t in enumerate(range(0, 600, 2))]
    df = spark.createDataFrame(rows, "user_id long, at long, id long, activity double")
    machine = lambda s: machines.Segments(s, 6 * SECOND, 6 * SECOND, 48 * SECOND, 48 * SECOND, 0.5)
    want = Counter(tuple(r) for r in machines.fold(df, machine, machines.Segments.schema).collect())
    assert streamed(spark, tmp_path, df, machine, machines.Segments.schema, 40 * SECOND, 200 * SECOND, batches) == want


# the observer


def brute_observer(rows, ttl, cooldown):
    """Each window looks back over everything that was learnt before it."""
    learnt, taken, reserved, out, done = [], [], [], [], set()
    for r in rows:
        if r["what"] == "fact":
            learnt.append((r["at"], len(learnt), r["entity"], r["value"]))
            continue
        shown, at, name = json.loads(r["value"]), r["at"], r["entity"]
        say = lambda outcome, detail=None: out.append((name, outcome, detail, at))  # noqa: B023, E731
        if name in done:
            say("recorded")
            continue
        done.add(name)
        if any(r["until"] < t for t in taken):
            say("out_of_order")
            continue
        taken.append(r["until"])
        last = {}
        for t, _, entity, value in sorted(learnt):
            last[entity] = (t, value)
        memory = {e: v for e, (t, v) in last.items() if at - t <= ttl}
        if shown["top"] == 98:
            say("rejected", "top_of_98")
            continue
        busy = shown["top"] >= 90
        if busy:
            learnt.append((at, len(learnt), "room", "busy"))
        elif 0.5 + shown["top"] / 200 >= 0.6:
            learnt.append((at, len(learnt), "room", "quiet"))
        say(("act" if "state" in memory else "act_without_state") if busy else "noop", json.dumps(memory, sort_keys=True, separators=(",", ":")))
        if busy:
            action = "light=" + ("on" if shown["top"] % 2 else "off")
            if any(a == action and at - t < cooldown for a, t in reserved):
                say("cooldown", action)
            else:
                reserved.append((action, at))
                say("reserved", action)
            say("satisfied", "room=busy")
    return out


def test_observer_by_definition(spark, data):
    groups = by_key(services.observer_rows(spark, data))
    want = Counter((u, *r) for u, rows in groups.items() for r in brute_observer(rows, 5 * services.DAY, 6 * services.DAY))
    got = Counter(tuple(r) for r in services.observer_loop(spark, data).collect())
    assert got == want
    assert {"noop", "act", "act_without_state", "rejected", "reserved", "cooldown", "satisfied"} <= {r[2] for r in got}


def test_observer_is_the_batch_of_windows(spark, data):
    """Order, memory and decision as observed_windows has them, by joins and windows."""
    decide = lambda shown, memory: {"outcome": ("act" if "state" in memory else "act_without_state") if shown["top"] >= 90 else "noop"}
    rows = machines.fold(services.observer_rows(spark, data), lambda s: services.observers.Observer(s, decide, ttl=5 * services.DAY), services.observers.Observer.schema)
    got = Counter((r.user_id, int(r.window), r.outcome, json.loads(r.detail or "{}").get("state")) for r in rows.collect())
    from tidemark.plans import judgements

    assert got == Counter((r.user_id, r.day, r.outcome, r.prior) for r in judgements.observed_windows(spark, data).collect())


def test_observer_as_a_stream(spark, data, tmp_path):
    rows = few(services.observer_rows(spark, data), 3)
    batch = Counter(tuple(r) for r in machines.fold(rows, services.observer, services.observers.Observer.schema).collect())
    assert streamed(spark, tmp_path, rows, services.observer, services.observers.Observer.schema, 2 * services.DAY, 60 * services.DAY) == batch


def test_observer_refuses_what_goes_back_or_comes_again():
    m = services.observers.Observer({}, lambda shown, memory: {"outcome": "seen", "observations": [["a", "2", 0.5], ["b", "3", 0.7]], "actions": [["b", "3"], ["c", "1"]]}, ttl=100, cooldown=50)
    rows = [(1, "fact", "a", None, "1"), (5, "window", "w1", 6, '{"devices": {"a": "9"}}'), (7, "window", "w2", 4, "{}"), (8, "window", "w1", 6, "{}"), (30, "window", "w3", 40, "{}"), (200, "window", "w4", 210, "{}")]
    got = m.run([list(c) for c in zip(*rows, strict=True)])
    assert got == [
        ("w1", "seen", '{"a":"1"}', 5), ("w1", "satisfied", "b=3", 5), ("w1", "reserved", "c=1", 5), ("w2", "out_of_order", None, 7), ("w1", "recorded", None, 8),
        ("w3", "seen", '{"a":"9","b":"3"}', 30), ("w3", "satisfied", "b=3", 30), ("w3", "cooldown", "c=1", 30), ("w4", "seen", "{}", 200), ("w4", "satisfied", "b=3", 200), ("w4", "reserved", "c=1", 200),
    ]


# commands


def test_commands_as_a_stream(spark, data, tmp_path):
    rows = services.command_rows(spark, data).where("user_id < 30")
    batch = Counter(tuple(r) for r in machines.fold(rows, services.command_machine, services.commands.Commands.schema).collect())
    got = streamed(spark, tmp_path, rows, services.command_machine, services.commands.Commands.schema, 2 * services.DAY, 60 * services.DAY)
    assert got == batch and {r[1] for r in got} >= {"done", "conflict"}


def test_a_command_is_executed_once():
    calls = []
    m = services.commands.Commands({}, lambda body, at: calls.append(body) or f"answer {body}", 100)
    assert m.run([[1, 2, 3, 100], ["x", "x", "y", "x"], ["a", "b", "c", "d"]]) == [("done", "answer a", 1), ("repeated", "answer a", 2), ("conflict", None, 3), ("repeated", "answer a", 100)]
    m = services.commands.Commands(m.s, m.execute, 100)
    assert m.wake() == 101 and m.run([[101], ["y"], ["e"]]) == [("done", "answer e", 101)] and calls == ["a", "e"]
    assert m.tick(300) == [] and m.wake() is None


def test_queue_items_by_hand(spark):
    entries = {1: [("claim", 1), ("complete", 2), ("crash", 1), ("claim", 2), ("complete", 2), ("claim", 1)], 2: [("complete", 1), ("expire", 1), ("claim", 1)], 3: [("claim", 7)], 4: [("claim", 1), ("claim", 2), ("fail", 1)]}
    df = spark.createDataFrame([(k, 10 * i, i, a, o) for k, v in entries.items() for i, (a, o) in enumerate(v)], "user_id long, at long, id long, action string, owner long")
    got = {r.user_id: tuple(r)[1:] for r in machines.fold(df, services.commands.QueueItem, services.commands.QueueItem.schema).collect()}
    assert got == {1: ("complete", None, None, 2, 2), 2: ("expired", None, None, 0, 2), 3: ("processing", 7, 0, 1, 0), 4: ("failed", None, None, 1, 1)}

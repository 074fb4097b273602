"""Each query against its SQL in DuckDB, and machines against what their definition says."""

import json
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals
from tidemark.plans import accounts, audit, catalogue, judgements, lifecycles, scores, services, texts, windows  # each registers its queries
from tidemark.plans.bindings import TABLES
from tidemark.streaming import machines


def rounded(row):
    return tuple(float(f"{x:.9g}") if isinstance(x, float) else str(x) for x in row)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = Counter(rounded(r) for r in df.select(*columns).collect())
    names = ", ".join(f'"{c}"' for c in columns)
    want = Counter(rounded(r) for r in duck.execute(f"SELECT {names} FROM ({catalogue.ORACLE_SQL[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_other_queries_give_rows(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_evidence_by_seconds(spark):
    """Covered time counted second by second."""
    rng = random.Random(7)
    rows = [(u, s := rng.randrange(300), s + rng.randrange(0, 12), i) for u in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id long, started long, ended long, id long")
    got = {r.id + 1000 * r.user_id: (r.since, r.covered) for r in intervals.evidence(df, ["user_id"], 6, ["id"]).collect()}
    for u in range(4):
        seen, reach, since = set(), None, None
        for _, a, b, i in sorted((r for r in rows if r[0] == u), key=lambda r: (r[1], r[2], r[3])):
            if reach is None or a > reach + 6:
                seen, since = set(), a
            seen |= set(range(a, b))
            reach = max(b, reach or b)
            assert got[i + 1000 * u] == (since, len(seen))


def segments_by_definition(frames, pre, post, longest, heartbeat, most):
    """What frames (time, active) give, each rule looked up over all frames anew."""
    times = [t for t, _ in frames]
    memory = lambda i: [j for j in range(max(0, i + 1 - most), i + 1) if times[i] - times[j] <= max(longest, heartbeat, pre)]
    out, last, members, i = [], None, None, 0
    rolled = lambda i: [j for j in memory(i) if times[i] - times[j] <= pre]
    for i, (t, active) in enumerate(frames):
        was_open = members is not None
        if was_open:
            members = [*members, i]
        elif active:
            members = rolled(i)
        if members is None:
            if last is None:
                last = t
            elif t - last >= heartbeat:
                out.append(("periodic_coverage", times[memory(i)[0]], t, len(memory(i))))
                last = t
            continue
        reason = None
        if len(members) >= most or t - times[members[0]] >= longest:
            reason = "activity_segment_limit"
        elif not active and all(not a or t - s >= post for s, a in (frames[j] for j in range(i + 1) if j in members or j < i)):
            reason = "activity_with_pre_post_roll"
        if reason:
            out.append((reason, times[members[0]], t, len(members)))
            last, members = t, rolled(i) if active and reason.endswith("limit") else None
    return [*out, ("source_end", times[members[0]], times[-1], len(members))] if members else out


def in_parts(machine, rows, rng):
    """Through machines that carry their state as JSON from part to part."""
    out, state, i = [], {}, 0
    while i < len(rows):
        m, j = machine(state), i + rng.randrange(1, 9)
        out += m.run([list(c) for c in zip(*rows[i:j], strict=True)])
        i = j
        state = json.loads(json.dumps(m.s))
    return out + machine(state).finish()


def test_segments():
    run = lambda frames, **spec: in_parts(lambda s: machines.Segments(s, threshold=0.5, **spec), frames, random.Random(1))
    spec = {"pre": 1, "post": 1, "longest": 6, "heartbeat": 6}
    assert run([(0, 0), (1, 0), (2, 1), (3, 0), (4, 0), (9, 0)], **spec) == [("activity_with_pre_post_roll", 1, 3, 3), ("periodic_coverage", 3, 9, 3)]
    rng = random.Random(5)
    for _ in range(400):
        spec = {k: rng.randrange(1, 9) for k in ("pre", "post", "longest", "heartbeat", "most")}
        t, frames = 0, []
        for _ in range(rng.randrange(40)):
            t += rng.randrange(1, 4)
            frames.append((t, rng.random() < 0.4))
        assert in_parts(lambda s, x=spec: machines.Segments(s, threshold=0.5, **x), frames, rng) == segments_by_definition(frames, **spec), (spec, frames)


def test_pending_and_uncertain_actions_block():
    rows = [(0, "complete"), (10, "complete"), (11, "uncertain"), (900, "complete")]
    assert [r[1] for r in in_parts(lambda s: machines.Cooldown(s, 10), rows, random.Random(1))] == [0, 11]
    assert [r[1] for r in machines.Cooldown({}, 10).run([[0, 5, 10, 11, 22]])] == [0, 11, 22]


def live(spark, tmp_path, rows, columns, make, schema, **times):
    """The rows as a stream of several micro-batches, then a row of another key far ahead that moves the watermark on."""
    for k in range(4):
        spark.createDataFrame(rows[k::4], columns).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    far = [(-1, 10**12, *rows[0][2:])]
    df = spark.createDataFrame(rows, columns)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = lambda: machines.stream(source, make, schema, **times).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    for k in (8, 9):
        spark.createDataFrame(far, columns).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        run()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("user_id >= 0").collect()))
    assert got == sorted(map(tuple, machines.fold(df, make, schema).collect()))
    return got


def test_streams_give_the_batch_rows(spark, tmp_path):
    """Out of order over micro-batches, with the rows of a key's end."""
    ms = 1000
    rows = [(u, (10_000 + 10 * i + u) * ms, i, float(i % 5 in (0, 1)), "complete") for u in range(3) for i in range(27)]
    columns = "user_id long, at long, id long, activity double, status string"
    make = lambda s: machines.Segments(s, 15 * ms, 15 * ms, 60 * ms, 45 * ms, 0.5)
    got = live(spark, tmp_path / "a", rows, columns, make, machines.Segments.schema, late=500 * ms, idle=100 * ms)
    assert {r[1] for r in got} >= {"activity_with_pre_post_roll", "source_end"}
    live(spark, tmp_path / "b", rows, columns, lambda s: machines.Cooldown(s, 45 * ms), machines.Cooldown.schema, late=500 * ms, idle=100 * ms)


def watch(rows, **spec):
    condition = {"kind": "on", "needed": 10, "gap": 5, "resets": ("off",)}
    spec = {"ttl": 100, "response_deadline": 5, **spec}
    condition = spec.pop("condition", condition)
    rows = [(*row[:3], i, *(row[3:] or (0,))) for i, row in enumerate(rows)]
    return [r[:3] for r in in_parts(lambda s: machines.ResponseWatch(s, condition, **spec), rows, random.Random(len(rows)))]


def test_response_watch_states():
    on = [(0, 0, "x"), (6, 6, "on"), (14, 6, "on")]
    outcome = {"kind": "done", "needed": 0, "gap": 0}
    # 6 seen, then 4 more after a gap of 2: eligible at 12
    assert watch(on) == [("reserved", 0, 12), ("verified", 12, 14)]
    assert watch(on, response_deadline=1) == [("missed_deadline", 0, 14)]
    assert watch(on, respond=lambda now: 1 / 0) == [("reserved", 0, 12), ("uncertain", 12, 14)]
    assert watch(on, notify=True) == [("reserved", 0, 12), ("awaiting_delivery", 12, 14)]
    assert watch([(0, 0, "x"), (100, 90, "on")]) == [("expired", 0, 100)]  # before events are read
    assert watch([(0, 0, "x"), (30, 3, "x")], deadline_at=20) == [("expired", 0, 30)]
    assert watch([(0, 0, "x"), (30, 3, "x")], condition={"due": 28}) == [("reserved", 28, 28), ("verified", 28, 30)]
    assert watch([(0, 0, "x"), (6, 6, "on"), (7, 0, "off"), (14, 6, "on")]) == []  # reset
    assert watch([*on[:2], (14, 6, "on", 3)], max_age=2) == []  # too old
    assert watch(on, not_before=9) == []  # evidence before it does not count
    sent = [("reserved", 0, 12), ("awaiting_outcome", 12, 14)]
    assert watch([*on, (20, 8, "done"), (22, 2, "done")], outcome=outcome, within=10) == [*sent, ("verified", 14, 22)]
    assert watch([*on, (25, 1, "done")], outcome=outcome, within=10) == [*sent, ("outcome_unknown", 14, 25)]
    assert watch([*on, (200, 1, "done")], outcome=outcome, within=500) == [*sent, ("outcome_unknown", 14, 200)]


def test_fold_carries_state_over_batches(spark):
    rows = [(u, 10 * i, i, float(i % 3 == 0)) for u in (1, 2, None) for i in range(50)]
    df = spark.createDataFrame(rows, "user_id long, at long, id long, activity double")
    make = lambda s: machines.Cooldown(s, 45)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in machines.fold(df, make, machines.Cooldown.schema).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter(got) == Counter((u, "reserved", 50 * i, 50 * i, i + 1) for u in (1, 2, None) for i in range(10))


def equals_sql(spark, folder, name, table, df):
    df.write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    rows = got.select(*sorted(got.columns)).collect()
    assert Counter(map(rounded, rows)) == Counter(map(rounded, con.execute(f"SELECT {columns} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()))
    return rows


def test_carried_journal_has_all_turns(spark, tmp_path):
    """A long conversation over several cells, null roles, texts and keys, and null turns."""
    rows = [(1, i, "user" if i % 2 else "assistant", "x" * (i % 5)) for i in range(-3, 1500)]
    rows += [(2, i, None if i % 3 else "system", None) for i in range(9)] + [(2, None, "user", "last"), (None, 5, "user", "a"), (None, 2000, "assistant", "b"), (3, 0, None, "c"), (3, 1, "user", None)]
    got = equals_sql(spark, tmp_path, "carried_journal", "conversations", spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    assert max(r.carried.count(">") for r in got) == 1501


def test_inverted_lists_are_whole(spark, tmp_path):
    """One row of each value, with users of several ranges, below 0 and null among them."""
    users = [*range(-300, 1200, 7), 9, 10, 100, None]
    kinds = ("view", "click")
    events = [(i, f"2024-01-{1 + i % 28:02d} 00:00:00", u, kinds[i % 2], 1.0, f'{{"k": {j}}}') for j in (3, 13) for i, u in enumerate(users)] + [(5000, "2024-01-01 00:00:00", None, "error", 1.0, '{"k": 1}')]
    df = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = equals_sql(spark, tmp_path, "inverted_lists", "events", df.repartition(5))
    assert {r.value for r in got} == {"view:3", "click:3", "error:1"} and len(got) == 3

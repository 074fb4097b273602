import json
import math
import random
from itertools import permutations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import asof, decisions, intervals, matching, projections, rules, scoring, selection
from tidemark.sources import files
from tidemark.streaming import motion


@given(st.dictionaries(st.integers(0, 4), st.lists(st.tuples(st.sampled_from([0.2, 0.5, 0.9]), st.integers(0, 4)), min_size=1, max_size=4, unique_by=lambda x: x[1]), max_size=5))
def test_kuhn_is_largest(edges):
    got = matching.kuhn(edges)
    assert len(set(got.values())) == len(got)
    assert all(any(c == got[t] for _, c in edges[t]) for t in got)
    best = 0
    for order in permutations(edges):
        def grow(i, used):
            if i == len(order):
                return 0
            return max([grow(i + 1, used)] + [1 + grow(i + 1, used | {c}) for _, c in edges[order[i]] if c not in used])

        best = max(best, grow(0, frozenset()))
    assert len(got) == best


def test_merge_and_gaps(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 10, 12), (2, 3, 3), (1, 11, 11)], "user_id long, started long, ended long")
    assert sorted(map(tuple, intervals.merge(df, ["user_id"]).collect())) == [(1, 0, 7, 2), (1, 10, 12, 2), (2, 3, 3, 1)]
    assert list(map(tuple, intervals.gaps(df, ["user_id"]).collect())) == [(1, 7, 10)]


def test_overlap_join_counts_pairs_once(spark):
    a = spark.createDataFrame([(1, 0, 100), (1, 250, 260)], "k long, a0 long, a1 long")
    b = spark.createDataFrame([(1, 5, 95), (1, 100, 120), (1, 255, 255), (2, 0, 9)], "k long, b0 long, b1 long")
    pairs = lambda touching: sorted((r.a0, r.b0) for r in intervals.overlap_join(a, b, "k", ("a0", "a1"), ("b0", "b1"), 10, touching).collect())
    assert pairs(False) == [(0, 5), (250, 255)]
    assert pairs(True) == [(0, 5), (0, 100), (250, 255)]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    n = lambda *x: [F.lit(float(v)) for v in x]
    assert value(S.temporal_iou(*n(0, 4, 2, 6))) == 2 / 6
    assert value(S.temporal_iou(*n(3, 3, 3, 3))) == 1.0
    assert value(S.temporal_iou(*n(4, 3, 0, 9))) == 0.0
    assert value(S.box_iou(n(0, 0, 1, 1), n(0, 0, 1, 0.5))) == 0.5
    assert value(S.normal_token(F.lit("--Ab C!"))) == "ab-c"
    assert value(S.normal_name(F.lit(" A \t b "))) == "a b"
    assert value(S.ratio(F.lit(1), F.lit(0))) is None
    assert value(S.backoff(F.lit(20))) == 256.0


def test_files(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"a": 1}\n\nnonsense\n{"a": 2}\n')
    assert files.jsonl_lenient(spark, str(path), "a long").count() == 2
    lines = files.jsonl_with_lines(spark, str(path), "a long").collect()
    assert len(lines) == 3
    good, bad = files.dead_letters(spark.createDataFrame([(1, []), (2, ["x"])], "a long, violations array<string>"))
    assert (good.count(), bad.count()) == (1, 1)


def test_a_long_augmenting_path_does_not_recurse():
    n = 5_000
    edges = {t: [(1.0, t), (0.5, t + 1)] for t in range(n)}
    edges[n] = [(1.0, 0)]
    assert matching.kuhn(edges) == {**{t: t + 1 for t in range(n)}, n: 0}


def test_kuhn_equals_its_recursive_definition():
    rng = random.Random(4)
    for _ in range(200):
        edges = {t: [(rng.randrange(4) / 4, c) for c in rng.sample(range(8), rng.randrange(1, 6))] for t in range(8)}
        owner = {}

        def place(target, tried):
            for _, c in sorted((-s, c) for s, c in edges[target]):
                if c not in tried:
                    tried.add(c)
                    if c not in owner or place(owner[c], tried):
                        owner[c] = target
                        return True
            return False

        for t in sorted(edges):
            place(t, set())
        assert matching.kuhn(edges) == {t: c for c, t in owner.items()}


def test_greedy_islands_equal_a_scan_of_the_key(spark):
    rng = random.Random(6)
    rows = [(u, rng.choice("ab"), i, rng.randrange(400)) for u in range(3) for i in range(120)]
    want = []
    for u in range(3):
        group = sorted((at, i, s) for k, s, i, at in rows if k == u)
        free = [(at, i) for at, i, s in group if s == "b"]
        for at, i, s in group:
            if s == "a" and free:
                j = min(range(len(free)), key=lambda j: (abs(free[j][0] - at), j))
                if abs(free[j][0] - at) <= 3:
                    want.append((u, i, free[j][1], abs(free.pop(j)[0] - at)))
    df = spark.createDataFrame(rows, "user_id long, side string, id long, at long")
    assert sorted(map(tuple, matching.greedy_nearest(df, "user_id", 3).collect())) == sorted(want)


def test_islands_give_the_matching_of_the_whole_key(spark, data):
    rng = random.Random(8)
    spans = [(i, (i % 3), a := rng.randrange(2_000), a + rng.randrange(1, 30)) for i in range(200)]
    pairs = [(k, i, j, min(b, d) - max(a, c), min(a, c), max(b, d)) for i, k, a, b in spans for j, g, c, d in spans if k == g and i % 2 and j % 2 == 0 and a < d and c < b]
    df = spark.createDataFrame([(*p[:3], float(p[3]), *p[4:]) for p in pairs], "user_id long, target long, candidate long, score double, first long, last long")
    cut = intervals.islands(df, "user_id", "first", "last")
    assert cut.select("user_id", "island").distinct().count() > 6
    assert sorted(map(tuple, matching.bipartite(cut, "user_id", "island").collect())) == sorted(map(tuple, matching.bipartite(df, "user_id").collect()))


def test_string_rules(spark):
    want = {"photo.jpg": ["extension"], "a.JSONL": ["extension"], "a.jpgs": [], "C:\\x": ["path"], "data:x": ["path"], "xdata:": [], "a..b": ["path"], "inBase64": ["path"], "a b": ["space"], "a\nb": ["not_printable", "space"], "é": ["not_printable"], "0f" * 32: [], "0f" * 24: [], "0F" * 24: ["base64"], "0f" * 33: ["base64"], "A=" * 23: [], "x" * 129: ["base64", "long"], "clean": [], "http://x": ["path"]}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.violations for r in rules.violations(df, rules.string_rules("t")).collect()} == want


@pytest.mark.parametrize("linear", [True, False])
def test_exact_percentiles_close_in(spark, linear):
    """Few cells: ties, one value many times, one row, no rows, nulls."""
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", 7.0)] * 500 + [("c", 1.5)] + [("d", float(rng.randrange(4))) for _ in range(400)] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    at = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in scoring.exact_percentiles(df, "k", "x", at, linear, cells=5).collect()}
    assert set(got) == set("abcd")
    for k in got:
        values = sorted(x for key, x in rows if key == k and x is not None)
        for name, p in at.items():
            place = (len(values) - 1) * p
            low = int(place)
            want = values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (place - low) if linear else values[max(0, math.ceil(len(values) * p) - 1)]
            assert got[k][name] == pytest.approx(want), (k, name)


def test_lag_over_ranges(spark):
    rng = random.Random(2)
    places = rng.sample(range(10_000), 300)
    rows = [(rng.choice("ab"), p, rng.randrange(9)) for p in places]
    got = {r.p: (r.before_v, r.before_p2) for r in selection.with_before(spark.createDataFrame(rows, "k string, p long, v long").withColumn("p2", F.col("p")), "k", "p", ["v", "p2"], 64).collect()}
    for k in "ab":
        mine = sorted((p, v) for key, p, v in rows if key == k)
        for i, (p, _) in enumerate(mine):
            assert got[p] == ((mine[i - 1][1], mine[i - 1][0]) if i else (None, None))


def test_event_totals_and_first_fit(spark):
    truth = spark.createDataFrame([(1, "on"), (2, "on"), (3, "off")], "target long, label string")
    guess = spark.createDataFrame([(10, "on", True), (11, "on", True), (12, "on", False), (13, "odd", True)], "candidate long, said string, covered boolean")
    matches = spark.createDataFrame([(1, 12)], "target long, match long")
    got = {r.label: tuple(r)[1:] for r in scoring.event_totals(truth, guess, matches).collect()}
    assert got == {"on": (2, 1, 1, 3, 2, 2, 0.5), "off": (1, 0, 1, 0, 0, 0, 0.0), "odd": (0, 0, 0, 1, 1, 1, None)}
    rng = random.Random(4)
    times = {("t", i): rng.randrange(50) for i in range(30)} | {("c", i): rng.randrange(50) for i in range(30)}
    pairs = [(1, 0, t, times["t", t], c, times["c", c], 0.5) for t in range(30) for c in range(30) if abs(times["t", t] - times["c", c]) < 4]
    free, want = set(range(30)), []
    for t in sorted(range(30), key=lambda i: (times["t", i], i)):
        fits = sorted((times["c", c], c) for _, _, x, _, c, _, _ in pairs if x == t and c in free)
        if fits:
            free.discard(fits[0][1])
            want.append((1, t, fits[0][1], 0.5))
    df = spark.createDataFrame(pairs, "user_id long, island long, target long, l0 long, candidate long, w0 long, score double")
    assert sorted(map(tuple, matching.first_fit(df, "user_id", "island").collect())) == sorted(want)


def moved(frames, **spec):
    """frames: (time, motion[, steady[, problem]]), cut in two places."""
    rows = [(*f, *(True, "")[len(f) - 2 :]) for f in frames]
    out, state = [], {}
    for part in (rows[:2], rows[2:5], rows[5:]):
        m = motion.Motion(state, bound=1, confirm=2, settle=10, ttl=50, **spec)
        out += m.run([list(c) for c in zip(*part, strict=True)]) if part else []
        state = m.s
    return [r[:3] for r in out]


def test_motion():
    still, go = 0, 5
    assert moved([(0, still), (5, go), (10, go), (15, still), (20, still), (25, still)]) == [("motion_started", 0, 10), ("motion_settled", 15, 25)]
    assert moved([(0, still), (5, go), (10, still), (15, go), (20, still)]) == []  # never two in a row
    # a frame that can't be compared makes the still phase begin anew
    assert moved([(0, still), (5, go), (10, go), (15, still), (20, still, False), (25, still), (30, still), (35, still)]) == [("motion_started", 0, 10), ("motion_settled", 25, 35)]
    assert moved([(0, still), (5, go, True, "blurred"), (10, go), (60, go), (70, go)]) == [("visibility_lost", 0, 5), ("expired", 5, 60)]
    assert moved([(0, still), (5, still), (30, go)], pause=20) == [("visibility_lost", 5, 30)]
    assert moved([(0, go), (1, go)]) == [("motion_started", 0, 1)]


def test_leaks_in_json(spark):
    want = {
        '{"message": "ok", "n": [1, true, null, 2.5]}': [], '{"schema_version": "2"}': ["schema_version"], '{"schema_version": "1"}': [], '{"a": {"schema_version": "9"}}': [],
        '{"a": {"message": "two words"}}': ["denied_key"], '{"url": "http://x"}': ["denied_key"], '{"A": "two words"}': ["key_form"], '{"a": NaN}': ["not_json"], "[1": ["not_json"],
        '{"a": ["x y", "/p"]}': ["string_path", "string_space"], "[" * 7 + "1" + "]" * 7: ["depth"], "[" * 6 + "1" + "]" * 6: [], json.dumps(list(range(65))): ["items"], json.dumps({"a": "é"}, ensure_ascii=False): ["string_not_printable"],
        json.dumps(["x" * 100] * 60 + [["y" * 100] * 60] * 2): ["bytes", "string_base64"], '"0f0f0f"': [],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "id long, t string")
    got = {r.id: r.violations for r in decisions.leaks(df, "id", "t", version="1").collect()}
    assert got == dict(enumerate(want.values()))
    assert decisions.leaks(spark.createDataFrame([(1, None)], "id long, t string"), "id", "t").first().violations == []


def test_cells_change_nothing(spark):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), s := rng.randrange(500), s + rng.randrange(30), i) for i in range(160)]
    df = spark.createDataFrame(rows, "k string, started long, ended long, id long")
    for gap in (0, 4):
        whole = sorted(map(tuple, intervals.merge(df, ["k"], gap=gap).collect()))
        assert sorted(map(tuple, intervals.merge(df, ["k"], gap=gap, width=20).collect())) == whole
    right = spark.createDataFrame([(rng.choice("abc"), rng.randrange(500) * 1000 + i, i) for i in range(40)], "k string, seen long, what long")
    left = df.select("k", (F.col("started") * 1000).alias("at"), "id")
    whole = sorted(map(tuple, asof.asof_join(left, right, "k", "at", "seen", ["what"]).collect()), key=str)
    assert sorted(map(tuple, asof.asof_join(left, right, "k", "at", "seen", ["what"], 7000).collect()), key=str) == whole
    best = {r.id: (r.seen, r.what) for r in asof.asof_join(left, right, "k", "at", "seen", ["what"], 7000).collect()}
    seen = [tuple(r) for r in right.collect()]
    for k, s, _, i in rows:
        assert best[i] == max(((t, w) for key, t, w in seen if key == k and t <= s * 1000), default=(None, None))


def test_nested_fields_go(spark):
    schema = "id long, clips array<struct<name: string, path: string, frames: array<struct<t: int, path: string>>>>"
    df = spark.createDataFrame([(1, [("a", "/x", [(1, "/y"), (2, "/z")])]), (2, []), (3, None)], schema)
    got = df.select("id", projections.without_nested(F.col("clips"), ["path"], "frames", ["path"]).alias("clips"))
    assert "path" not in got.schema.simpleString()
    assert [r.clips and [(c["name"], [f.t for f in c.frames]) for c in r.clips] for r in got.orderBy("id").collect()] == [[("a", [1, 2])], [], None]


def test_redaction(spark):
    texts = ["use sk-abcdef123456 now", "password: hunter2 and more", "Authorization: Bearer abc.def x", "authorization=xyz", "a bearer qq1 here", "api_key = k1, token:t2", "the token ring, a secretary", "tokens hf_abcdefghij", None, ""]
    want = ["use [redacted] now", "password: [redacted] and more", "Authorization: Bearer [redacted] x", "authorization=[redacted]", "a bearer [redacted] here", "api_key = [redacted] token:[redacted]", "the token ring, a secretary", "tokens [redacted]", None, ""]
    df = spark.createDataFrame([(i, t, None if t is None else json.dumps({"a": [t, {"Authorization": "x", "deep": {"api-key": {"k": 1}, "path": 2, "b": t}}], "path": 1})) for i, t in enumerate(texts)], "i int, t string, j string")
    got = df.select("i", projections.redacted_text(F.col("t")).alias("t"), projections.redacted(F.col("j"), ("path",)).alias("j"), projections.redacted(F.col("t")).alias("plain")).orderBy("i").collect()
    assert [r.t for r in got] == want and [r.plain for r in got] == want
    for r, w in zip(got, want, strict=True):
        assert r.j is None if w is None else json.loads(r.j) == {"a": [w, {"Authorization": "[redacted]", "deep": {"api-key": "[redacted]", "b": w}}]}
    states = spark.createDataFrame([("true", "on"), ('{"state":"Off"}', "off"), ('"idle"', "idle"), ("0", "off")], "raw string, want string")
    assert states.where(projections.state_text(F.col("raw")) != F.col("want")).count() == 0
    assert states.where(projections.state_text(projections.encoded_state(F.col("want"))) != F.col("want")).count() == 0


def test_identifiers_and_f1(spark):
    good = {"track": "phys_a-B_1", "made_track": "phys_" + "0" * 32, "event": "pevt_x", "made_event": "pevt_" + "f" * 32, "verification": "pver_" + "a" * 32, "export": "export_" + "1" * 32, "delivery": "delivery_" + "2" * 32, "audit": "audit_" + "3" * 24, "digest": "4" * 64, "token": "a_b-9", "name": "A.b:c-d"}
    bad = {"track": "phys_", "made_track": "phys_" + "G" * 32, "event": "xpevt_x", "made_event": "pevt_" + "f" * 33, "verification": "pver_a\n", "export": "export_" + "1" * 31, "delivery": "delivery", "audit": "audit_" + "3" * 25, "digest": "4" * 63, "token": "9a", "name": ".a"}
    df = spark.createDataFrame([(good[k], bad[k], k) for k in S.IDENTIFIERS], "good string, bad string, form string")
    for form in S.IDENTIFIERS:
        r = df.where(F.col("form") == form).select(S.is_identifier(form, F.col("good")), S.is_identifier(form, F.col("bad")), S.is_identifier(form, F.concat("good", F.lit("\n"))), S.is_identifier(form, F.lit(None).cast("string"))).first()
        assert tuple(r) == (True, False, False, False), form
    df = spark.createDataFrame([("a", False, ["x", "y"], ["x", "z"]), ("b", False, ["x"], []), ("c", True, ["x"], ["x"]), ("d", False, [], [])], "k string, failed boolean, expected array<string>, actual array<string>")
    got = {r.k: (r.precision, r.recall, r.f1) for r in scoring.set_summary(df, ["k"]).collect()}
    assert got == {"a": (0.5, 0.5, 0.5), "b": (None, 0.0, 0.0), "c": (None, 0.0, 0.0), "d": (None, None, 0.0)}


def test_the_latest_of_nothing(spark):
    """Counts and maxima over an empty table: no row by group, and one row with 0 and null without."""
    empty = spark.createDataFrame([], "k string, at long")
    assert empty.groupBy("k").agg(F.max("at")).count() == 0
    assert tuple(empty.agg(F.count("*"), F.coalesce(F.max("at"), F.lit(-math.inf))).first()) == (0, -math.inf)
    assert asof.latest_by(empty, ["k"], ["at"]).count() == 0

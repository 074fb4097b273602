"""Running folds by ranges, and what is built on them: the same rows whatever the ranges, one key with all rows among them."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, audits, intervals, lifecycle, linking, matching, prefix, sampling, scoring
from tidemark.sources import files


def rows_of(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def events(spark):
    """Keys of very unequal size: one has most rows; times repeat; values are null now and then."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        start = rng.randrange(2000)
        rows.append((rng.choice((1, 1, 1, 1, 2, 3)), start, start + rng.randrange(40), i, rng.choice((None, *range(9))), rng.choice("ab")))
    return spark.createDataFrame(rows, "user_id long, started long, ended long, id long, v long, kind string").repartition(5)


def only(events, one):
    return events.withColumn("user_id", F.lit(1).cast("long")) if one else events


@pytest.mark.parametrize("one", [False, True])
def test_running_folds(events, one):
    df, order = only(events, one), ["started", "id"]
    values = {"s": ("sum", "v"), "m": ("max", "v"), "n": ("min", F.col("v") + 1), "l": ("last", "v"), "sb": ("sum", "v"), "lb": ("last", "v"), "mb": ("max", "v")}
    before = ["sb", "lb", "mb"]
    w = Window.partitionBy("user_id").orderBy(*order)
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True)
    want = rows_of(df.withColumns({"s": F.sum("v").over(upto), "m": F.max("v").over(upto), "n": F.min(F.col("v") + 1).over(upto), "l": last("v").over(upto), "sb": F.sum("v").over(past), "lb": last("v").over(past), "mb": F.max("v").over(past)}))
    for cell in (None, prefix.cell_of("started", 7), prefix.cell_of("started", 300), prefix.even_cells(df, "started", 16)):
        assert rows_of(prefix.running(df, ["user_id"], order, values, cell, before)) == want


def test_even_cells_are_even(spark):
    df = spark.range(10_000).select((F.col("id") * F.col("id")).alias("x"))
    sizes = [r.n for r in df.groupBy(prefix.even_cells(df, "x", 20).alias("c")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 20 and max(sizes) < 600
    assert prefix.even_cells(df.limit(0), "x", 20) is not None


@pytest.mark.parametrize("one,width", [(True, 13), (False, 500)])
def test_operators_by_cells(spark, events, one, width):
    df, key = only(events, one), "user_id"
    sides = df.select(key, F.when(F.col("kind") == "a", "a").otherwise("b").alias("side"), "id", F.col("started").alias("at"))
    jobs = df.select(key, "id", F.col("started").alias("arrived"), (F.col("ended") - F.col("started")).alias("work"))
    reports = df.where("kind = 'b'").select(key, "id", F.col("started").alias("at"), (F.col("ended") + 30).alias("seen"))
    frames = df.where("kind = 'a'").select(key, F.col("started").alias("t"))
    spans = df.groupBy(key).agg((F.min("started") + 5).alias("a"), (F.max("ended") - 5).alias("b")).unionByName(spark.createDataFrame([(99, 0, 10)], "user_id long, a long, b long"))
    holes = df.where("id % 9 = 0")
    each = {
        "merge": lambda w: intervals.merge(df, [key], gap=2, width=w),
        "gaps": lambda w: intervals.gaps(holes, [key], width=w),
        "subtract": lambda w: intervals.subtract(spans, holes, key, ("a", "b"), ("started", "ended"), w),
        "evidence": lambda w: intervals.evidence(df, [key], 3, ["id"], width=w),
        "islands": lambda w: intervals.islands(df, key, "started", "ended", w).drop("island"),
        "streaks": lambda w: scoring.streaks(df, key, F.coalesce(F.col("v") > 3, F.lit(False)), ["started", "id"], 2, w),
        "fifo": lambda w: scoring.fifo(jobs, key, ["arrived", "id"], w),
        "switches": lambda w: scoring.identity_switches(df, key, "v", ["started", "id"], w),
        "greedy": lambda w: matching.greedy_nearest(sides, key, 4, w),
        "transitions": lambda w: lifecycle.transitions(df.select(key, F.col("id").alias("seq"), "kind"), key, ["seq"], "kind", ["zz"], {"a": "c"}, w),
        "policies": lambda w: lifecycle.lateness_policies(df.withColumn("now", F.col("started") + 10), key, ["id"], "ended", "now", 5, w),
        "late": lambda w: lifecycle.late_reconciled(frames.distinct(), reports, key, 3, w),
        "asof": lambda w: asof.asof_join(df.select(key, "id", "started"), frames.distinct(), key, "started", "t", [], w),
    }
    for name, run in each.items():
        assert rows_of(run(width)) == rows_of(run(None)), name


def test_budget_by_cells(spark, events):
    df = events.where("v is not null").dropDuplicates(["user_id", "started"])
    run = lambda cell: rows_of(asof.budget_prefix(df, ["user_id"], [F.desc("started")], F.col("v"), 100, cell))
    assert run(-F.floor(F.col("started") / F.lit(50))) == run(None)


def test_subtract_by_definition(spark):
    windows = spark.createDataFrame([(1, 0, 10), (2, 0, 10), (3, 5, 6)], "user_id long, a long, b long")
    holes = spark.createDataFrame([(1, -5, 2), (1, 4, 6), (1, 5, 7), (2, 0, 10), (4, 0, 1)], "user_id long, s long, e long")
    for width in (None, 3):
        assert sorted(map(tuple, intervals.subtract(windows, holes, "user_id", ("a", "b"), ("s", "e"), width).collect())) == [(1, 2, 4), (1, 7, 10), (3, 5, 6)]


def test_zip_by_place(spark):
    left = spark.createDataFrame([(30, "c"), (10, "a"), (20, None)], "x long, name string").repartition(3)
    right = spark.createDataFrame([(0.5, 7), (2.5, 9), (1.5, 8)], "y double, n long")
    assert sorted(map(tuple, linking.zipped(left, ["x"], right, ["y"]).select("position", "x", "name", "n").collect())) == [(0, 10, "a", 7), (1, 20, None, 8), (2, 30, "c", 9)]
    with pytest.raises(ValueError, match="3 rows can't be zipped with 2"):
        linking.zipped(left, ["x"], right.limit(2), ["y"])
    assert linking.zipped(left.limit(0), ["x"], right.limit(0), ["y"]).count() == 0
    big = spark.range(5000).select((F.col("id") * 3).alias("x"), F.col("id").alias("want"))
    assert prefix.positions(big.repartition(7), ["x"], 16).where("position <> want").count() == 0


def test_inverted_lists_in_chunks(spark):
    df = spark.createDataFrame([(i, ["all"] + (["odd"] if i % 2 else [])) for i in (0, 1, 2, 9, 10, 11)], "k long, v array<string>")
    got = {(r.value, r.chunk): (r.n, r["keys"]) for r in linking.inverted(df, "k", F.col("v"), 10).collect()}
    assert got == {("all", 0): (4, "0,1,2,9"), ("all", 1): (2, "10,11"), ("odd", 0): (2, "1,9"), ("odd", 1): (1, "11")}


@pytest.mark.parametrize("cells", [1, 16])
def test_percentiles_of_many_keys(spark, cells):
    rng = random.Random(cells)
    rows = [(i % 150, rng.choice((1.0, 2.0, rng.random() * 10 ** rng.randrange(-3, 6)))) for i in range(1500)] + [(7, rng.gauss(0, 1)) for _ in range(1500)] + [(151, 5.0), (152, None), (None, 1.0), (153, float("nan")), (153, 3.0)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(4)
    values = {}
    for k, x in rows:
        if k is not None and x is not None and x == x:
            values.setdefault(k, []).append(x)
    at = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    nearest = {r.k: tuple(r)[1:] for r in scoring.exact_percentiles(df, "k", "x", at, linear=False, cells=cells).collect()}
    linear = {r.k: tuple(r)[1:] for r in scoring.exact_percentiles(df, "k", "x", at, linear=True, cells=cells).collect()}
    assert set(nearest) == set(linear) == set(values)
    for k, v in values.items():
        v.sort()
        want = [v[max(1, -int(-len(v) * p // 1)) - 1] for p in at.values()]
        assert list(nearest[k]) == want, k
        place = [(len(v) - 1) * p for p in at.values()]
        assert linear[k] == pytest.approx([v[int(i)] + (v[min(int(i) + 1, len(v) - 1)] - v[int(i)]) * (i - int(i)) for i in place]), k
        assert linear[k][2] == pytest.approx(statistics.median(v))
    assert scoring.exact_percentiles(df.limit(0), "k", "x", at, linear=True).count() == 0


def test_lines_of_split_files(spark, tmp_path):
    """Files cut into many splits: every line keeps its number, with long, empty and Windows lines."""
    rng = random.Random(3)
    wants = Counter()
    for name in "ab":
        lines = [rng.choice(("", "x" * rng.randrange(300), "é" * rng.randrange(50), "z\r")) for _ in range(400)]
        (tmp_path / f"{name}.txt").write_bytes("\n".join(lines).encode() + b"\n")
        wants.update((name, i, line.rstrip("\r")) for i, line in enumerate(lines, 1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = files.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
        got = Counter((r.file[-5], r.line, r.value) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == wants


def test_evidence_places(spark):
    """By the definition with room: ends, then peaks with their neighbours, then the grid, each while there is room."""

    def by_room(a, most):
        n, chosen = len(a), []
        if n <= most:
            return list(range(n))

        def add(place):
            if place not in chosen and len(chosen) < most:
                chosen.append(place)

        add(0), add(n - 1)
        strength = {i: a[i] for i in range(1, n - 1) if a[i] is not None and a[i] > 0}
        while strength and len(chosen) < most:
            top = max(strength.values())
            peak = min(i for i, x in strength.items() if x == top)
            del strength[peak]
            add(peak), add(peak - 1), add(peak + 1)
        for j in range(most):
            add(round(j * (n - 1) / (most - 1)))
        return sorted(chosen)

    rng = random.Random(1)
    for most in (2, 5, 8):
        rows = [[rng.choice([0.0, 0.0, None, float("nan"), 0.5, rng.random()]) for _ in range(rng.randrange(0, 40))] for _ in range(60)] + [[0.0] * 9, [0, 0, 5.0, 0, 0, 0, 9.0, 0, 0, 0]]
        df = spark.createDataFrame([(i, [float(x) if x is not None else None for x in a]) for i, a in enumerate(rows)] + [(999, None)], "i int, a array<double>")
        got = {r.i: r.x for r in df.select("i", sampling.evidence_places(F.col("a"), most).alias("x")).collect()}
        assert got.pop(999) is None
        assert got == {i: by_room(a, most) for i, a in enumerate(rows)}
    with pytest.raises(ValueError):
        sampling.evidence_places(F.col("a"), 1)


def test_coverage_by_definition(spark):
    """Against counting every unit of time."""
    rng = random.Random(8)
    recordings, tiles, want = [], [], {}
    for r in range(40):
        r0, r1 = 100, 100 + rng.randrange(1, 30)
        recordings.append((r, r0, r1))
        cuts = sorted({r0, r1, *(rng.randrange(r0, r1 + 1) for _ in range(3))})
        own = [[a, b] for a, b in zip(cuts, cuts[1:], strict=False)]
        if r % 2:
            for _ in range(2):
                own[rng.randrange(len(own))][rng.randrange(2)] += rng.randrange(-4, 5)
        if r % 5 == 3:
            rng.shuffle(own)
        if r == 38:
            own = []
        tiles += [(r, i, a, b) for i, (a, b) in enumerate(own)]
        depth = Counter(t for a, b in own for t in range(a, b))
        inside = [depth[t] for t in range(r0, r1)]
        outside = sum(a < r0 or b > r1 or a >= b for a, b in own)
        unordered = sum(own[i][0] < own[i - 1][1] for i in range(1, len(own)))
        figures = (len(own), sum(d > 0 for d in inside), sum(d == 0 for d in inside), sum(d - 1 for d in inside if d > 1), outside, unordered)
        want[r] = (*figures, bool(own) and not any(figures[2:]))
    a = spark.createDataFrame(recordings, "rec long, r0 long, r1 long")
    b = spark.createDataFrame(tiles, "rec long, position long, c0 long, c1 long")
    for width in (None, 7):
        assert {x.rec: tuple(x)[1:] for x in audits.coverage(a, b, "rec", width).collect()} == want
    assert sum(v[-1] for v in want.values()) > 10


def test_quiet_and_citations(spark):
    windows = spark.createDataFrame([(1, 0, 0, 10, True, True), (1, 1, 10, 20, True, True), (1, 2, 20, 30, False, True), (1, 3, 30, 40, True, False), (1, 4, 40, 50, False, True)], "rec long, window long, w0 long, w1 long, quiet boolean, whole boolean")
    labels = spark.createDataFrame([(1, 12, 13), (1, 25, 45)], "rec long, l0 long, l1 long").where("l0 < 20 or l1 > 0")
    got = {r.window: r.wrong for r in audits.quiet(windows, labels.where("l0 <> 25"), "rec", 10).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True, 4: True}
    evidence = spark.createDataFrame([("a", 5), ("b", 8), ("c", 20)], "name string, t long")
    events = spark.createDataFrame([(1, 6, 9, "a", "b"), (2, 4, 9, "a", "b"), (3, 6, 9, "a", "c"), (4, 6, 9, "a", "x"), (5, 6, 9, None, "b"), (6, 5, 9, "a", "a")], "id long, started long, ended long, pre string, post string")
    assert {r.id: r.wrong for r in audits.citations(events, evidence).collect()} == {1: False, 2: True, 3: True, 4: True, 5: True, 6: True}

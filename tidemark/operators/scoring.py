"""Evaluation: set summaries, calibration, identity switches, rates, load figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import f1, ratio
from tidemark.operators.prefix import cell_of, even_cells, running


def set_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows (keys, failed, expected, actual): true and false positives, false negatives, precision, recall, f1. A
    failed row has no true positives and misses all it should have, but what it predicted still counts."""
    hit, extra, missed = F.size(F.array_intersect("expected", "actual")), F.size(F.array_except("actual", "expected")), F.size(F.array_except("expected", "actual"))
    counted = rows.select(*keys, "failed", F.when(F.col("failed"), 0).otherwise(hit).alias("tp"), extra.alias("fp"), F.when(F.col("failed"), F.size("expected")).otherwise(missed).alias("fn"))
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    summed = counted.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if("failed").alias("failed"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))
    return summed.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def calibration(rows: DataFrame, p: str, y: str) -> DataFrame:
    """n, Brier score, and expected calibration error over ten equal bins."""
    bins = rows.groupBy(F.least(F.floor(F.col(p) * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("se"))
    n = F.sum("n")
    return bins.agg(n.alias("n"), (F.sum("se") / n).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / n).alias("ece"))


def identity_switches(rows: DataFrame, key: str, identity: str, order: Sequence[str], width: int | None = None) -> DataFrame:
    """How often the identity differs from the last known one; rows without one are passed over."""
    known = running(rows.where(F.col(identity).isNotNull()), [key], order, {"_before": ("last", identity)}, cell_of(order[0], width), before=["_before"])
    return known.groupBy(key).agg(F.count("*").alias("matches"), F.count_if(F.col("_before") != F.col(identity)).alias("switches"))


def known_labels(rows: DataFrame, keys: Sequence[str], label: str, guess: str) -> DataFrame:
    right = F.count_if(F.col(guess) == F.col(label))
    return rows.groupBy(*keys).agg(F.count("*").alias("known"), right.alias("correct"), F.count_if(F.col(guess) != F.col(label)).alias("incorrect"), F.count_if(F.col(guess).isNull()).alias("missing"), ratio(right, F.count("*")).alias("accuracy"))


def events_per_hour(false: DataFrame, covered: DataFrame) -> DataFrame:
    """False events by hours covered; null unless every interval is whole and some time is covered."""
    hours = covered.agg((F.sum(F.col("ended") - F.col("started")) / 3_600_000_000.0).alias("covered_hours"), F.bool_and(F.col("ended") >= F.col("started")).alias("whole"))
    both = false.agg(F.count("*").alias("false_events")).join(hours, F.lit(True))  # one row each
    return both.select("false_events", "covered_hours", F.when(F.col("whole") & (F.col("covered_hours") > 0), F.col("false_events") / F.col("covered_hours")).alias("per_hour"))


def streaks(rows: DataFrame, key: str, moving: Column, order: Sequence[str], least: int, width: int | None = None) -> DataFrame:
    """Runs of at least so many consecutive moving rows: when they began and ended, and their length. width, here and below: of
    the cells that a key is cut into along its first order column (see prefix)."""
    islands = running(rows.withColumn("_moving", moving), [key], order, {"_island": ("sum", F.when(F.col("_moving"), 0).otherwise(1))}, cell_of(order[0], width))
    runs = islands.where("_moving").groupBy(key, "_island").agg(F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("_island")


def fifo(rows: DataFrame, key: str, order: Sequence[str], width: int | None = None) -> DataFrame:
    """When each job of a single-server queue begins and is done. begin_i = max(arrived_i, done_(i-1)) unrolls to a
    running maximum of arrived - work before it, so two running folds do what looks like a recursion."""
    cell = cell_of(order[0], width)
    run = running(rows, [key], order, {"_total": ("sum", "work")}, cell)
    run = running(run, [key], order, {"_slack": ("max", F.col("arrived") - (F.col("_total") - F.col("work")))}, cell)
    done = F.col("_slack") + F.col("_total")
    return run.select(key, "id", "arrived", (done - F.col("work")).alias("begun"), done.alias("done"))


def agreement(days: DataFrame) -> DataFrame:
    """Totals and rates over (truth, pushes, kinds) by day; rates over nothing count as over one."""
    s = days.agg(F.sum("truth").alias("truth"), F.sum("pushes").alias("pushes"), F.sum(F.least("truth", "pushes")).alias("matched"), F.sum(F.least("truth", "pushes", "kinds")).alias("ka"), F.count_if(F.col("truth") == 0).alias("quiet"), F.count_if((F.col("truth") == 0) & (F.col("pushes") == 0)).alias("silent"))
    rate = lambda n, d: F.round(n / F.greatest(F.lit(1), d), 3)
    c = F.col
    return s.select("truth", "pushes", "matched", rate(c("silent"), c("quiet")).alias("silence"), rate(c("matched"), c("pushes")).alias("precision"), rate(c("matched"), c("truth")).alias("recall"), rate(c("ka"), c("truth")).alias("kind_recall"), rate(2 * c("matched"), c("truth") + c("pushes")).alias("agreement"))


def load_summary(rows: DataFrame, key: str) -> DataFrame:
    order = F.struct("started", "id")
    days = (F.max("ended") - F.min("started")) / 86_400_000_000.0
    figures = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("started").alias("first_at"), F.max("started").alias("last_at"), F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"), ratio(F.count("*"), days).alias("per_day"), F.bool_and(F.col("k") < 100).alias("pace_kept"))
    return figures.join(exact_percentiles(rows, key, "k", {"p50": 0.5, "p95": 0.95}, linear=True), key)


def event_totals(truth: DataFrame, guess: DataFrame, matches: DataFrame) -> DataFrame:
    """(label, labelled, matched, missing, predicted, unsupported, false_covered, recall) for each label: truth (target, label),
    guess (candidate, said, covered), matches (target, match). What matches nothing is unsupported, and false
    only where the labels are known to be complete (covered)."""
    hit = matches.select(F.col("target"), F.col("match").alias("candidate"))
    labels = truth.join(hit.select("target", F.lit(1).alias("_hit")), "target", "left").groupBy("label").agg(F.count("*").alias("labelled"), F.count("_hit").alias("matched"))
    alone = F.col("_hit").isNull()
    said = guess.join(hit.select("candidate", F.lit(1).alias("_hit")), "candidate", "left").groupBy(F.col("said").alias("label")).agg(F.count("*").alias("predicted"), F.count_if(alone).alias("unsupported"), F.count_if(alone & F.col("covered")).alias("false_covered"))
    both = labels.join(said, "label", "full").na.fill(0)
    return both.select("label", "labelled", "matched", (F.col("labelled") - F.col("matched")).alias("missing"), "predicted", "unsupported", "false_covered", ratio(F.col("matched"), F.col("labelled")).alias("recall"))


def exact_percentiles(df: DataFrame, key: str, column: str, at: dict[str, float], linear: bool, cells: int = 64) -> DataFrame:
    """(key, names of `at`): exact percentiles of each key's values, by nearest rank (ceil(n p)) or with linear interpolation
    at (n - 1) p, for any number of keys, without a buffer of a key's values. Rows without key or value don't count.

    Values are cut into cells of about equally many rows of all keys together (cells - 1 approximate quantiles are all that goes to the driver). Counts by
    key and cell say in which cell each rank lies; only the rows of those cells go on, as counts of distinct values, and are put in
    order cell by cell. So a key with a third of all rows is never in one task, and what a rank costs is its cell."""
    x = F.col(column).cast("double")
    rows = df.where(F.col(key).isNotNull() & x.isNotNull() & ~F.isnan(x)).select(F.col(key).alias("_k"), x.alias("_x"))
    rows = rows.withColumn("_cell", even_cells(rows, "_x", cells))
    counted = rows.groupBy("_k", "_cell").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy("_k")
    so_far = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumns({"_n": F.sum("_c").over(whole), "_before": F.coalesce(F.sum("_c").over(so_far), F.lit(0))})
    ranks = []
    for name, p in at.items():
        place = (F.col("_n") - 1) * F.lit(p) if linear else F.greatest(F.ceil(F.col("_n") * F.lit(p)), F.lit(1)) - 1
        for side in (0, 1) if linear else (0,):
            rank = F.least((F.floor(place) + side).cast("long"), F.col("_n") - 1)
            ranks.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.alias("rank"), (place - F.floor(place)).cast("double").alias("share")))
    within = F.filter(F.array(*ranks), lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_c")))
    wanted = counted.select("_k", "_cell", "_before", within.alias("_ranks")).where(F.size("_ranks") > 0)
    values = rows.join(wanted, ["_k", "_cell"]).groupBy("_k", "_cell", "_before", "_ranks", "_x").agg(F.count("*").alias("_c"))
    until = F.col("_before") + F.sum("_c").over(Window.partitionBy("_k", "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    hit = F.filter("_ranks", lambda r: (r["rank"] < F.col("_until")) & (r["rank"] >= F.col("_until") - F.col("_c")))
    found = values.withColumn("_until", until).select("_k", "_x", F.explode(hit).alias("r")).select("_k", "_x", "r.*")
    side = lambda name, i: F.max(F.when((F.col("name") == name) & (F.col("side") == i), F.col("_x")))
    share = lambda name: F.max(F.when(F.col("name") == name, F.col("share")))
    return found.groupBy(F.col("_k").alias(key)).agg(*[(side(n, 0) + (side(n, 1) - side(n, 0)) * share(n)).alias(n) if linear else side(n, 0).alias(n) for n in at])

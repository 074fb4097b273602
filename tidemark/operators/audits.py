"""Audits of a whole dataset: that each recording is covered once and in order, that quiet windows are quiet, that citations are causal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import overlap_join
from tidemark.operators.prefix import cell_of, running


def coverage(recordings: DataFrame, intervals: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """(key, intervals, covered, holes, excess, outside, unordered, once) for each recording (key, r0, r1; keys not null) and its intervals (key, position,
    c0, c1).

    A sweep over the times at which something opens or closes counts how often the time up to the next one is covered: time that isn't
    is a hole, time that is covered n times is n - 1 times in excess, within the recording. outside: intervals that leave
    the recording or have no length; unordered: intervals that begin before the one at the position before ends. once: none of these.
    width: of the cells that a recording's time is swept in."""
    bounds = recordings.select(key, F.explode(F.array("r0", "r1")).alias("t"), F.lit(0).alias("step"))
    valid = intervals.where("c0 < c1")
    edges = valid.select(key, F.explode(F.array(F.struct(F.col("c0").alias("t"), F.lit(1).alias("step")), F.struct(F.col("c1").alias("t"), F.lit(-1).alias("step")))).alias("e")).select(key, "e.*")
    times = bounds.unionByName(edges).groupBy(key, "t").agg(F.sum("step").alias("step"))
    swept = running(times, [key], ["t"], {"depth": ("sum", "step"), "since": ("last", "t")}, cell_of("t", width), before=["depth", "since"])
    parts = swept.where("since is not null").join(recordings.select(key, "r0", "r1"), key)
    length = F.greatest(F.lit(0), F.least("t", "r1") - F.greatest("since", "r0"))
    swept = parts.groupBy(key).agg(
        F.sum(F.when(F.col("depth") > 0, length).otherwise(0)).alias("covered"), F.sum(F.when(F.col("depth") == 0, length).otherwise(0)).alias("holes"),
        F.sum(F.when(F.col("depth") > 1, (F.col("depth") - 1) * length).otherwise(0)).alias("excess"),
    )
    placed = running(intervals, [key], ["position"], {"_before": ("last", "c1")}, cell_of("position", 1 << 20 if width else None), before=["_before"])
    placed = placed.join(recordings.select(key, "r0", "r1"), key)
    wrong = (F.col("c0") < F.col("r0")) | (F.col("c1") > F.col("r1")) | (F.col("c0") >= F.col("c1"))
    figures = placed.groupBy(key).agg(F.count("*").alias("intervals"), F.count_if(wrong).alias("outside"), F.count_if(F.col("c0") < F.col("_before")).alias("unordered"))
    rows = recordings.select(key).join(swept, key, "left").join(figures, key, "left")
    rows = rows.select(key, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("intervals", "covered", "holes", "excess", "outside", "unordered")))
    return rows.withColumn("once", (F.col("holes") + F.col("excess") + F.col("outside") + F.col("unordered") == 0) & (F.col("intervals") > 0))


def quiet(windows: DataFrame, labels: DataFrame, key: str, bucket: int) -> DataFrame:
    """windows (key, window, w0, w1, quiet: what is claimed, whole: whether it is fully covered) with `wrong`: a claim that differs from what the
    overlapping labels (key, l0, l1) say, or a quiet window that isn't covered as a whole."""
    busy = overlap_join(windows.select(key, "window", "w0", "w1"), labels.select(key, "l0", "l1"), key, ("w0", "w1"), ("l0", "l1"), bucket, touching=False)
    rows = windows.join(busy.select(key, "window").distinct().withColumn("_busy", F.lit(True)), [key, "window"], "left")
    return rows.withColumn("wrong", (F.col("quiet") == F.col("_busy").isNotNull()) | (F.col("quiet") & ~F.col("whole"))).drop("_busy")


def citations(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """events (id, started, ended, pre, post: names of evidence) with `wrong`: each must cite two different pieces of evidence (name, t) that exist, one from
    no later than its beginning, the other from after that and no later than its end."""
    a = evidence.select(F.col("name").alias("pre"), F.col("t").alias("_pre"))
    b = evidence.select(F.col("name").alias("post"), F.col("t").alias("_post"))
    rows = events.join(a, "pre", "left").join(b, "post", "left")
    causal = (F.col("_pre") <= F.col("started")) & (F.col("started") < F.col("_post")) & (F.col("_post") <= F.col("ended"))
    return rows.withColumn("wrong", ~F.coalesce(causal, F.lit(False))).drop("_pre", "_post")

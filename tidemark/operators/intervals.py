"""Interval algebra: merge, subtract, overlap joins. Times are integers; intervals are closed unless said."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prefix import cell_of, running


def merge(df: DataFrame, keys: Sequence[str], start: str = "started", end: str = "ended", gap: int = 0, width: int | None = None) -> DataFrame:
    """(keys, start, end, n): the union of each key's intervals; those at most gap apart become one.

    With width, here and below, a key's time is cut into cells of it (see prefix), so that a key with any number of rows is
    sorted cell by cell; keys must not be null then."""
    rows = _islands(df, keys, start, end, gap, width)
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def _islands(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int, width: int | None, ties: Sequence[str] = ()) -> DataFrame:
    """df with _reach (how far the intervals before reach), _new and _island."""
    order, cell = [start, end, *ties], cell_of(start, width)
    rows = running(df, keys, order, {"_reach": ("max", end)}, cell, before=["_reach"])
    rows = rows.withColumn("_new", F.when(F.col(start) > F.col("_reach") + gap, 1).otherwise(0))
    return running(rows, keys, order, {"_island": ("sum", "_new")}, cell)


def islands(df: DataFrame, key: str, start: str, end: str, width: int | None = None) -> DataFrame:
    """df with `island`: a number, for each key, of the run of rows whose open intervals overlap in a chain."""
    return _islands(df, [key], start, end, -1, width).withColumnRenamed("_island", "island").drop("_new", "_reach")


def evidence(df: DataFrame, keys: Sequence[str], gap: int, ties: Sequence[str], start: str = "started", end: str = "ended", width: int | None = None) -> DataFrame:
    """df with `episode` (a run of intervals at most gap apart), since (its beginning) and covered: how much time the
    episode's intervals cover up to and with this one. Gaps are bridged, but not counted."""
    rows = _islands(df, keys, start, end, gap, width, ties).withColumnRenamed("_island", "episode")
    order, cell = [start, end, *ties], cell_of(start, width)
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(start, F.coalesce("_reach", start)))
    rows = running(rows.withColumn("_fresh", fresh), keys, order, {"_total": ("sum", "_fresh")}, cell)
    first = (F.col("_new") == 1) | F.col("_reach").isNull()
    # what was covered when the episode began is taken off
    rows = running(rows, keys, order, {"since": ("last", F.when(first, F.col(start))), "_base": ("last", F.when(first, F.col("_total") - F.col("_fresh")))}, cell)
    return rows.withColumn("covered", F.col("_total") - F.col("_base")).drop("_reach", "_fresh", "_new", "_total", "_base")


def gaps(df: DataFrame, keys: Sequence[str], start: str = "started", end: str = "ended", width: int | None = None) -> DataFrame:
    """(keys, gap_start, gap_end): what the union of each key's intervals leaves between its first and last."""
    merged = merge(df, keys, start, end, width=width)
    joined = running(merged, keys, [start], {"gap_start": ("last", end)}, cell_of(start, width), before=["gap_start"])
    return joined.where("gap_start is not null").select(*keys, "gap_start", F.col(start).alias("gap_end"))


def subtract(windows: DataFrame, holes: DataFrame, key: str, window: tuple[str, str], hole: tuple[str, str], width: int | None = None) -> DataFrame:
    """(key, started, ended): what is left of each key's window (one a key) without its holes, pieces of some length."""
    (a, b), (s, e) = window, hole
    cut = holes.select(key, F.col(s).alias("started"), F.col(e).alias("ended")).join(windows, key).where((F.col("started") < F.col(b)) & (F.col("ended") > F.col(a)))
    cut = cut.select(key, F.greatest("started", a).alias("started"), F.least("ended", b).alias("ended"))
    solid = merge(cut, [key], width=width)
    before = running(solid, [key], ["started"], {"f": ("last", "ended")}, cell_of("started", width), before=["f"])
    first = before.join(windows, key).select(key, F.coalesce("f", a).alias("f"), F.col("started").alias("t"))
    last = solid.groupBy(key).agg(F.max("ended").alias("f"))
    last = windows.join(last, key, "left").select(key, F.coalesce("f", a).alias("f"), F.col(b).alias("t"))
    return first.unionByName(last).where("t > f").select(key, F.col("f").alias("started"), F.col("t").alias("ended"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], bucket: int, touching: bool, reach: int = 0) -> DataFrame:
    """Pairs of rows of the same key whose intervals overlap (touching: also in one point), the right one being
    widened by reach on both sides. Column names of the two sides must differ but for the key.

    Both sides are dealt to time buckets, so that a key's pairs are only met where they can overlap; a pair
    that shares several buckets counts in the one where the later of the two begins."""
    (a0, a1), (b0, b1) = left_span, right_span
    at = lambda c: F.floor(c / F.lit(bucket))
    wide = right.withColumns({"_b0": F.col(b0) - reach, "_b1": F.col(b1) + reach})
    left = left.withColumn("_bucket", F.explode(F.sequence(at(F.col(a0)), at(F.col(a1)))))
    wide = wide.withColumn("_bucket", F.explode(F.sequence(at(F.col("_b0")), at(F.col("_b1")))))
    met = (F.col(a0) <= F.col("_b1")) & (F.col("_b0") <= F.col(a1)) if touching else (F.col(a0) < F.col("_b1")) & (F.col("_b0") < F.col(a1))
    once = at(F.greatest(a0, "_b0")) == F.col("_bucket")
    return left.join(wide, [key, "_bucket"]).where(met & once).drop("_bucket", "_b0", "_b1")

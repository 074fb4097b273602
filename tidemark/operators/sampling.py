"""Samples of frames within bounded arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def evidence_places(activity: Column, most: int) -> Column:
    """The places, in order, of at most `most` (two or more) elements of each row's array; all where there are no more. Every place has a rank, and the
    first ones are taken: the two ends; then, for each inner element with activity, by falling activity and then place, itself, the
    one before and the one after; then the steps of an even grid over the array. A place counts by its best rank. The grid alone
    has `most` different places, so there are always enough. Null for a null array; null and NaN are no activity."""
    if most < 2:
        raise ValueError("a sample has two places at least")
    n = F.size(activity)
    grid = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.bround(j * (n - 1) / F.lit(float(most - 1)), 0).cast("int"))

    def rank(tier: int, strength: Column, first: Column, then: int) -> Column:
        return F.struct(F.lit(tier).alias("tier"), strength.cast("double").alias("strength"), first.cast("int").alias("first"), F.lit(then).alias("then"))

    def as_peak(peak: Column, then: int) -> Column:
        """The rank that a place has because of the element at `peak`."""
        a = F.coalesce(F.nanvl(F.get(activity, peak).cast("double"), F.lit(0.0)), F.lit(0.0))
        return F.when((peak >= 1) & (peak <= n - 2) & (a > 0), rank(1, -a, peak, then))

    def ranked(place: Column) -> Column:
        end = F.when((place == 0) | (place == n - 1), rank(0, F.lit(0.0), place, 0))
        step = F.array_position(grid, place.cast("int"))
        best = F.least(end, as_peak(place, 0), as_peak(place + 1, 1), as_peak(place - 1, 2), F.when(step > 0, rank(2, F.lit(0.0), step, 0)))
        return F.struct(best.alias("rank"), place.cast("int").alias("place"))

    every = F.transform(F.sequence(F.lit(0), n - 1), lambda p: p.cast("int"))
    chosen = F.slice(F.array_sort(F.filter(F.transform(every, ranked), lambda x: x["rank"].isNotNull())), 1, most)
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= most, every).when(n > most, F.array_sort(F.transform(chosen, lambda x: x["place"])))

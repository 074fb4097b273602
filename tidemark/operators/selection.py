"""Splits, samples, shards, windows of time, retention."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_bucket, split_name
from tidemark.operators.prefix import cell_of, running


def hash_split(df: DataFrame, group: str, seed: str) -> DataFrame:
    """df with bucket (0 .. 99) and split, by a digest of seed and group: a group is never torn apart."""
    return df.withColumn("bucket", hash_bucket(F.concat(F.lit(f"{seed}:"), F.col(group)))).withColumn("split", split_name(F.col("bucket")))


def group_leaks(df: DataFrame, group: str) -> DataFrame:
    n = F.count_distinct("split")
    return df.groupBy(group).agg(n.alias("splits"), (n > 1).alias("leaks"))


def uniform_sample(df: DataFrame, key: str, order: Sequence[str], k: int) -> DataFrame:
    """Of each key k rows at equal steps, ends included (halves go to even positions); all where there are no more."""
    rows = df.withColumn("pos", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long")).join(df.groupBy(key).agg(F.count("*").alias("n")), key)
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("n") - 1) / float(k - 1), 0).cast("long"))
    return rows.where((F.col("n") <= k) | F.array_contains(places, F.col("pos"))).drop("n")


def shard(df: DataFrame, position: str, index: int, count: int) -> DataFrame:
    return df.where(F.col(position) % count == index).withColumn("shard", F.lit(index).cast("long"))


def shard_proof(shards: Sequence[DataFrame], source: DataFrame, key: str) -> DataFrame:
    """Figures of each shard, and whether all shards together hold each row of the source once."""
    union = reduce(DataFrame.unionByName, shards)
    source_rows = source.groupBy(key).agg(F.count("*").alias("a"))
    both = union.groupBy(key).agg(F.count("*").alias("b")).join(source_rows, key, "full").agg(F.sum("a").alias("total"), F.bool_and((F.coalesce("a", F.lit(0)) == 1) & (F.coalesce("b", F.lit(0)) == 1)).alias("complete"))
    each = union.groupBy("shard").agg(F.count("*").alias("rows"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    return each.join(F.broadcast(both), F.lit(True))  # one row


def beyond(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Rows of each key after its first k: what retention removes."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") > k).drop("_rank")


def sliding_windows(df: DataFrame, key: str, time: str, length: int, step: int) -> DataFrame:
    """(key, w0, n): rows in each complete window [w0, w0 + length) of each key, from its first row on by steps."""
    spans = df.groupBy(key).agg(F.min(time).alias("t0"), F.max(time).alias("t1"))
    last = F.floor((F.col("t1") - F.col("t0") - length) / F.lit(step))
    windows = spans.where(last >= 0).select(key, F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.col("t0") + i * step)).alias("w0"))
    # each row goes to the few windows that can hold it, so the join is on equal keys
    start = spans.select(key, "t0")
    behind = F.floor((F.col(time) - F.col("t0")) / F.lit(step))
    each = df.join(start, key).withColumn("_i", F.explode(F.sequence(F.greatest(F.lit(0), behind - (length // step)), behind))).withColumn("w0", F.col("t0") + F.col("_i") * step)
    counted = each.where(F.col(time) < F.col("w0") + length).groupBy(key, "w0").agg(F.count("*").alias("c"))
    return windows.join(counted, [key, "w0"], "left").select(key, "w0", F.coalesce("c", F.lit(0)).alias("n"))


def with_before(df: DataFrame, key: str, order: str, columns: Sequence[str], width: int) -> DataFrame:
    """df with before_<column>: the columns of the key's row before in the order of a distinct integer. The order is cut
    into cells of width (see prefix)."""
    found = running(df, [key], [order], {"_before": ("last", F.struct(order, *columns))}, cell_of(order, width), before=["_before"])
    return found.withColumns({f"before_{c}": F.col("_before")[c] for c in columns}).drop("_before")

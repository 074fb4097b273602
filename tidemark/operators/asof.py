"""Reads as of a time: latest per key, as-of joins, newest-first prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import running


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest (order...): one aggregation with partial results, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])


def first_ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key by an order that may mix directions."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: Sequence[str], width: int | None = None) -> DataFrame:
    """Each left row with right_time and the columns of the right row of the same key with the greatest right_time <= left_time.

    Both sides are laid in one order of time and the last right row is carried forward: one shuffle and one
    sort, where a range join would compare all pairs of a key. With width, a key's time is cut into cells of it (see
    prefix), so that a key with any number of rows is sorted cell by cell; keys must not be null then."""
    marked = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(right_time, *columns).alias("_right"))
    rows = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_left": F.struct(*left.columns)}).select(key, "_t", "_side", "_left")
    both = rows.unionByName(marked, allowMissingColumns=True)
    cell = F.floor(F.col("_t") / F.lit(width)) if width else None
    carried = running(both, [key], ["_t", "_side"], {"_found": ("last", "_right")}, cell).where("_side = 1")
    return carried.select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in (right_time, *columns)])


def budget_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: Column, budget: int, cell: Column | None = None) -> DataFrame:
    """Rows of each key, newest first, up to the first that would exceed the budget. cell: cuts a key along that order (see prefix)."""
    return running(df, keys, order, {"used": ("sum", size)}, cell).where(F.col("used") <= budget)


def literal_search(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column holds the text, letters in either case; every character stands for itself."""
    return df.where(F.contains(F.lower(column), F.lower(F.lit(text))))

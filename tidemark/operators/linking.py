"""Joins by position, by fallback keys, by synonyms, and inverted lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prefix import positions


def zipped(left: DataFrame, left_order: Sequence[str], right: DataFrame, right_order: Sequence[str]) -> DataFrame:
    """Rows of two inputs next to each other by their place (position, from 0) in their own orders, which must be distinct; columns must differ. Inputs of
    unequal length are an error, which counts prove before anything is joined."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows can't be zipped with {m}")
    return positions(left, left_order).join(positions(right, right_order), "position")


def by_fallback(rows: DataFrame, first: DataFrame, first_key: str, second: DataFrame, second_key: str, value: str) -> DataFrame:
    """rows with `value` of the match by first_key, else of that by second_key, and which key it was."""
    a = first.select(first_key, F.col(value).alias("_a"))
    b = second.select(second_key, F.col(value).alias("_b"))
    found = rows.join(a, first_key, "left").join(b, second_key, "left")
    by = F.when(F.col("_a").isNotNull(), first_key).when(F.col("_b").isNotNull(), second_key)
    return found.withColumns({value: F.coalesce("_a", "_b"), "found_by": by}).drop("_a", "_b")


def by_classes(left: DataFrame, right: DataFrame, term: str, classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of left and right rows that are equal in `by` and whose terms share a class; classes: (term, class), a term may be in several. A term
    without a class is one of its own. Columns must differ but for these. Each pair appears once."""
    named = lambda df, name: df.withColumnRenamed(term, name).join(classes.withColumnRenamed(term, name), name, "left").withColumn("_class", F.coalesce(F.concat(F.lit("c:"), F.col("class")), F.concat(F.lit("t:"), F.col(name)))).drop("class")
    return named(left, f"left_{term}").join(named(right, f"right_{term}"), [*by, "_class"]).drop("_class").distinct()


def inverted(rows: DataFrame, key: str, values: Column, chunk: int) -> DataFrame:
    """(value, chunk, n, keys): of each value the keys (whole numbers) of the rows that hold it, in order, in lists of one range of `chunk` keys
    each, so that a value that all rows hold is many rows."""
    pairs = rows.select(F.explode(values).alias("value"), key).distinct()
    return pairs.groupBy("value", F.floor(F.col(key) / F.lit(chunk)).alias("chunk")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(key)), ",").alias("keys"))


def inverted_whole(rows: DataFrame, key: str, values: Column, chunk: int) -> DataFrame:
    """(value, n, keys): of each value all keys of the rows that hold it, in order. Lists of ranges of `chunk` keys are made and put in order first, so
    that a task holds a value's list as short texts, of the length of the row that comes out. A null key counts and isn't listed."""
    parts = inverted(rows, key, values, chunk)
    ordered = F.array_sort(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("chunk", "keys"))))
    lists = parts.groupBy("value").agg(F.sum("n").alias("n"), F.transform(ordered, lambda x: x["keys"]).alias("keys"))
    return lists.select("value", "n", F.when(F.size("keys") > 0, F.array_join("keys", ",")).alias("keys"))

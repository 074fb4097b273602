"""Accounts over runs, samples and collections: fingerprints, proofs of cover, parity, provenance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio


def distinct_values(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, name, values): each column's distinct values, sorted and joined."""
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]))
    pairs = df.select(key, names.alias("x")).select(key, "x.*").where("value is not null").distinct()
    return pairs.groupBy(key, "name").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("values"))


def fingerprint(df: DataFrame, key: str, parts: Sequence[str]) -> DataFrame:
    """(key, n, fingerprint): a digest of each group's rows that doesn't depend on their order. Rows are digested one by
    one and the digests' 60-bit prefixes added up, so that no group is gathered."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]).cast("binary"), 256)
    rows = df.select(key, F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)").alias("d"))
    total = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum("d").alias("total"))
    return total.select(key, "n", F.sha2(F.col("total").cast("string").cast("binary"), 256).alias("fingerprint"))


def cover(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(verdict, n): keys of two tables that are once in both, missing, extra, or repeated."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = count(left, "a").join(count(right, "b"), key, "full")
    verdict = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when((F.col("a") > 1) | (F.col("b") > 1), "repeated").otherwise("both")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def disjoint(df: DataFrame, split: str, keys: Sequence[str]) -> DataFrame:
    """(name, n_values, leaking): for each key column, how many of its values stand in more than one split."""
    each = [df.where(F.col(k).isNotNull()).groupBy(F.col(k).cast("string").alias("v")).agg(F.count_distinct(split).alias("s")).agg(F.lit(k).alias("name"), F.count("*").alias("n_values"), F.count_if(F.col("s") > 1).alias("leaking")) for k in keys]
    return reduce(DataFrame.unionByName, each)


def against_first(df: DataFrame, case: str, size: str, measure: Column, base: int = 1) -> DataFrame:
    """(case, size, measure, ratio): a measure of each size of a case, and its ratio to that of the base size."""
    rows = df.groupBy(case, size).agg(measure.alias("measure"))
    first = F.max(F.when(F.col(size) == base, F.col("measure"))).over(Window.partitionBy(case))
    return rows.withColumn("ratio", ratio(F.col("measure"), first))


def sample_accounts(df: DataFrame, key: str, sample: str, time: str, order: Sequence[str]) -> DataFrame:
    """Of each key: rows, distinct samples, those that a full range of samples would hold besides, whether time never
    goes back."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(*order))
    rows = df.withColumn("_back", F.col(time) < before)
    span = F.max(sample) - F.min(sample) + 1
    return rows.groupBy(key).agg(F.count("*").alias("events"), F.count_distinct(sample).alias("unique"), (span - F.count_distinct(sample)).alias("omitted"), (~F.coalesce(F.bool_or("_back"), F.lit(False))).alias("monotone"))


def parity(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row: whether two runs have the same keys and, in each column, the same values, nulls alike."""
    renamed = b.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = a.select(key, *columns).join(renamed, F.col(key) == F.col("_k"), "full")
    same = [F.bool_and(F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"same_{c}") for c in columns]
    return both.agg(F.count("*").alias("rows"), F.bool_and(F.col(key).isNotNull() & F.col("_k").isNotNull()).alias("same_keys"), *same)

"""The driver's tables as the engine's inputs: event streams, labels, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, kind, started, ended, k, value): intervals of k seconds, in microseconds."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("kind"), micros("ts").alias("started"), k.alias("k"), "value")
    return rows.withColumn("ended", F.col("started") + F.col("k") * 1_000_000)


#: The same, for the oracle.
EVENTS_SQL = """ev AS (SELECT event_id AS id, user_id, event_type AS kind, epoch_us(ts) AS started, epoch_us(ts) + k * 1000000 AS ended, k, value
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""

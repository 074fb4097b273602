"""Queries of event scores, of exact percentiles, of first matches, of motion and evidence frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import intervals, matching, sampling, scoring
from tidemark.plans.bindings import events, table
from tidemark.plans.registry import DAY, MINUTE, query
from tidemark.streaming import machines, motion


def _truth_and_guesses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, sf_dir)
    truth = rows.where("kind in ('purchase', 'error')").select("user_id", F.col("id").alias("target"), F.col("kind").alias("label"), F.col("started").alias("l0"), (F.col("ended") + 40 * MINUTE).alias("l1"))
    guess = rows.where("kind in ('view', 'click')").select("user_id", F.col("id").alias("candidate"), F.when(F.col("kind") == "view", "purchase").otherwise("error").alias("said"), (F.col("k") / 100.0).alias("confidence"), F.col("started").alias("w0"), (F.col("ended") + 40 * MINUTE).alias("w1"))
    return truth, guess


@query()
def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled, matched, missing, predicted, unsupported and false events for each kind, after a largest matching."""
    truth, guess = _truth_and_guesses(spark, sf_dir)
    pairs = intervals.overlap_join(guess, truth, "user_id", ("w0", "w1"), ("l0", "l1"), 60 * MINUTE, touching=False).where("label = said")
    pairs = pairs.withColumn("score", S.temporal_iou(F.col("l0"), F.col("l1"), F.col("w0"), F.col("w1"))).where("score >= 0.1").withColumns({"first": F.least("l0", "w0"), "last": F.greatest("l1", "w1")})
    pairs = intervals.islands(pairs, "user_id", "first", "last", 30 * DAY).select("user_id", "island", "target", "candidate", "score")
    covered = F.col("w0") % (2 * DAY) < DAY  # every other day is covered by labels that are complete
    return scoring.event_totals(truth, guess.withColumn("covered", covered), matching.bipartite(pairs, "user_id", "island"))


@query()
def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, guess = _truth_and_guesses(spark, sf_dir)
    pairs = intervals.overlap_join(guess, truth, "user_id", ("w0", "w1"), ("l0", "l1"), 60 * MINUTE, touching=False).where("label = said")
    pairs = pairs.withColumn("score", S.temporal_iou(F.col("l0"), F.col("l1"), F.col("w0"), F.col("w1"))).where("score >= 0.2").withColumns({"first": F.least("l0", "w0"), "last": F.greatest("l1", "w1")})
    return matching.first_fit(intervals.islands(pairs, "user_id", "first", "last", 30 * DAY), "user_id", "island")


@query("""WITH {EV}, l AS (SELECT user_id, started AS l0, ended + 2400000000 AS l1, kind FROM ev WHERE kind = 'purchase'), w AS (SELECT user_id, started AS w0, ended + 2400000000 AS w1, id FROM ev WHERE kind = 'view'),
  m AS (SELECT DISTINCT w.id FROM w JOIN l ON w.user_id = l.user_id AND w0 < l1 AND l0 < w1 WHERE (least(w1, l1) - greatest(w0, l0)) * 2 >= (greatest(w1, l1) - least(w0, l0)))
  SELECT count(*) AS rows, count_if(m.id IS NOT NULL) AS hit, count_if(m.id IS NULL) AS missed FROM w LEFT JOIN m ON w.id = m.id""")
def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many windows have a label with an overlap over union of a half or more."""
    rows = events(spark, sf_dir)
    labels = rows.where("kind = 'purchase'").select("user_id", F.col("started").alias("l0"), (F.col("ended") + 40 * MINUTE).alias("l1"))
    views = rows.where("kind = 'view'").select("user_id", "id", F.col("started").alias("w0"), (F.col("ended") + 40 * MINUTE).alias("w1"))
    pairs = intervals.overlap_join(views, labels, "user_id", ("w0", "w1"), ("l0", "l1"), 60 * MINUTE, touching=False)
    half = (F.least("w1", "l1") - F.greatest("w0", "l0")) * 2 >= F.greatest("w1", "l1") - F.least("w0", "l0")
    hit = views.join(pairs.where(half).select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.agg(F.count("*").alias("rows"), F.count("_hit").alias("hit"), F.count_if(F.col("_hit").isNull()).alias("missed"))


@query("""WITH t AS (SELECT conv_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, greatest(length(coalesce(text, '')) - 900, 0) AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, '')))),
  p AS (SELECT conv_id, n, i, a, unnest([i, i - 1, i + 1]) AS place, unnest([0, 1, 2]) AS then_ FROM t WHERE a > 0 AND i > 0 AND i < n - 1),
  r AS (SELECT conv_id, n, i AS place, [0, 0, 0, 0] AS rank FROM t WHERE i = 0 OR i = n - 1 UNION ALL SELECT conv_id, n, place, [1, -a, i, then_] FROM p
    UNION ALL SELECT DISTINCT conv_id, n, CAST(round_even(j * (n - 1) / 4.0, 0) AS BIGINT), [2, 0, j, 0] FROM t, (SELECT unnest([0, 1, 2, 3, 4]) AS j) WHERE n > 5),
  b AS (SELECT conv_id, any_value(n) AS n, place, min(rank) AS rank FROM r GROUP BY conv_id, place)
  SELECT conv_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank) AS x FROM b WHERE n > 5) WHERE x <= 5 UNION ALL SELECT conv_id, CAST(i AS INTEGER) FROM t WHERE n <= 5""")
def evidence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation at most five turns: the ends, the long ones by length with their neighbours, then evenly."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.length(F.coalesce("text", F.lit(""))).alias("size"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("x"))
    activity = F.transform("x", lambda t: F.greatest(t["size"] - 900, F.lit(0)))
    return rows.select("conv_id", F.explode(sampling.evidence_places(activity, 5)).alias("place"))


@query()
def motion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", F.col("started").alias("at"), "id", (F.col("k") / 100.0).alias("activity"), (F.col("k") % 10 > 0).alias("steady"), F.when(F.col("k") > 97, "blurred").otherwise("").alias("problem"))
    return machines.fold(rows, lambda s: motion.Motion(s, bound=0.5, confirm=3, settle=2 * DAY, pause=15 * DAY, ttl=20 * DAY), motion.Motion.schema)

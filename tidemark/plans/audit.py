"""Queries that audit a whole dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, audits, prefix
from tidemark.plans.bindings import events
from tidemark.plans.registry import DAY, MINUTE, query

HOUR = 60 * MINUTE

TILES_SQL = """t AS (SELECT user_id, id, k, started AS c0, lead(started) OVER w AS next, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY started, id)),
  i AS (SELECT user_id, n + CASE WHEN k = 23 THEN -2 ELSE 0 END AS position, n, c0 + CASE WHEN k = 41 THEN 3600000000 ELSE 0 END AS c0, next + CASE WHEN k = 19 THEN 7200000000 WHEN k = 17 THEN -1800000000 ELSE 0 END AS c1 FROM t WHERE next IS NOT NULL),
  r AS (SELECT user_id, min(started) AS r0, max(started) AS r1 FROM ev GROUP BY user_id),
  v AS (SELECT i.user_id, greatest(c0, r0) AS a, least(c1, r1) AS b FROM i JOIN r USING (user_id) WHERE c0 < c1 AND c0 < r1 AND c1 > r0),
  u AS (SELECT user_id, a, b, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
  s AS (SELECT user_id, CAST(sum(b - a) AS BIGINT) AS total, CAST(sum(greatest(0, b - greatest(a, coalesce(reach, a)))) AS BIGINT) AS covered FROM u GROUP BY user_id),
  o AS (SELECT i.*, r0, r1, lag(c1) OVER (PARTITION BY i.user_id ORDER BY position, n) AS before FROM i JOIN r USING (user_id)),
  p AS (SELECT user_id, count(*) AS intervals, count_if(c0 < r0 OR c1 > r1 OR c0 >= c1) AS outside, count_if(c0 < before) AS unordered FROM o GROUP BY user_id),
  c AS (SELECT r.user_id, coalesce(intervals, 0) AS intervals, coalesce(covered, 0) AS covered, r1 - r0 - coalesce(covered, 0) AS holes, coalesce(total - covered, 0) AS excess, coalesce(outside, 0) AS outside, coalesce(unordered, 0) AS unordered FROM r LEFT JOIN s USING (user_id) LEFT JOIN p USING (user_id))"""


def _tiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each user's time from event to event, as intervals in order; some too short, too long, late, or out of place."""
    rows = events(spark, sf_dir)
    k, start = F.col("k"), F.col("started")
    keyed = prefix.running(rows, ["user_id"], ["started", "id"], {"n": ("sum", F.lit(1))}, prefix.cell_of("started", 30 * DAY))
    nexts = prefix.running(rows.withColumn("back", -F.col("started")).withColumn("bid", -F.col("id")), ["user_id"], ["back", "bid"], {"next": ("last", "started")}, prefix.cell_of("back", 30 * DAY), before=["next"])
    both = keyed.join(nexts.select("id", "next"), "id").where("next is not null")
    position = (F.col("n") + F.when(k == 23, -2).otherwise(0)) * (1 << 20) + F.col("n")  # by place, then by order
    c1 = F.col("next") + F.when(k == 19, 2 * HOUR).when(k == 17, -HOUR // 2).otherwise(0)
    tiles = both.select("user_id", position.cast("long").alias("position"), (start + F.when(k == 41, HOUR).otherwise(0)).alias("c0"), c1.alias("c1"))
    return rows.groupBy("user_id").agg(F.min("started").alias("r0"), F.max("started").alias("r1")), tiles


@query("WITH {EV}, " + TILES_SQL + """ SELECT *, holes + excess + outside + unordered = 0 AND intervals > 0 AS once FROM c""")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each recording is covered once, in order and within its bounds, and by how much it isn't."""
    return audits.coverage(*_tiles(spark, sf_dir), "user_id", 10 * DAY)


@query("WITH {EV}, " + TILES_SQL + """, z AS (SELECT user_id, holes = 0 AND excess = 0 AS whole FROM c),
  w AS (SELECT DISTINCT user_id, started // 86400000000 AS day FROM ev WHERE kind <> 'error'), l AS (SELECT DISTINCT user_id, d AS day FROM ev, LATERAL (SELECT unnest([started // 86400000000, (ended - 1) // 86400000000]) AS d) WHERE kind = 'error' AND ended > started),
  q AS (SELECT w.user_id, w.day, (l.day IS NULL) <> (w.day % 7 = 0) AS quiet, l.day IS NOT NULL AS busy FROM w LEFT JOIN l ON w.user_id = l.user_id AND w.day = l.day),
  qa AS (SELECT q.user_id, count(*) AS windows, count_if(quiet) AS quiet, count_if(quiet = busy OR (quiet AND NOT whole)) AS wrong_quiet FROM q JOIN z USING (user_id) GROUP BY q.user_id),
  f AS (SELECT user_id, id, started AS t FROM ev WHERE kind = 'view'), b AS (SELECT user_id, id, k, started, ended + 2 * 86400000000 AS ended FROM ev WHERE kind = 'purchase'),
  x AS (SELECT b.*, f.id AS pre, f.t AS pre_t FROM b ASOF LEFT JOIN f ON b.user_id = f.user_id AND b.started >= f.t),
  y AS (SELECT x.*, f.t AS post_t FROM x ASOF LEFT JOIN f ON x.user_id = f.user_id AND x.started + (k % 4) * 86400000000 >= f.t),
  e AS (SELECT user_id, count(*) AS events, count_if(NOT coalesce(pre_t <= started AND started < post_t AND post_t <= ended, false)) AS wrong_citations FROM y GROUP BY user_id)
  SELECT c.user_id, CASE WHEN bucket < 70 THEN 'train' WHEN bucket < 85 THEN 'validation' ELSE 'test' END AS split, holes + excess + outside + unordered = 0 AND intervals > 0 AS once, coalesce(windows, 0) AS windows, coalesce(quiet, 0) AS quiet, coalesce(wrong_quiet, 0) AS wrong_quiet, coalesce(events, 0) AS events, coalesce(wrong_citations, 0) AS wrong_citations
  FROM (SELECT *, CAST(user_id * 37 % 100 AS BIGINT) AS bucket FROM c) c LEFT JOIN qa USING (user_id) LEFT JOIN e USING (user_id)""")
def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each recording: its split, whether it is covered once, and how many of its quiet windows and citations are wrong."""
    rows, key = events(spark, sf_dir), "user_id"
    covered = audits.coverage(*_tiles(spark, sf_dir), key, 10 * DAY)
    day = F.floor(F.col("started") / F.lit(DAY))
    windows = rows.where("kind <> 'error'").select(key, day.alias("window")).distinct().withColumns({"w0": F.col("window") * DAY, "w1": (F.col("window") + 1) * DAY})
    labels = rows.where("kind = 'error' and ended > started").select(key, F.col("started").alias("l0"), F.col("ended").alias("l1"))
    days = labels.select(key, F.explode(F.sequence(F.floor(F.col("l0") / F.lit(DAY)), F.floor((F.col("l1") - 1) / F.lit(DAY)))).alias("window")).distinct().withColumn("_busy", F.lit(True))
    claimed = windows.join(days, [key, "window"], "left").withColumn("quiet", F.col("_busy").isNull() != (F.col("window") % 7 == 0)).drop("_busy")
    claimed = claimed.join(covered.select(key, ((F.col("holes") == 0) & (F.col("excess") == 0)).alias("whole")), key)
    checked = audits.quiet(claimed, labels, key, DAY).groupBy(key).agg(F.count("*").alias("windows"), F.count_if("quiet").alias("quiet"), F.count_if("wrong").alias("wrong_quiet"))
    views = rows.where("kind = 'view'").select(key, F.col("started").alias("t"), F.col("id").alias("name"))
    buys = rows.where("kind = 'purchase'").select(key, "id", "started", (F.col("ended") + 2 * DAY).alias("ended"), (F.col("started") + (F.col("k") % 4) * DAY).alias("later"))
    cited = asof.asof_join(buys, views, key, "started", "t", ["name"], 30 * DAY).withColumnRenamed("name", "pre").drop("t")
    cited = asof.asof_join(cited, views, key, "later", "t", ["name"], 30 * DAY).withColumnRenamed("name", "post").drop("t")
    events_ = audits.citations(cited, views.select("name", "t")).groupBy(key).agg(F.count("*").alias("events"), F.count_if("wrong").alias("wrong_citations"))
    bucket = F.col(key) * 37 % 100
    split = F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test")
    out = covered.join(checked, key, "left").join(events_, key, "left")
    return out.select(key, split.alias("split"), "once", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("windows", "quiet", "wrong_quiet", "events", "wrong_citations")))

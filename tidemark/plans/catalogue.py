"""The queries of the temporal engine, each next to SQL for DuckDB where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import asof, intervals, matching, rules, scoring, selection
from tidemark.plans.bindings import EVENTS_SQL, events, table
from tidemark.plans.registry import AS_OF, DAY, MINUTE, ORACLE_SQL, QUERIES, SECOND, query
from tidemark.streaming import machines

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- reads as of a time


@query("""WITH f AS (SELECT o_custkey AS entity, o_orderpriority AS attribute, epoch_us(o_orderdate) AS observed_at, o_orderstatus AS state,
    row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01'),
  n AS (SELECT * FROM f WHERE r = 1 ORDER BY observed_at DESC, entity, attribute LIMIT 64)
  SELECT entity, attribute, observed_at, CASE WHEN 883612800000000 - observed_at <= 7 * 86400000000 THEN state END AS state FROM n""")
def journal_state_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = 883_612_800_000_000
    facts = table(spark, sf_dir, "orders").where("o_orderdate <= timestamp_ntz'1998-01-01 00:00:00'").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("attribute"), S.micros("o_orderdate").alias("observed_at"), F.col("o_orderkey").alias("arrival"), F.col("o_orderstatus").alias("state"))
    newest = asof.latest_by(facts, ["entity", "attribute"], ["observed_at", "arrival"]).orderBy(F.desc("observed_at"), "entity", "attribute").limit(64)
    return newest.select("entity", "attribute", "observed_at", F.when(now - F.col("observed_at") <= 7 * DAY, F.col("state")).alias("state"))


@query("""SELECT conv_id, turn, role, used FROM (SELECT conv_id, turn, role, CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used <= 2000""")
def journal_recent_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    size = F.length(F.coalesce("text", F.lit("")))
    return asof.budget_prefix(rows, ["conv_id"], [F.desc("turn")], size, 2000, -F.floor(F.col("turn") / F.lit(1024))).select("conv_id", "turn", "role", "used")


@query("""SELECT doc_id, lang FROM documents WHERE text ILIKE '%ion the%' ORDER BY doc_id DESC LIMIT 20""")
def journal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = asof.literal_search(table(spark, sf_dir, "documents"), "text", "ion the")
    return found.select("doc_id", "lang").orderBy(F.desc("doc_id")).limit(20)


@query("""SELECT 'orders:' || o_orderstatus AS name, count(*) AS n, epoch_us(max(o_orderdate)) AS latest FROM orders GROUP BY o_orderstatus
  UNION ALL SELECT 'events', count(*), epoch_us(max(ts)) FROM events""")
def journal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("orders:"), F.col("o_orderstatus")).alias("name")).agg(F.count("*").alias("n"), F.max(S.micros("o_orderdate")).alias("latest"))
    return orders.unionByName(events(spark, sf_dir).agg(F.lit("events").alias("name"), F.count("*").alias("n"), F.max("started").alias("latest")))


@query("""WITH {EV}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started DESC, id DESC) AS r FROM ev WHERE started <= {AS_OF})
  SELECT l.user_id, c_name, kind, started, {AS_OF} - started AS age, {AS_OF} - started > 86400000000 AS stale FROM l JOIN customer ON c_custkey = l.user_id WHERE r = 1 ORDER BY started DESC, l.user_id LIMIT 64""")
def tracks_latest_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = asof.latest_by(events(spark, sf_dir).where(F.col("started") <= AS_OF).select("user_id", "id", "kind", "started"), ["user_id"], ["started", "id"])
    named = latest.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id")
    age = F.lit(AS_OF) - F.col("started")
    return named.select("user_id", "c_name", "kind", "started", age.alias("age"), (age > DAY).alias("stale")).orderBy(F.desc("started"), "user_id").limit(64)


@query("""WITH {EV} SELECT user_id, id, kind, started FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started DESC, kind ASC, id DESC) AS r FROM ev WHERE started <= {AS_OF} AND kind <> 'error') WHERE r = 1""")
def track_latest_mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where((F.col("started") <= AS_OF) & (F.col("kind") != "error"))
    return asof.first_ranked(rows, ["user_id"], [F.desc("started"), F.asc("kind"), F.desc("id")]).select("user_id", "id", "kind", "started")


@query("""WITH {EV} SELECT kind, count(*) AS n, count(DISTINCT user_id) AS users, min(started) AS first_at, max(started) AS last_at FROM ev WHERE started BETWEEN {AS_OF} - 10 * 86400000000 AND {AS_OF} GROUP BY kind""")
def track_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where(F.col("started").between(AS_OF - 10 * DAY, AS_OF))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("started").alias("first_at"), F.max("started").alias("last_at"))


@query("""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY started DESC, id DESC) AS r FROM ev WHERE started <= {AS_OF})
  SELECT a.user_id, a.id, a.started, b.id AS update_id, b.value AS update_value FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.kind = 'purchase' AND b.r = 1 WHERE a.kind = 'view' AND a.r = 1""")
def registry_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where(F.col("started") <= AS_OF).select("user_id", "id", "kind", "started", "value")
    latest = lambda kind: asof.latest_by(rows.where(F.col("kind") == kind).drop("kind"), ["user_id"], ["started", "id"])
    updates = latest("purchase").select("user_id", F.col("id").alias("update_id"), F.col("value").alias("update_value"))
    return latest("view").join(updates, "user_id", "left").select("user_id", "id", "started", "update_id", "update_value")


@query("""WITH {EV} SELECT p.id, p.user_id, p.started, v.seen_at, v.seen_id FROM (SELECT * FROM ev WHERE kind = 'purchase') p
  ASOF LEFT JOIN (SELECT user_id AS u, started AS seen_at, id AS seen_id FROM ev WHERE kind = 'view') v ON p.user_id = v.u AND p.started >= v.seen_at""")
def asof_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    views = rows.where("kind = 'view'").select("user_id", F.col("started").alias("seen_at"), F.col("id").alias("seen_id"))
    purchases = rows.where("kind = 'purchase'").select("id", "user_id", "started")
    return asof.asof_join(purchases, views, "user_id", "started", "seen_at", ["seen_id"], 30 * DAY)


@query("""WITH {EV} SELECT id, user_id, started FROM ev e WHERE kind = 'click' AND NOT EXISTS (SELECT 1 FROM ev s WHERE s.kind = 'error' AND s.user_id = e.user_id AND s.started // 86400000000 = e.started // 86400000000)""")
def unseen_events_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("started") / F.lit(DAY)))
    return rows.where("kind = 'click'").join(rows.where("kind = 'error'").select("user_id", "day"), ["user_id", "day"], "left_anti").select("id", "user_id", "started")


# --- intervals


def _labels_and_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """purchase intervals as labels, view intervals (10 minutes longer) as predictions."""
    rows = events(spark, sf_dir)
    labels = rows.where("kind = 'purchase'").select("user_id", F.col("id").alias("label_id"), F.col("started").alias("l0"), (F.col("ended") + 10 * MINUTE).alias("l1"))
    return labels, rows.where("kind = 'view'").select("user_id", F.col("id").alias("window_id"), F.col("started").alias("w0"), (F.col("ended") + 10 * MINUTE).alias("w1"))


LABELS_SQL = EVENTS_SQL + """, l AS (SELECT user_id, id AS label_id, started AS l0, ended + 600000000 AS l1 FROM ev WHERE kind = 'purchase'),
  w AS (SELECT user_id, id AS window_id, started AS w0, ended + 600000000 AS w1 FROM ev WHERE kind = 'view')"""


@query("WITH " + LABELS_SQL + """ SELECT w.user_id, window_id, label_id, least(w1, l1) - greatest(w0, l0) AS shared, (least(w1, l1) - greatest(w0, l0)) * 2 >= l1 - l0 AS target FROM w JOIN l ON w.user_id = l.user_id AND w0 < l1 AND l0 < w1""")
def interval_overlap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, windows = _labels_and_predictions(spark, sf_dir)
    shared = F.least("w1", "l1") - F.greatest("w0", "l0")
    pairs = intervals.overlap_join(windows, labels, "user_id", ("w0", "w1"), ("l0", "l1"), 12 * MINUTE, touching=False)
    return pairs.select("user_id", "window_id", "label_id", shared.alias("shared"), (shared * 2 >= F.col("l1") - F.col("l0")).alias("target"))


@query("WITH " + LABELS_SQL + """ SELECT w.user_id, count(*) AS pairs, count(DISTINCT window_id) AS windows FROM w JOIN l ON w.user_id = l.user_id AND w0 <= l1 AND l0 <= w1 GROUP BY w.user_id""")
def interval_touch_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, windows = _labels_and_predictions(spark, sf_dir)
    pairs = intervals.overlap_join(windows, labels, "user_id", ("w0", "w1"), ("l0", "l1"), 12 * MINUTE, touching=True)
    return pairs.groupBy("user_id").agg(F.count("*").alias("pairs"), F.count_distinct("window_id").alias("windows"))


@query("""WITH {EV} SELECT DISTINCT c.id, c.user_id FROM ev c JOIN ev p ON p.kind = 'purchase' AND c.kind = 'click' AND c.user_id = p.user_id AND c.started BETWEEN p.started - 1800000000 AND p.ended + 1800000000""")
def collar_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    clicks = rows.where("kind = 'click'").select("id", "user_id", "started", F.col("started").alias("until"))
    events_ = rows.where("kind = 'purchase'").select("user_id", F.col("started").alias("p0"), F.col("ended").alias("p1"))
    return intervals.overlap_join(clicks, events_, "user_id", ("started", "until"), ("p0", "p1"), 60 * MINUTE, touching=True, reach=30 * MINUTE).select("id", "user_id").distinct()


MERGED_SQL = EVENTS_SQL + """, s AS (SELECT *, max(ended) OVER (PARTITION BY user_id ORDER BY started, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
  i AS (SELECT *, sum(CASE WHEN started > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY started, ended ROWS UNBOUNDED PRECEDING) AS island FROM s),
  m AS (SELECT user_id, min(started) AS started, max(ended) AS ended, count(*) AS n FROM i GROUP BY user_id, island)"""


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as intervals of k + 3 hours: many overlap."""
    return events(spark, sf_dir).withColumn("ended", F.col("ended") + 180 * MINUTE)


HOURS_SQL = MERGED_SQL.replace(", s AS", ", x AS (SELECT user_id, started, ended + 10800000000 AS ended FROM ev), s AS")


@query("WITH " + HOURS_SQL + " SELECT user_id, started, ended, n FROM m")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(_hours(spark, sf_dir), ["user_id"], width=30 * DAY)


@query("WITH " + HOURS_SQL + """ SELECT * FROM (SELECT user_id, lag(ended) OVER (PARTITION BY user_id ORDER BY started) AS gap_start, started AS gap_end FROM m) WHERE gap_start IS NOT NULL""")
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps(_hours(spark, sf_dir), ["user_id"], width=30 * DAY)


@query("WITH " + HOURS_SQL + """, c AS (SELECT sum(ended - started) / 3600000000.0 AS hours, bool_and(ended >= started) AS whole FROM m), f AS (SELECT count(*) AS n FROM ev WHERE kind = 'error' AND k >= 50)
  SELECT n AS false_events, CAST(hours AS DOUBLE) AS covered_hours, CASE WHEN whole AND hours > 0 THEN CAST(n / hours AS DOUBLE) END AS per_hour FROM c, f""")
def false_events_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = intervals.merge(_hours(spark, sf_dir), ["user_id"], width=30 * DAY)
    false = events(spark, sf_dir).where("kind = 'error' and k >= 50")
    return scoring.events_per_hour(false, covered)


# --- matching (no SQL)


@query()
def bipartite_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, windows = _labels_and_predictions(spark, sf_dir)
    pairs = intervals.overlap_join(windows, labels, "user_id", ("w0", "w1"), ("l0", "l1"), 12 * MINUTE, touching=False)
    score = S.temporal_iou(F.col("l0"), F.col("l1"), F.col("w0"), F.col("w1"))
    candidates = pairs.withColumn("score", score).where("score >= 0.1").withColumns({"first": F.least("l0", "w0"), "last": F.greatest("l1", "w1")})
    candidates = intervals.islands(candidates, "user_id", "first", "last", 30 * DAY).select("user_id", "island", F.col("label_id").alias("target"), F.col("window_id").alias("candidate"), "score")
    return matching.bipartite(candidates, "user_id", "island")


@query()
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("kind in ('purchase', 'view')").select("user_id", F.when(F.col("kind") == "purchase", "a").otherwise("b").alias("side"), "id", F.col("started").alias("at"))
    return matching.greedy_nearest(rows, "user_id", 6 * 60 * MINUTE, 30 * DAY)


# --- scores


SUMMARY_SQL = "count(*) AS rows, count_if(failed) AS failed, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CASE WHEN sum(tp + fp) > 0 THEN sum(tp) / sum(tp + fp)::DOUBLE END AS precision, CASE WHEN sum(tp + fn) > 0 THEN sum(tp) / sum(tp + fn)::DOUBLE END AS recall, coalesce(2 * (sum(tp) / nullif(sum(tp + fp), 0)::DOUBLE) * (sum(tp) / nullif(sum(tp + fn), 0)::DOUBLE) / nullif(sum(tp) / nullif(sum(tp + fp), 0)::DOUBLE + sum(tp) / nullif(sum(tp + fn), 0)::DOUBLE, 0), 0.0) AS f1"


@query(f"""WITH d AS (SELECT lang, CASE WHEN quality = 1 THEN ['good'] ELSE [] END || CASE WHEN toxic = 1 THEN ['toxic'] ELSE [] END AS expected,
    CASE WHEN n_chars >= 400 THEN ['good'] ELSE [] END || CASE WHEN text ILIKE '%idiot%' THEN ['toxic'] ELSE [] END AS actual, d.doc_id % 50 = 7 AS failed FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
  c AS (SELECT lang, failed, CASE WHEN failed THEN 0 ELSE len(list_intersect(expected, actual)) END AS tp, len(list_filter(actual, lambda x: NOT list_contains(expected, x))) AS fp,
    CASE WHEN failed THEN len(expected) ELSE len(list_filter(expected, lambda x: NOT list_contains(actual, x))) END AS fn FROM d)
  SELECT lang, {SUMMARY_SQL} FROM c GROUP BY lang""")
def score_summary_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    some = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]))
    rows = rows.select("lang", (F.col("doc_id") % 50 == 7).alias("failed"), some((F.col("quality") == 1, "good"), (F.col("toxic") == 1, "toxic")).alias("expected"), some((F.col("n_chars") >= 400, "good"), (F.col("text").ilike("%idiot%"), "toxic")).alias("actual"))
    return scoring.set_summary(rows, ["lang"])


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def percentiles_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.exact_percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}, linear=False)


@query("""SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def percentiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.exact_percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}, linear=True)


@query("""WITH r AS (SELECT least(n_chars, 4000) / 4000.0::DOUBLE AS p, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)),
  b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my, sum((p - y) * (p - y)) AS se FROM r GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS n, sum(se) / sum(n) AS brier, sum(n * abs(mp - my)) / sum(n) AS ece FROM b""")
def calibration_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.least("n_chars", F.lit(4000)) / 4000.0).alias("p")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")
    return scoring.calibration(rows, "p", "y")


@query("""WITH {EV}, p AS (SELECT user_id, kind, started, id, lag(kind) OVER (PARTITION BY user_id ORDER BY started, id) AS before FROM ev WHERE kind <> 'error')
  SELECT user_id, count(*) AS matches, count_if(before <> kind) AS switches FROM p GROUP BY user_id""")
def identity_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("identity", F.when(F.col("kind") != "error", F.col("kind")))
    return scoring.identity_switches(rows, "user_id", "identity", ["started", "id"], 30 * DAY)


@query("""WITH d AS (SELECT lang, quality, CASE WHEN n_chars >= 800 THEN 1 WHEN n_chars < 200 THEN 0 END AS guess FROM documents JOIN labels USING (doc_id))
  SELECT lang, count(*) AS known, count_if(guess = quality) AS correct, count_if(guess <> quality) AS incorrect, count_if(guess IS NULL) AS missing, count_if(guess = quality) / count(*)::DOUBLE AS accuracy FROM d GROUP BY lang""")
def known_label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("guess", F.when(F.col("n_chars") >= 800, 1).when(F.col("n_chars") < 200, 0))
    return scoring.known_labels(rows, ["lang"], "quality", "guess")


@query("""SELECT l_suppkey, count(DISTINCT l_linestatus || l_returnflag) = 1 AS matched, count(DISTINCT l_linestatus || l_returnflag) AS n_values FROM lineitem GROUP BY l_suppkey""")
def config_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_distinct(F.concat("l_linestatus", "l_returnflag"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((n == 1).alias("matched"), n.alias("n_values"))


@query("""SELECT l_suppkey, l_partkey, lines, quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY lines DESC, quantity DESC, l_partkey ASC) AS r
  FROM (SELECT l_suppkey, l_partkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)) WHERE r = 1""")
def argmax_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    best = F.max(F.struct("lines", "quantity", (-F.col("l_partkey")).alias("minus"))).alias("b")
    return runs.groupBy("l_suppkey").agg(best).select("l_suppkey", (-F.col("b.minus")).alias("l_partkey"), "b.lines", "b.quantity")


# --- selection, splits, sets


@query("""WITH d AS (SELECT source, CAST(('0x' || substr(sha256('7:' || doc_id), 1, 8)) AS BIGINT) % 100 AS b FROM documents), s AS (SELECT source, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'val' ELSE 'test' END AS split FROM d)
  SELECT source, count(DISTINCT split) AS splits, count(DISTINCT split) > 1 AS leaks FROM s GROUP BY source""")
def group_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.hash_split(table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("name")), "name", "7")
    return selection.group_leaks(rows, "source")


@query("""WITH d AS (SELECT doc_id, CAST(('0x' || substr(sha256('7:' || source), 1, 8)) AS BIGINT) % 100 AS bucket FROM documents)
  SELECT doc_id, bucket, CASE WHEN bucket < 70 THEN 'train' WHEN bucket < 85 THEN 'val' ELSE 'test' END AS split FROM d""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.hash_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "7").select("doc_id", "bucket", "split")


@query("""SELECT lang, doc_id, h FROM (SELECT lang, doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS r FROM documents) WHERE r <= 20""")
def stable_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", F.sha2(F.col("doc_id").cast("string").cast("binary"), 256).alias("h"))
    return asof.first_ranked(rows, ["lang"], [F.asc("h")], 20)


@query("""WITH {EV}, r AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY started, id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
  p AS (SELECT user_id, id, pos, n, unnest(range(8)) AS i FROM r)
  SELECT DISTINCT user_id, id, pos FROM p WHERE n > 8 AND pos = round_even(i * (n - 1) / 7.0::DOUBLE, 0) OR n <= 8""")
def uniform_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.uniform_sample(events(spark, sf_dir).select("user_id", "id", "started"), "user_id", ["started", "id"], 8).select("user_id", "id", "pos")


@query("""WITH s AS (SELECT doc_id, doc_id % 4 AS shard FROM documents), t AS (SELECT count(*) AS total, count(DISTINCT doc_id) AS ids FROM documents)
  SELECT shard, count(*) AS rows, min(doc_id) AS first_id, max(doc_id) AS last_id, any_value(total) AS total, any_value(total = ids) AS complete FROM s, t GROUP BY shard""")
def shard_union_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents").select("doc_id")
    return selection.shard_proof([selection.shard(source, "doc_id", i, 4) for i in range(4)], source, "doc_id")


@query("""WITH {EV} SELECT user_id, kind, id, started FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY started, id) AS r FROM ev) WHERE r = 1""")
def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "kind", "id", "started")
    return rows.groupBy("user_id", "kind").agg(F.min(F.struct("started", "id")).alias("f")).select("user_id", "kind", "f.id", "f.started")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 5""")
def retention_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.beyond(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey")


OUTBOX_SQL = """o AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) AS created, o_orderkey % 11 AS attempts FROM orders),
  d AS (SELECT id, created, attempts, created + CAST(least(300, pow(2, least(attempts, 8))) * 1000000 AS BIGINT) AS due FROM o)"""


@query("WITH " + OUTBOX_SQL + """ SELECT id, created, attempts + 1 AS attempts, due FROM d WHERE due <= 883612800000000 AND attempts < 10 ORDER BY created, id LIMIT 100""")
def outbox_due_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.micros("o_orderdate").alias("created"), (F.col("o_orderkey") % 11).alias("attempts"))
    rows = rows.withColumn("due", F.col("created") + (S.backoff(F.col("attempts")) * SECOND).cast("long"))
    return rows.where((F.col("due") <= 883_612_800_000_000) & (F.col("attempts") < 10)).select("id", "created", (F.col("attempts") + 1).alias("attempts"), "due").orderBy("created", "id").limit(100)


# --- windows and state machines


@query("""WITH {EV}, b AS (SELECT user_id, min(started) AS t0, max(started) AS t1 FROM ev GROUP BY user_id),
  w AS (SELECT user_id, t0 + i * 129600000000 AS w0 FROM b, unnest(range(0, greatest(0, (t1 - t0 - 259200000000) // 129600000000 + 1))) AS x(i))
  SELECT w.user_id, w.w0, count(e.id) AS n FROM w LEFT JOIN ev e ON e.user_id = w.user_id AND e.started >= w.w0 AND e.started < w.w0 + 259200000000 GROUP BY w.user_id, w.w0""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.sliding_windows(events(spark, sf_dir), "user_id", "started", 3 * DAY, 3 * DAY // 2)


@query("""WITH {EV}, b AS (SELECT user_id, min(started) AS t0 FROM ev GROUP BY user_id) SELECT e.user_id, (started - t0) // 86400000000 AS w, count(*) AS n, min(started) AS first_at FROM ev e JOIN b USING (user_id) GROUP BY 1, 2""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    rows = rows.join(rows.groupBy("user_id").agg(F.min("started").alias("t0")), "user_id").withColumn("w", F.floor((F.col("started") - F.col("t0")) / F.lit(DAY)))
    return rows.groupBy("user_id", "w").agg(F.count("*").alias("n"), F.min("started").alias("first_at"))


@query("""WITH {EV}, f AS (SELECT *, CASE WHEN k >= 50 THEN 0 ELSE 1 END AS still FROM ev),
  g AS (SELECT *, sum(still) OVER (PARTITION BY user_id ORDER BY started, id ROWS UNBOUNDED PRECEDING) AS island FROM f)
  SELECT user_id, min(started) AS first_at, max(started) AS last_at, count(*) AS n FROM g WHERE still = 0 GROUP BY user_id, island HAVING count(*) >= 3""")
def motion_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.streaks(events(spark, sf_dir), "user_id", F.col("k") >= 50, ["started", "id"], 3, 30 * DAY)


def _pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id", F.col("started").alias("at"), "id", (F.col("k") / 100.0).alias("activity"))


@query()
def activity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = 60 * MINUTE
    return machines.fold(_pushes(spark, sf_dir), lambda s: machines.Segments(s, 6 * hour, 6 * hour, 48 * hour, 48 * hour, 0.5), machines.Segments.schema)


@query()
def watch_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", (F.col("started") + F.col("k") * SECOND * 60).alias("at"), "id", (F.col("k") * SECOND * 60).cast("double").alias("activity"), "kind")
    condition, outcome = {"kind": "view", "needed": 60 * MINUTE, "gap": 3 * DAY, "resets": ("error",)}, {"kind": "click", "needed": 0, "gap": 0}
    return machines.fold(rows, lambda s: machines.ResponseWatch(s, condition, 20 * DAY, 30 * MINUTE, outcome, 2 * DAY), machines.ResponseWatch.schema)


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS user_id, epoch_us(o_orderdate) AS t, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'uncertain' ELSE 'complete' END AS status,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
  r AS (SELECT user_id, i, t, status, t AS done, 1 AS n, true AS taken, status <> 'complete' AS blocked FROM o WHERE i = 1
    UNION ALL SELECT o.user_id, o.i, o.t, o.status, CASE WHEN f THEN o.t ELSE r.done END, r.n + CASE WHEN f THEN 1 ELSE 0 END, f, r.blocked OR f AND o.status <> 'complete'
    FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1, LATERAL (SELECT NOT r.blocked AND o.t - r.done > 90 * 86400000000 AS f))
  SELECT user_id, 'reserved' AS decision, t AS first_at, t AS last_at, CAST(n AS BIGINT) AS n FROM r WHERE taken""")
def cooldown_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "uncertain").otherwise("complete")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), S.micros("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), status.alias("status"))
    return machines.fold(rows, lambda s: machines.Cooldown(s, 90 * DAY), machines.Cooldown.schema)


@query("""WITH {EV}, x AS (SELECT user_id, started, ended, id, max(ended) OVER w AS reach FROM ev WHERE kind <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY started, ended, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  i AS (SELECT *, sum(CASE WHEN started > reach + 259200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY started, ended, id ROWS UNBOUNDED PRECEDING) AS episode, greatest(0, ended - greatest(started, coalesce(reach, started))) AS fresh FROM x),
  c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, episode ORDER BY started, ended, id ROWS UNBOUNDED PRECEDING) AS covered FROM i),
  f AS (SELECT *, min(started) OVER (PARTITION BY user_id, episode) AS since, row_number() OVER (PARTITION BY user_id, episode ORDER BY started, ended, id) AS r FROM c WHERE covered >= 120000000 QUALIFY r = 1)
  SELECT f.user_id, (SELECT min(started) FROM i WHERE i.user_id = f.user_id AND i.episode = f.episode) AS since, CAST(ended - (covered - 120000000) AS BIGINT) AS eligible_at FROM f""")
def watch_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.evidence(events(spark, sf_dir).where("kind <> 'error'"), ["user_id"], 3 * DAY, ["id"], width=30 * DAY)
    met = F.min_by("last_need", F.struct("started", "ended", "id")).alias("eligible_at")
    late = rows.withColumn("last_need", F.col("ended") - (F.col("covered") - 2 * MINUTE))
    return late.where(F.col("covered") >= 2 * MINUTE).groupBy("user_id", "episode", "since").agg(met).drop("episode")


@query("""WITH RECURSIVE {EV}, r AS (SELECT user_id, id, started, k * 60000000 AS work, row_number() OVER (PARTITION BY user_id ORDER BY started, id) AS n FROM ev),
  q AS (SELECT user_id, id, n, started AS arrived, started AS begun, started + work AS done FROM r WHERE n = 1
    UNION ALL SELECT r.user_id, r.id, r.n, r.started, greatest(r.started, q.done), greatest(r.started, q.done) + r.work FROM q JOIN r ON r.user_id = q.user_id AND r.n = q.n + 1)
  SELECT user_id, id, arrived, begun, done FROM q""")
def fifo_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.fifo(events(spark, sf_dir).select("user_id", "id", F.col("started").alias("arrived"), (F.col("k") * MINUTE).alias("work")), "user_id", ["arrived", "id"], 30 * DAY)


@query("""WITH {EV} SELECT c_custkey AS watch_id, id, started FROM (SELECT c_custkey, id, started, row_number() OVER (PARTITION BY c_custkey ORDER BY ended, id) AS r
  FROM customer JOIN ev ON user_id = c_custkey WHERE kind = 'error' AND k >= 60 AND started >= 1704067200000000 + c_nationkey * 86400000000 // 2) WHERE r = 1""")
def watch_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    watches = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.lit(1_704_067_200_000_000) + F.floor(F.col("c_nationkey").cast("long") * DAY / F.lit(2))).alias("starts"))
    hits = events(spark, sf_dir).where("kind = 'error' and k >= 60").join(watches, "user_id").where("started >= starts")
    return hits.groupBy(F.col("user_id").alias("watch_id")).agg(F.min(F.struct("ended", "id", "started")).alias("f")).select("watch_id", "f.id", "f.started")


@query("WITH " + HOURS_SQL + """, t AS (SELECT user_id, min(started) AS started, max(ended) AS ended, sum(ended - started) AS observed FROM m GROUP BY user_id) SELECT user_id, count(*) AS episodes, CAST(sum(ended - started) AS BIGINT) AS observed, count_if(ended - started >= 5 * 3600000000) AS triggered FROM m GROUP BY user_id""")
def watch_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    islands = intervals.merge(_hours(spark, sf_dir), ["user_id"], width=30 * DAY).withColumn("d", F.col("ended") - F.col("started"))
    return islands.groupBy("user_id").agg(F.count("*").alias("episodes"), F.sum("d").alias("observed"), F.count_if(F.col("d") >= 300 * MINUTE).alias("triggered"))


# --- rules, verdicts, exports


@query("""WITH {EV}, s AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY started, id) AS before, lag(started) OVER (PARTITION BY user_id ORDER BY started, id) AS before_at FROM ev),
  a AS (SELECT *, CASE WHEN kind = 'error' AND k >= 80 THEN 'alarm' WHEN kind = 'view' AND value < 5 THEN 'light_on' WHEN kind = 'purchase' AND k < 20 THEN 'notify' END AS action FROM s)
  SELECT id, user_id, action, CASE WHEN before IS NULL THEN 'absent' WHEN started - before_at > 43200000000 THEN 'stale' WHEN before <> kind THEN 'changed' END AS reason FROM a
  WHERE action IS NOT NULL AND (before IS NULL OR started - before_at > 43200000000 OR before <> kind)""")
def rules_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = [((F.col("kind") == "error") & (F.col("k") >= 80), "alarm"), ((F.col("kind") == "view") & (F.col("value") < 5), "light_on"), ((F.col("kind") == "purchase") & (F.col("k") < 20), "notify")]
    changed = rules.changed(events(spark, sf_dir), "user_id", "kind", "started", ["started", "id"], DAY // 2)
    return changed.withColumn("action", rules.first_rule(decided)).where("action is not null and reason is not null").select("id", "user_id", "action", "reason")


@query("""WITH b AS (SELECT vec_id, label, abs(embedding[1])::DOUBLE AS x0, abs(embedding[2])::DOUBLE AS y0, abs(embedding[1])::DOUBLE + 0.2 + abs(embedding[3])::DOUBLE AS x1, abs(embedding[2])::DOUBLE + 0.2 + abs(embedding[4])::DOUBLE AS y1 FROM embeddings),
  p AS (SELECT *, lag(x0) OVER w AS a0, lag(y0) OVER w AS b0, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1 FROM b WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
  i AS (SELECT *, greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0)) AS shared FROM p WHERE a0 IS NOT NULL),
  s AS (SELECT vec_id, label, shared / ((x1 - x0) * (y1 - y0) + (a1 - a0) * (b1 - b0) - shared) AS iou, sqrt(pow((x0 + x1) / 2 - (a0 + a1) / 2, 2) + pow((y0 + y1) / 2 - (b0 + b1) / 2, 2)) AS moved FROM i)
  SELECT vec_id, label, round(iou, 9) AS iou, CASE WHEN iou < 0.3 OR moved > 0.15 THEN 'moved' WHEN iou > 0.6 AND moved < 0.08 THEN 'unmoved' ELSE 'ambiguous' END AS verdict FROM s""")
def verification_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.abs(F.element_at("embedding", i)).cast("double") for i in range(1, 5)]
    boxes = table(spark, sf_dir, "embeddings").select("vec_id", "label", e[0].alias("x0"), e[1].alias("y0"), (e[0] + 0.2 + e[2]).alias("x1"), (e[1] + 0.2 + e[3]).alias("y1"))
    return rules.geometry_verdicts(boxes, "label", "vec_id").select("vec_id", "label", F.round("iou", 9).alias("iou"), "verdict")


@query("""WITH {EV} SELECT id, CASE WHEN kind IN ('view', 'click', 'purchase') THEN kind ELSE 'other' END AS token, kind IN ('view', 'click', 'purchase') AS in_vocabulary,
  round(started / 1000000.0::DOUBLE, 3) AS at_s, CASE WHEN k IS NULL THEN 'unknown' WHEN k / 100.0 >= 0.8 THEN CASE WHEN kind = 'click' THEN 'medium' ELSE 'low' END WHEN k / 100.0 >= 0.5 THEN 'medium' ELSE 'high' END AS uncertainty,
  substr(sha256('subject:' || user_id), 1, 20) AS subject FROM ev""")
def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ["view", "click", "purchase"]
    token = S.normal_token(F.col("kind"))
    return events(spark, sf_dir).select("id", S.vocabulary_token(token, known).alias("token"), token.isin(known).alias("in_vocabulary"), F.round(F.col("started") / 1e6, 3).alias("at_s"), S.uncertainty(F.col("k") / 100.0, F.col("kind") == "click").alias("uncertainty"), F.substring(F.sha2(F.concat(F.lit("subject:"), F.col("user_id").cast("string")).cast("binary"), 256), 1, 20).alias("subject"))


@query("""WITH p AS (SELECT doc_id, regexp_matches(text, 'https?://') AS url, regexp_matches(text, '[A-Za-z0-9+/]{40,}') AS base64, regexp_matches(text, '(^|[^A-Za-z0-9])(/[A-Za-z0-9_.-]+){2,}') AS path, regexp_matches(text, '[^\\x00-\\x7F]') AS not_ascii, n_chars > 8000 AS long FROM documents)
  SELECT doc_id, concat_ws(',', CASE WHEN base64 THEN 'base64' END, CASE WHEN long THEN 'long' END, CASE WHEN not_ascii THEN 'not_ascii' END, CASE WHEN path THEN 'path' END, CASE WHEN url THEN 'url' END) AS violations
  FROM p WHERE url OR base64 OR path OR not_ascii OR long""")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.violations(table(spark, sf_dir, "documents"), rules.leak_rules("text", F.col("n_chars") > 8000))
    return rows.where(F.size("violations") > 0).select("doc_id", F.array_join(F.array_sort("violations"), ",").alias("violations"))


@query(rf"""WITH s AS (SELECT 'documents.text' AS field, doc_id AS id, text FROM documents UNION ALL SELECT 'pages.url', page_id, url FROM pages UNION ALL SELECT 'pages.html', page_id, html FROM pages),
  p AS (SELECT field, id, regexp_matches(text, '[A-Za-z0-9+/=]{{48,}}') AND NOT regexp_matches(text, '\A[a-f0-9]{{1,64}}\z') AS base64, regexp_matches(text, '(?i)\.({rules.EXTENSIONS})([^a-z0-9]|\z)') AS extension, length(text) > 128 AS long,
    regexp_matches(text, '[^\x20-\x7E]') AS not_printable, contains(text, '/') OR contains(text, chr(92)) OR regexp_matches(text, '(?i)\A(data:)|base64') OR contains(text, '..') AS path, regexp_matches(text, '{rules.SPACE}') AS space FROM s)
  SELECT field, id, concat_ws(',', CASE WHEN base64 THEN 'base64' END, CASE WHEN extension THEN 'extension' END, CASE WHEN long THEN 'long' END, CASE WHEN not_printable THEN 'not_printable' END, CASE WHEN path THEN 'path' END, CASE WHEN space THEN 'space' END) AS violations
  FROM p WHERE base64 OR extension OR long OR not_printable OR path OR space""")
def leak_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [("documents", "doc_id", "text"), ("pages", "page_id", "url"), ("pages", "page_id", "html")]
    parts = [table(spark, sf_dir, t).select(F.lit(f"{t}.{c}").alias("field"), F.col(key).alias("id"), F.col(c).alias("text")) for t, key, c in fields]
    rows = rules.violations(parts[0].unionByName(parts[1]).unionByName(parts[2]), rules.string_rules("text"))
    return rows.where(F.size("violations") > 0).select("field", "id", F.array_join("violations", ",").alias("violations"))


@query("""WITH l AS (SELECT o_orderkey, o_orderstatus, o_totalprice, count(l_orderkey) AS lines, count_if(l_discount > 0.09) AS deep, coalesce(max(l_quantity), 0) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
  SELECT o_orderkey, concat_ws(',', CASE WHEN lines = 0 THEN 'empty' END, CASE WHEN deep > 1 THEN 'discounts' END, CASE WHEN quantity >= 50 AND o_orderstatus = 'P' THEN 'quantity' END, CASE WHEN o_totalprice < 2000 THEN 'price' END) AS errors FROM l
  WHERE lines = 0 OR deep > 1 OR quantity >= 50 AND o_orderstatus = 'P' OR o_totalprice < 2000""")
def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_discount") > 0.09).alias("deep"), F.max("l_quantity").alias("quantity"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").join(lines, "o_orderkey", "left").na.fill(0, ["lines", "deep", "quantity"])
    checks = {"empty": F.col("lines") == 0, "discounts": F.col("deep") > 1, "quantity": (F.col("quantity") >= 50) & (F.col("o_orderstatus") == "P"), "price": F.col("o_totalprice") < 2000}
    return rules.violations(rows, checks).where(F.size("violations") > 0).select("o_orderkey", F.array_join("violations", ",").alias("errors"))


@query("""WITH {EV}, c AS (SELECT *, lag(ended) OVER (PARTITION BY user_id ORDER BY id) AS cited_end FROM ev)
  SELECT id, user_id, CASE WHEN cited_end > started THEN 'cites_the_future' ELSE 'no_citation' END AS violation FROM c WHERE cited_end > started OR cited_end IS NULL""")
def causal_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.lag("ended").over(Window.partitionBy("user_id").orderBy("id"))
    rows = events(spark, sf_dir).withColumn("cited_end", cited)
    return rows.withColumn("violation", F.when(F.col("cited_end") > F.col("started"), "cites_the_future").when(F.col("cited_end").isNull(), "no_citation")).where("violation is not null").select("id", "user_id", "violation")


@query("""WITH {EV}, d AS (SELECT user_id, started // 86400000000 AS day, count_if(kind = 'purchase') AS truth, count_if(kind = 'view') AS pushes, count_if(kind = 'click') AS kinds FROM ev GROUP BY 1, 2),
  s AS (SELECT sum(truth) AS truth, sum(pushes) AS pushes, sum(least(truth, pushes)) AS m, sum(least(truth, pushes, kinds)) AS ka, count_if(truth = 0) AS quiet, count_if(truth = 0 AND pushes = 0) AS silent FROM d)
  SELECT CAST(truth AS BIGINT) AS truth, CAST(pushes AS BIGINT) AS pushes, CAST(m AS BIGINT) AS matched, round(silent / greatest(1, quiet)::DOUBLE, 3) AS silence, round(m / greatest(1, pushes)::DOUBLE, 3) AS precision, round(m / greatest(1, truth)::DOUBLE, 3) AS recall, round(ka / greatest(1, truth)::DOUBLE, 3) AS kind_recall, round(2 * m / greatest(1, truth + pushes)::DOUBLE, 3) AS agreement FROM s""")
def teacher_agreement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.count_if(F.col("kind") == kind)
    days = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("started") / F.lit(DAY)).alias("day")).agg(n("purchase").alias("truth"), n("view").alias("pushes"), n("click").alias("kinds"))
    return scoring.agreement(days)


@query("""WITH {EV} SELECT kind, count(*) AS n, min(started) AS first_at, max(started) AS last_at, arg_min(value, (started, id)) AS first_value, arg_max(value, (started, id)) AS last_value, quantile_cont(k::DOUBLE, 0.5) AS p50, quantile_cont(k::DOUBLE, 0.95) AS p95,
  CAST(count(*) / nullif((max(ended) - min(started)) / 86400000000.0, 0) AS DOUBLE) AS per_day, bool_and(k < 100) AS pace_kept FROM ev GROUP BY kind""")
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.load_summary(events(spark, sf_dir), "kind")


@query("""WITH {EV}, e AS (SELECT user_id, started / 1e6 AS s, k, (user_id % 3) * 0.5 AS scale, 1000.0 + user_id AS wall FROM ev),
  d AS (SELECT user_id, CASE WHEN scale > 0 THEN wall + (s - 1704067200) * scale + k - (wall + (s - 1704067200) * scale) END AS delay FROM e)
  SELECT user_id, count(delay) AS n, round(avg(delay), 6) AS mean, round(min(delay), 3) AS least, round(max(delay), 3) AS most FROM d GROUP BY user_id""")
def clock_mapping_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale, wall = (F.col("user_id") % 3) * 0.5, F.lit(1000.0) + F.col("user_id")
    at = wall + (F.col("started") / 1e6 - 1_704_067_200) * scale
    delay = F.when(scale > 0, at + F.col("k") - at)
    rows = events(spark, sf_dir).select("user_id", delay.alias("delay"))
    return rows.groupBy("user_id").agg(F.count("delay").alias("n"), F.round(F.avg("delay"), 6).alias("mean"), F.round(F.min("delay"), 3).alias("least"), F.round(F.max("delay"), 3).alias("most"))


@query("""WITH p AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS member, turn, length(text) AS n FROM conversations),
  c AS (SELECT a.pair_id, count(*) AS compared, count_if(a.n <> b.n) AS changed FROM p a JOIN p b ON a.pair_id = b.pair_id AND a.turn = b.turn AND a.member = 0 AND b.member = 1 GROUP BY 1)
  SELECT pair_id, compared, changed, changed = 1 AS one_change FROM c""")
def counterfactual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / F.lit(2)).alias("pair_id"), (F.col("conv_id") % 2).alias("member"), "turn", F.length("text").alias("n"))
    a, b = rows.where("member = 0").select("pair_id", "turn", "n"), rows.where("member = 1").select("pair_id", "turn", F.col("n").alias("m"))
    changed = F.count_if(F.col("n") != F.col("m"))
    return a.join(b, ["pair_id", "turn"]).groupBy("pair_id").agg(F.count("*").alias("compared"), changed.alias("changed"), (changed == 1).alias("one_change"))


@query("""SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'no_prediction' END AS error FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def join_predictions_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("found"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(predictions, "doc_id", "left")
    return rows.select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("found").isNull(), "no_prediction").alias("error"))

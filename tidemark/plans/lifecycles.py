"""Queries of life cycles: outbox, acknowledgements, idempotent logs, late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import asof, lifecycle, rules
from tidemark.plans.bindings import events, table
from tidemark.plans.registry import AS_OF, DAY, MINUTE, SECOND, query

NOW = 883_612_800_000_000
OUTBOX_SQL = """o AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) AS created, sha256('payload:' || o_orderkey || ':' || o_orderstatus) AS hash FROM orders),
  t AS (SELECT l_orderkey AS id, epoch_us(l_shipdate) AS at_, epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 60000000 AS answered, l_returnflag = 'R' AS ok FROM lineitem),
  d AS (SELECT id, min(answered) AS delivered_at FROM t WHERE answered <= at_ + 1800000000 AND ok GROUP BY id),
  m AS (SELECT t.id, count(*) AS tries, count_if(answered > at_ + 1800000000) AS stale, max(at_) AS last_at, any_value(delivered_at) AS delivered_at FROM t LEFT JOIN d ON t.id = d.id WHERE delivered_at IS NULL OR at_ <= delivered_at GROUP BY t.id),
  x AS (SELECT o.id, hash, coalesce(tries, 0) AS attempts, coalesce(stale, 0) AS stale, delivered_at, last_at, CASE WHEN delivered_at IS NULL THEN coalesce(last_at + CAST(least(300, pow(2, least(tries, 8))) * 1000000 AS BIGINT), created) END AS due FROM o LEFT JOIN m ON o.id = m.id)"""


def _outbox(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    outbox = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.micros("o_orderdate").alias("created"), F.sha2(F.concat_ws(":", F.lit("payload"), "o_orderkey", "o_orderstatus").cast("binary"), 256).alias("hash"))
    at = S.micros("l_shipdate")
    return outbox, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), at.alias("at"), (at + F.col("l_quantity").cast("long") * MINUTE).alias("answered"), (F.col("l_returnflag") == "R").alias("ok"))


@query(f"WITH {OUTBOX_SQL} SELECT id, attempts, stale, delivered_at, due, CASE WHEN delivered_at IS NOT NULL THEN 'delivered' WHEN last_at + 1800000000 > {NOW} THEN 'leased' WHEN due <= {NOW} THEN 'due' ELSE 'waiting' END AS status FROM x")
def outbox_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.deliveries(*_outbox(spark, sf_dir), 30 * MINUTE, NOW)


@query(f"""WITH {OUTBOX_SQL}, a AS (SELECT l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS id, CASE WHEN l_linenumber % 4 = 3 THEN 'other' ELSE sha256('payload:' || o_orderkey || ':' || o_orderstatus) END AS hash, epoch_us(l_shipdate) + l_linenumber * 86400000000 AS at_, l_linenumber AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  v AS (SELECT a.id, at_, line, CASE WHEN x.id IS NULL THEN 'unknown' WHEN a.hash <> x.hash THEN 'other_payload' WHEN delivered_at IS NULL OR at_ < delivered_at THEN 'not_delivered' END AS wrong FROM a LEFT JOIN x ON a.id = x.id),
  f AS (SELECT id, min(at_) AS first FROM v WHERE wrong IS NULL GROUP BY id)
  SELECT v.id, line, coalesce(wrong, CASE WHEN at_ = first THEN 'acknowledged' ELSE 'repeated' END) AS verdict FROM v LEFT JOIN f ON v.id = f.id""")
def acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    outbox, attempts = _outbox(spark, sf_dir)
    delivered = lifecycle.deliveries(outbox, attempts, 30 * MINUTE, NOW).join(outbox.select("id", "hash"), "id")
    line = F.col("l_linenumber")
    acks = table(spark, sf_dir, "lineitem").join(outbox.select(F.col("id").alias("l_orderkey"), F.col("hash").alias("right")), "l_orderkey")
    acks = acks.select((F.col("l_orderkey") + F.when(line == 7, 1_000_000_000).otherwise(0)).alias("id"), F.when(line % 4 == 3, "other").otherwise(F.col("right")).alias("hash"), (S.micros("l_shipdate") + line * F.lit(DAY)).alias("at"), line.alias("line"))
    return lifecycle.acknowledgements(delivered, acks).select("id", "line", "verdict")


APPEND_SQL = """l AS (SELECT l_partkey % 500 AS key, l_linestatus || l_returnflag AS digest, l_orderkey * 10 + l_linenumber AS arrival, l_orderkey AS batch, l_suppkey % 50 AS ref FROM lineitem),
  v AS (SELECT *, CASE WHEN arrival = min(arrival) OVER w THEN 'new' WHEN digest = min_by(digest, arrival) OVER w THEN 'repeated' ELSE 'conflict' END AS verdict FROM l WINDOW w AS (PARTITION BY key))"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("key"), F.concat("l_linestatus", "l_returnflag").alias("digest"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"), F.col("l_orderkey").alias("batch"), (F.col("l_suppkey") % 50).alias("ref"))


@query(f"WITH {APPEND_SQL} SELECT key, arrival, verdict FROM v")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.appended(_log(spark, sf_dir), "key", "digest", "arrival").select("key", "arrival", "verdict")


@query(f"WITH {APPEND_SQL} SELECT batch, count(*) AS n, NOT bool_or(verdict = 'conflict' OR ref >= 48) AS taken FROM v GROUP BY batch")
def atomic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.batches_taken(lifecycle.appended(_log(spark, sf_dir), "key", "digest", "arrival"), "batch", F.col("ref") < 48)


@query("""WITH {EV}, c AS (SELECT id // 3 AS id, CASE WHEN id % 5 = 0 THEN 'b' ELSE 'a' END AS digest, ended, id AS arrival, started + CASE WHEN id % 11 = 0 THEN -3600000000 WHEN id % 13 = 0 THEN 864000000000 ELSE 120000000 END AS now FROM ev),
  e AS (SELECT *, CASE WHEN ended > now THEN 'future' WHEN now - ended > 86400000000 THEN 'too_old' END AS early FROM c),
  f AS (SELECT id, min(arrival) AS first, min_by(digest, arrival) AS digest FROM e WHERE early IS NULL GROUP BY id)
  SELECT arrival, coalesce(early, CASE WHEN arrival = first THEN 'new' WHEN e.digest = f.digest THEN 'repeated' ELSE 'conflict' END) AS verdict FROM e LEFT JOIN f ON e.id = f.id""")
def event_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    shift = F.when(n % 11 == 0, -60 * MINUTE).when(n % 13 == 0, 10 * DAY).otherwise(2 * MINUTE)
    rows = events(spark, sf_dir).select(F.floor(n / F.lit(3)).alias("id"), F.when(n % 5 == 0, "b").otherwise("a").alias("digest"), "ended", n.alias("arrival"), (F.col("started") + shift).alias("now"))
    return lifecycle.intake(rows, "now", DAY).select("arrival", "verdict")


@query("""WITH {EV} SELECT user_id, kind, max_by(value, (started, id)) AS value, max(started) AS observed_at FROM ev GROUP BY ALL""")
def fact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).select("user_id", "kind", "value", F.col("started").alias("observed_at"), F.col("id").alias("arrival"))
    return lifecycle.upsert(log, ["user_id", "kind"], "observed_at", "arrival").select("user_id", "kind", "value", "observed_at")


@query("""WITH {EV}, l AS (SELECT *, started + 60000000 AS now, max(ended) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, lag(ended) OVER (PARTITION BY user_id ORDER BY id) AS before FROM ev)
  SELECT id, coalesce(ended < reach, false) AS out_of_order, coalesce(ended <= before, false) AS not_monotone, now - ended > 30000000 AS too_old, ended > now AS future FROM l""")
def lateness_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("now", F.col("started") + MINUTE)
    return lifecycle.lateness_policies(rows, "user_id", ["id"], "ended", "now", 30 * SECOND, 1 << 20).select("id", "out_of_order", "not_monotone", "too_old", "future")


@query("""WITH {EV} SELECT t.id, CASE WHEN t.started - f.at_ <= 43200000000 THEN f.at_ END AS frame_at FROM (SELECT * FROM ev WHERE kind = 'error') t
  ASOF LEFT JOIN (SELECT user_id AS u, started AS at_ FROM ev WHERE kind = 'view') f ON t.user_id = f.u AND t.started >= f.at_""")
def freshest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest frame of each tick's source that isn't newer than the tick, if it is fresh."""
    rows = events(spark, sf_dir)
    frames = rows.where("kind = 'view'").select("user_id", F.col("started").alias("at"))
    found = asof.asof_join(rows.where("kind = 'error'").select("id", "user_id", "started"), frames, "user_id", "started", "at", [], 30 * DAY)
    return found.select("id", F.when(F.col("started") - F.col("at") <= DAY // 2, F.col("at")).alias("frame_at"))


@query("""WITH s AS (SELECT l_suppkey AS queue, l_orderkey * 10 + l_linenumber AS seq, CASE l_linenumber % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' WHEN 3 THEN 'processing' ELSE CASE WHEN l_orderkey % 20 = 0 THEN 'complete' ELSE 'pending' END END AS status FROM lineitem),
  o AS (SELECT *, coalesce(max(CASE WHEN status IN ('complete', 'expired') THEN 1 ELSE 0 END) OVER (PARTITION BY queue ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM s)
  SELECT queue, CASE max_by(status, seq) WHEN 'processing' THEN 'pending' ELSE max_by(status, seq) END AS status, count(*) AS changes FROM o WHERE over_ = 0 GROUP BY queue""")
def queue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber") % 5
    status = F.when(line == 0, "failed").when(line == 1, "pending").when(line.isin(2, 3), "processing").when(F.col("l_orderkey") % 20 == 0, "complete").otherwise("pending")
    log = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("queue"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), status.alias("status"))
    return lifecycle.transitions(log, "queue", ["seq"], "status", ["complete", "expired"], {"processing": "pending"}, 1 << 20)


@query("""SELECT o_orderpriority AS queue, min(o_orderkey) AS claimed FROM orders WHERE o_orderstatus = 'P' GROUP BY 1""")
def fifo_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each queue's next claim takes: the entry that came first."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("queue")).agg(F.min("o_orderkey").alias("claimed"))


@query("""WITH {EV}, t AS (SELECT user_id AS u, started AS t, row_number() OVER (PARTITION BY user_id ORDER BY started) AS n FROM ev WHERE kind = 'view'), l AS (SELECT user_id, id, started AS at_, ended + (id % 5) * 86400000000 AS seen FROM ev WHERE kind = 'error'),
  a AS (SELECT l.*, t.t AS anchor, coalesce(t.n, 0) AS n FROM l ASOF LEFT JOIN t ON l.user_id = t.u AND l.at_ >= t.t), b AS (SELECT a.*, t.t AS newest, coalesce(t.n, 0) - a.n AS behind FROM a ASOF LEFT JOIN t ON a.user_id = t.u AND a.seen >= t.t),
  v AS (SELECT *, CASE WHEN newest IS NULL OR at_ > newest THEN 'waits' WHEN anchor IS NULL OR behind >= 3 THEN 'expired' ELSE 'replayed' END AS verdict FROM b)
  SELECT user_id, id, anchor, verdict, CASE WHEN verdict = 'replayed' THEN behind END AS frames FROM v""")
def late_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    late = rows.where("kind = 'error'").select("user_id", "id", F.col("started").alias("at"), (F.col("ended") + (F.col("id") % 5) * DAY).alias("seen"))
    return lifecycle.late_reconciled(rows.where("kind = 'view'").select("user_id", F.col("started").alias("t")), late, "user_id", 3, 30 * DAY)


@query("""WITH v AS (SELECT page_id, list_filter([CASE WHEN regexp_matches(url, '\\?') THEN 'query' END, CASE WHEN length(url) > 40 THEN 'long' END], lambda x: x IS NOT NULL) AS violations FROM pages)
  SELECT page_id, len(violations) = 0 AS exported, array_to_string(violations, ',') AS reasons FROM v""")
def export_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is exported or kept with its reasons."""
    rows = rules.violations(table(spark, sf_dir, "pages").select("page_id", "url"), {"query": F.col("url").contains("?"), "long": F.length("url") > 40})
    return rows.select("page_id", (F.size("violations") == 0).alias("exported"), F.array_join("violations", ",").alias("reasons"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
  SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN r <= 3 ELSE r = 1 END AS kept FROM s""")
def snapshot_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer the three newest completed orders stay, and the newest of every status that is still active."""
    r = F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", r.alias("r"))
    return rows.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("r") <= 3).otherwise(F.col("r") == 1).alias("kept"))


@query("""WITH {EV} SELECT a.id, a.user_id FROM ev a WHERE a.kind = 'click' AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.kind = 'purchase' AND (b.k >= 90 OR a.started BETWEEN b.started AND b.started + 172800000000))""")
def cooldown_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that no purchase blocks: one of the first kind blocks its user for good, others for two days."""
    rows = events(spark, sf_dir)
    clicks, buys = rows.where("kind = 'click'").select("id", "user_id", "started"), rows.where("kind = 'purchase'")
    free = clicks.join(buys.where("k >= 90").select("user_id").distinct(), "user_id", "left_anti")
    last = asof.asof_join(free, buys.select("user_id", F.col("started").alias("bought")), "user_id", "started", "bought", [], 30 * DAY)
    return last.where(F.col("bought").isNull() | (F.col("started") - F.col("bought") > 2 * DAY)).select("id", "user_id")


@query("""WITH {EV} SELECT user_id, (SELECT count(*) FROM ev e WHERE e.user_id = c.c_custkey AND started <= {AS_OF}) AS seen FROM customer c, (SELECT DISTINCT user_id FROM ev) u WHERE u.user_id = c.c_custkey""")
def events_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related rows looked up by key, none counting as 0."""
    rows = events(spark, sf_dir)
    users = rows.groupBy("user_id").agg(F.count_if(F.col("started") <= AS_OF).alias("seen"))
    return users.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi")

"""Queries of accounts, sets and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import accounting, asof, intervals, prefix
from tidemark.plans.bindings import events, table
from tidemark.plans.registry import AS_OF, DAY, query


@query("""SELECT l_suppkey, name, string_agg(value, ',' ORDER BY value) AS "values" FROM (SELECT DISTINCT l_suppkey, 'l_linestatus' AS name, l_linestatus AS value FROM lineitem
  UNION SELECT DISTINCT l_suppkey, 'l_returnflag', l_returnflag FROM lineitem) GROUP BY ALL""")
def provenance_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.distinct_values(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_linestatus", "l_returnflag"])


@query("""SELECT source, count(*) AS n, sha256(CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', doc_id::VARCHAR, lang, n_chars::VARCHAR)), 1, 15) AS BIGINT)) AS VARCHAR)) AS fingerprint FROM documents GROUP BY source""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.fingerprint(table(spark, sf_dir, "documents"), "source", ["doc_id", "lang", "n_chars"])


@query("""WITH a AS (SELECT c_custkey AS k, 1 AS n FROM customer), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
  SELECT CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' WHEN a.n > 1 OR b.n > 1 THEN 'repeated' ELSE 'both' END AS verdict, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def exact_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = (table(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_custkey"), ("orders", "o_custkey")))
    return accounting.cover(customers, orders, "k")


@query("""WITH d AS (SELECT *, doc_id % 3 AS split, sha256(coalesce(text, '')) AS digest FROM documents),
  g AS (SELECT 'source' AS name, source AS v, count(DISTINCT split) AS s FROM d WHERE source IS NOT NULL GROUP BY ALL UNION ALL SELECT 'doc_id', doc_id::VARCHAR, count(DISTINCT split) FROM d GROUP BY ALL
    UNION ALL SELECT 'digest', digest, count(DISTINCT split) FROM d GROUP BY ALL)
  SELECT name, count(*) AS n_values, count_if(s > 1) AS leaking FROM g GROUP BY name""")
def disjoint_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 3).alias("split"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    return accounting.disjoint(rows, "split", ["source", "doc_id", "digest"])


@query("""WITH m AS (SELECT l_returnflag AS name, l_linenumber AS size, avg(l_quantity::DOUBLE) AS measure FROM lineitem GROUP BY ALL)
  SELECT name, size, round(measure, 6) AS measure, round(measure / max(CASE WHEN size = 1 THEN measure END) OVER (PARTITION BY name), 6) AS ratio FROM m""")
def batch_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("size"), F.col("l_quantity").cast("double").alias("q"))
    return accounting.against_first(rows, "name", "size", F.avg("q")).select("name", "size", F.round("measure", 6).alias("measure"), F.round("ratio", 6).alias("ratio"))


@query("""WITH {EV}, b AS (SELECT *, started < lag(started) OVER (PARTITION BY user_id ORDER BY id) AS back FROM ev)
  SELECT user_id, count(*) AS events, count(DISTINCT k) AS "unique", max(k) - min(k) + 1 - count(DISTINCT k) AS omitted, NOT coalesce(bool_or(back), false) AS monotone FROM b GROUP BY user_id""")
def sample_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.sample_accounts(events(spark, sf_dir), "user_id", "k", "started", ["id"])


@query("""WITH a AS (SELECT doc_id, lang, n_chars FROM documents), b AS (SELECT doc_id, lang, CASE WHEN doc_id % 97 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents)
  SELECT count(*) AS rows, bool_and(a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS same_keys, bool_and(a.lang IS NOT DISTINCT FROM b.lang) AS same_lang, bool_and(a.n_chars IS NOT DISTINCT FROM b.n_chars) AS same_n_chars FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def batch_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    b = a.withColumn("n_chars", F.when(F.col("doc_id") % 97 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return accounting.parity(a, b, "doc_id", ["lang", "n_chars"])


@query("""WITH {EV}, d AS (SELECT user_id, started // 86400000000 AS day, count_if(kind = 'error') AS errors, count_if(kind = 'purchase') AS pushes FROM ev GROUP BY ALL)
  SELECT count(*) AS windows, count_if(errors = 0) AS quiet, count_if(errors = 0 AND pushes = 0) AS abstained, count_if(errors = 0 AND pushes = 0) / nullif(count_if(errors = 0), 0)::DOUBLE AS rate FROM d""")
def quiet_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("started") / F.lit(DAY)).alias("day")).agg(F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "purchase").alias("pushes"))
    quiet = F.col("errors") == 0
    held = quiet & (F.col("pushes") == 0)
    return days.agg(F.count("*").alias("windows"), F.count_if(quiet).alias("quiet"), F.count_if(held).alias("abstained"), S.ratio(F.count_if(held), F.count_if(quiet)).alias("rate"))


@query("""PIVOT (SELECT o_orderpriority AS run, o_orderstatus FROM orders) ON o_orderstatus IN ('F', 'O', 'P') USING count(*) GROUP BY run""")
def run_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), "o_orderstatus")
    return rows.groupBy("run").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("""SELECT 'lang' AS dimension, lang AS value, count(*) AS n, count(DISTINCT source) AS families FROM documents GROUP BY lang
  UNION ALL SELECT 'split', CAST(doc_id % 3 AS VARCHAR), count(*), count(DISTINCT source) FROM documents GROUP BY doc_id % 3
  UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*), count(DISTINCT source) FROM documents JOIN labels USING (doc_id) GROUP BY quality""")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    by = lambda df, name, value: df.groupBy(F.lit(name).alias("dimension"), value.cast("string").alias("value")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("families"))
    return by(docs, "lang", F.col("lang")).unionByName(by(docs, "split", F.col("doc_id") % 3)).unionByName(by(labelled, "quality", F.col("quality")))


@query("""SELECT l_linestatus AS status, round(avg(date_diff('day', l_commitdate, l_receiptdate)), 6) AS mean_late, CAST(max(date_diff('day', l_commitdate, l_receiptdate)) AS BIGINT) AS most_late, count_if(l_receiptdate > l_commitdate) AS late, count(*) AS n FROM (SELECT l_linestatus, CAST(l_shipdate AS DATE) AS l_commitdate, CAST(l_shipdate AS DATE) + CAST(l_linenumber * l_quantity % 9 AS INTEGER) - 4 AS l_receiptdate FROM lineitem) GROUP BY 1""")
def lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = F.col("l_shipdate").cast("date")
    came = F.date_add(due, (F.col("l_linenumber") * F.col("l_quantity") % 9).cast("int") - 4)
    days = F.date_diff(came, due)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), days.alias("d"))
    return rows.groupBy("status").agg(F.round(F.avg("d"), 6).alias("mean_late"), F.max("d").cast("long").alias("most_late"), F.count_if(F.col("d") > 0).alias("late"), F.count("*").alias("n"))


@query("""SELECT l_suppkey % 8 AS shard, count(*) AS rows, CAST(sum(l_quantity) AS DOUBLE) AS work, CAST(sum(l_quantity) AS DOUBLE) / count(DISTINCT CAST(l_shipdate AS DATE)) AS per_day, NULL::DOUBLE AS whole FROM lineitem GROUP BY 1""")
def worker_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = F.sum("l_quantity").cast("double")
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("shard"))
    # rates of workers that ran at different times aren't added up: there is no figure for the whole
    return rows.agg(F.count("*").alias("rows"), work.alias("work"), (work / F.count_distinct(F.col("l_shipdate").cast("date"))).alias("per_day"), F.lit(None).cast("double").alias("whole"))


@query("""WITH {EV} SELECT kind, count_if(k >= 60) AS accepted, count_if(k < 20) AS rejected, count_if(k >= 20 AND k < 60) AS uncertain, count_if(k >= 60) / count(*)::DOUBLE AS accept_rate, count_if(k >= 20 AND k < 60) / count(*)::DOUBLE AS uncertain_rate FROM ev GROUP BY kind""")
def live_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes, no = F.col("k") >= 60, F.col("k") < 20
    n = F.count("*")
    return events(spark, sf_dir).groupBy("kind").agg(F.count_if(yes).alias("accepted"), F.count_if(no).alias("rejected"), F.count_if(~yes & ~no).alias("uncertain"), S.ratio(F.count_if(yes), n).alias("accept_rate"), S.ratio(F.count_if(~yes & ~no), n).alias("uncertain_rate"))


# --- windows over order


@query("""WITH {EV}, l AS (SELECT user_id, started, ended, lag(started) OVER w AS s, lag(ended) OVER w AS e FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY id))
  SELECT user_id, count(*) AS n, count_if(started <= s) AS not_increasing, count_if(ended < e) AS decreasing FROM l GROUP BY user_id""")
def order_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("id")
    rows = events(spark, sf_dir).withColumns({"s": F.lag("started").over(w), "e": F.lag("ended").over(w)})
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("started") <= F.col("s")).alias("not_increasing"), F.count_if(F.col("ended") < F.col("e")).alias("decreasing"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
  SELECT conv_id, string_agg(turn || ':' || role, ' ' ORDER BY turn) AS context FROM l WHERE r <= 3 GROUP BY conv_id""")
def last_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three turns, oldest first."""
    last = asof.first_ranked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.desc("turn")], 3)
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat_ws(":", x["turn"], x["role"])), " ").alias("context"))


@query("""SELECT conv_id, turn, coalesce(string_agg(role, '>') OVER w, '') AS carried,
    CAST(coalesce(sum(length(coalesce(text, ''))) OVER w, 0) AS BIGINT) AS chars, CAST(count(*) OVER w AS BIGINT) AS turns FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def carried_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn is given of the turns before it, all of them; null turns come last."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    rows = rows.withColumn("key", F.struct("conv_id"))  # never null, and equal where conv_id is null
    cell = F.coalesce(prefix.cell_of("turn", 1024), F.lit(1 << 62))
    rows = prefix.running(rows, ["key"], ["turn"], {"carried": ("list", "role"), "chars": ("sum", "size"), "turns": ("sum", F.lit(1))}, cell, before=["carried", "chars", "turns"])
    return rows.select("conv_id", "turn", F.array_join("carried", ">").alias("carried"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("chars", "turns")))


@query("""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started DESC, id DESC) AS r FROM ev WHERE started <= {AS_OF})
  SELECT user_id, id, started, row_number() OVER (PARTITION BY user_id ORDER BY started, id) AS place FROM r WHERE r <= 5""")
def recent_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five of each user as of a time, returned oldest first."""
    newest = asof.first_ranked(events(spark, sf_dir).where(F.col("started") <= AS_OF), ["user_id"], [F.desc("started"), F.desc("id")], 5)
    return newest.select("user_id", "id", "started", F.row_number().over(Window.partitionBy("user_id").orderBy("started", "id")).cast("long").alias("place"))


@query("""WITH s AS (SELECT c_custkey, c_name, c_nationkey, CAST(split_part(c_name, '#', -1) AS BIGINT) AS suffix FROM customer) SELECT c_custkey, suffix, row_number() OVER (PARTITION BY c_nationkey ORDER BY suffix DESC, c_custkey) AS place FROM s""")
def numeric_suffix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("suffix", F.substring_index("c_name", "#", -1).cast("long"))
    return rows.select("c_custkey", "suffix", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("suffix"), "c_custkey")).cast("long").alias("place"))


@query("""WITH {EV} SELECT user_id, max_by(id, (ended, started, id)) AS id, max(ended) AS ended FROM ev GROUP BY user_id""")
def latest_by_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.latest_by(events(spark, sf_dir).select("user_id", "id", "started", "ended"), ["user_id"], ["ended", "started", "id"]).select("user_id", "id", "ended")


@query("""SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed7:' || doc_id)) AS place FROM documents""")
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffle that any engine repeats: rows in the order of a seeded digest."""
    digest = F.sha2(F.concat(F.lit("seed7:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", digest.alias("h"))
    cell = F.conv(F.substring("h", 1, 3), 16, 10).cast("int")  # digests are spread evenly, so 4096 cells of a language are
    return prefix.running(rows.where("lang is not null"), ["lang"], ["h"], {"place": ("sum", F.lit(1))}, cell).select("lang", "doc_id", "place")


@query("""WITH u AS (SELECT doc_id AS pos, 'short' AS part FROM documents WHERE n_chars < 500 UNION ALL SELECT doc_id, 'long' FROM documents WHERE n_chars >= 500)
  SELECT pos, part, lag(part) OVER (ORDER BY pos) IS DISTINCT FROM part AS turns FROM u""")
def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts put together again in the order of their source, which a carried position gives; turns: the part
    differs from that of the row before. The order is cut into cells of about equal size, each of which is given the last row before it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "n_chars")
    part = lambda condition, name: docs.where(condition).select("pos", F.lit(name).alias("part"))
    both = part("n_chars < 500", "short").unionByName(part("n_chars >= 500", "long"))
    before = prefix.running(both, [], ["pos"], {"before_part": ("last", "part")}, prefix.even_cells(both, "pos"), before=["before_part"])
    return before.select("pos", "part", (~F.col("before_part").eqNullSafe(F.col("part"))).alias("turns"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS used, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem)
  SELECT l_orderkey, l_linenumber, used, CASE WHEN r > 4 THEN 'count' ELSE 'size' END AS reason FROM s WHERE r > 4 OR used > 80""")
def artifact_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes if of each order the newest four lines, and no more than 80 units, are kept."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_shipdate"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("used"), F.row_number().over(w).alias("r"))
    return rows.where("r > 4 or used > 80").select("l_orderkey", "l_linenumber", "used", F.when(F.col("r") > 4, "count").otherwise("size").alias("reason"))


@query("""WITH t AS (SELECT ps.l_partkey AS part, ps.l_suppkey AS supplier, CASE WHEN s_nationkey = 3 THEN 0 WHEN s_nationkey IN (5, 7) THEN 2 ELSE 1 END AS tier, min(l_orderkey) AS seq FROM lineitem ps JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
  SELECT part, supplier, tier FROM t QUALIFY row_number() OVER (PARTITION BY part ORDER BY tier, seq, supplier) = 1""")
def tiered_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the first supplier: preferred ones before the rest, avoided ones last, then by first order."""
    tiers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), F.when(F.col("s_nationkey") == 3, 0).when(F.col("s_nationkey").isin(5, 7), 2).otherwise(1).alias("tier"))
    offers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(F.min("l_orderkey").alias("seq")).join(tiers, "supplier")
    return offers.groupBy("part").agg(F.min(F.struct("tier", "seq", "supplier")).alias("b")).select("part", "b.supplier", "b.tier")


# --- sets


@query("""WITH {EV}, h AS (SELECT user_id, started // 86400000000 AS day, list(DISTINCT kind ORDER BY kind) AS kinds FROM ev GROUP BY ALL)
  SELECT user_id, day, len(list_filter(kinds, lambda x: NOT list_contains(['click', 'purchase', 'view'], x))) = 0 AS allowed, list_contains(kinds, 'view') AND list_contains(kinds, 'click') AS holds_both,
    array_to_string(list_filter(['view', 'click', 'error'], lambda x: list_contains(kinds, x)) || list_filter(kinds, lambda x: NOT list_contains(['view', 'click', 'error'], x)), '>') AS ordered FROM h""")
def set_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subset tests on arrays, and the distinct concatenation of two, first occurrences in order."""
    days = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("started") / F.lit(DAY)).alias("day")).agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    some = lambda *x: F.array(*map(F.lit, x))
    first = some("view", "click", "error")
    ordered = F.array_distinct(F.concat(F.array_intersect(first, "kinds"), F.col("kinds")))
    return days.select("user_id", "day", (F.size(F.array_except("kinds", some("click", "purchase", "view"))) == 0).alias("allowed"), (F.size(F.array_except(some("view", "click"), "kinds")) == 0).alias("holds_both"), F.array_join(ordered, ">").alias("ordered"))


@query("""SELECT doc_id, digest FROM (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents) QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id) = 1""")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each content, the first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))


@query("""WITH {EV}, w AS (SELECT user_id, min(started) // 86400000000 * 86400000000 AS a, min(started) // 86400000000 * 86400000000 + 10 * 86400000000 AS b FROM ev GROUP BY user_id),
  x AS (SELECT e.user_id, greatest(started, a) AS started, least(ended + 10800000000, b) AS ended, a, b FROM ev e JOIN w USING (user_id) WHERE started < b AND ended + 10800000000 > a),
  s AS (SELECT *, max(ended) OVER (PARTITION BY user_id ORDER BY started, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
  i AS (SELECT *, sum(CASE WHEN started > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY started, ended ROWS UNBOUNDED PRECEDING) AS island FROM s),
  m AS (SELECT user_id, a, b, min(started) AS started, max(ended) AS ended FROM i GROUP BY user_id, a, b, island),
  p AS (SELECT user_id, coalesce(lag(ended) OVER (PARTITION BY user_id ORDER BY started), a) AS f, started AS t FROM m UNION ALL SELECT user_id, max(ended), any_value(b) FROM m GROUP BY user_id)
  SELECT user_id, f AS started, t AS ended FROM p WHERE t > f""")
def window_minus_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "started", (F.col("ended") + 3 * 3600 * 1_000_000).alias("ended"))
    first = F.floor(F.min("started") / F.lit(DAY)) * DAY
    windows = rows.groupBy("user_id").agg(first.alias("a"), (first + 10 * DAY).alias("b"))
    return intervals.subtract(windows, rows, "user_id", ("a", "b"), ("started", "ended"), 30 * DAY)

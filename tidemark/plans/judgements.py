"""Queries of policies, causal evidence, admissions, leaks, verdicts and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, decisions, prefix, projections, rules, scoring, validation
from tidemark.plans.bindings import events, table
from tidemark.plans.registry import AS_OF, DAY, MINUTE, query
from tidemark.plans.windows import _listed, _sql

ACTIONS_SQL = """a AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN 'lock.door' WHEN 1 THEN 'light.hall' WHEN 2 THEN 'light.attic' ELSE 'switch.fan' END AS entity, CASE l_suppkey % 3 WHEN 0 THEN 'switch' ELSE 'light' END AS domain,
    CASE l_partkey % 4 WHEN 0 THEN 'explode' ELSE 'turn_on' END AS service, CASE l_partkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN '12.5' WHEN 2 THEN CAST(l_partkey AS VARCHAR) END AS brightness,
    list_filter([CASE WHEN l_linenumber % 2 = 0 THEN 'f1' END, CASE WHEN l_suppkey % 5 = 0 THEN 'f9' END], lambda x: x IS NOT NULL) AS cited, count(*) OVER (PARTITION BY l_orderkey) AS n, CAST(l_quantity AS BIGINT) AS length FROM lineitem)"""


@query(f"WITH {ACTIONS_SQL} SELECT id, " + _sql({
    "entity": "entity NOT IN ('light.hall', 'light.attic', 'switch.fan')", "service": "NOT (domain = 'light' AND service = 'turn_on' OR domain = 'switch' AND service = 'turn_on')", "other_domain": "split_part(entity, '.', 1) <> domain", "no_evidence": "len(cited) = 0",
    "evidence": "list_contains(cited, 'f9')", "brightness_type": "brightness IS NOT NULL AND (TRY_CAST(brightness AS DOUBLE) IS NULL OR TRY_CAST(brightness AS DOUBLE) <> floor(TRY_CAST(brightness AS DOUBLE)))",
    "brightness_range": "NOT (TRY_CAST(brightness AS DOUBLE) BETWEEN 0 AND 255)", "too_many": "n > 5", "too_long": "length > 45"}) + " AS violations FROM a")
def policy_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    line, part = c("l_linenumber") % 4, c("l_partkey") % 5
    entity = F.when(line == 0, "lock.door").when(line == 1, "light.hall").when(line == 2, "light.attic").otherwise("switch.fan")
    brightness = F.when(part == 0, "high").when(part == 1, "12.5").when(part == 2, c("l_partkey").cast("string"))
    cited = F.array_compact(F.array(F.when(c("l_linenumber") % 2 == 0, "f1"), F.when(c("l_suppkey") % 5 == 0, "f9")))
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    checks = decisions.policy(entity, F.when(c("l_suppkey") % 3 == 0, "switch").otherwise("light"), F.when(c("l_partkey") % 4 == 0, "explode").otherwise("turn_on"), brightness, cited, F.array(F.lit("f1"), F.lit("f2")), c("n"), c("l_quantity").cast("long"), ["light.hall", "light.attic", "switch.fan"], {"light": ["turn_on"], "switch": ["turn_on"]}, 5, 45)
    rows = table(spark, sf_dir, "lineitem").join(counts, "l_orderkey")
    return rows.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), _listed(checks).alias("violations"))


@query("""SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END) = (CASE WHEN user_id % 2 = 0 THEN 'on' ELSE 'off' END) AND (event_id % 3 = 0 OR event_id % 5 = user_id % 5) AS satisfied FROM events""")
def desired_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    onoff = lambda x: F.when(x % 2 == 0, "on").otherwise("off")
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", decisions.satisfied(onoff(e), F.when(e % 3 != 0, e % 5), onoff(u), u % 5).alias("satisfied"))


@query("""WITH {EV}, a AS (SELECT id, ended AS at_, CASE WHEN k % 3 > 0 THEN user_id + CASE WHEN k = 50 THEN 100000000 ELSE 0 END END AS track FROM ev WHERE kind = 'purchase'),
  c AS (SELECT id, id - 1 AS evidence, CASE WHEN id % 3 = 0 THEN 'pre' END AS phase FROM a WHERE id % 7 > 0 UNION ALL SELECT id, id + CASE WHEN id % 11 = 0 THEN 100000000 ELSE 1 END, CASE WHEN id % 3 = 0 THEN 'post' END FROM a WHERE id % 5 > 0 UNION ALL SELECT id, id - 1, 'post' FROM a WHERE id % 3 = 0 AND id % 2 = 0),
  x AS (SELECT c.id, phase, e.started, e.ended, at_ FROM c JOIN a ON a.id = c.id LEFT JOIN ev e ON e.id = c.evidence),
  p AS (SELECT id, count_if(ended IS NULL) AS unknown_, count_if(ended > at_) AS later, max(CASE WHEN phase = 'pre' THEN ended END) AS pre, min(CASE WHEN phase = 'post' THEN started END) AS post, count_if(phase = 'post' AND ended < at_) AS early FROM x GROUP BY id),
  b AS (SELECT DISTINCT id FROM (SELECT id, evidence FROM c WHERE phase IS NOT NULL GROUP BY ALL HAVING count(DISTINCT phase) > 1)),
  r AS (SELECT a.*, p.* EXCLUDE (id), b.id AS both_, u.user_id AS known FROM a LEFT JOIN p ON p.id = a.id LEFT JOIN b ON b.id = a.id LEFT JOIN (SELECT DISTINCT user_id FROM ev) u ON u.user_id = a.track)
  SELECT id, """ + _sql({"no_citation": "unknown_ IS NULL", "unknown_evidence": "unknown_ > 0", "future_evidence": "later > 0 AND post IS NULL", "unknown_track": "track IS NOT NULL AND known IS NULL", "pre_and_post": "both_ IS NOT NULL", "pre_after_post": "pre >= post", "post_before_event": "early > 0"}) + " AS violations FROM r")  # fmt: skip
def causal_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, i = events(spark, sf_dir), F.col("id")
    some = rows.where("kind = 'purchase'")
    track = F.when(F.col("k") % 3 > 0, F.col("user_id") + F.when(F.col("k") == 50, 100_000_000).otherwise(0))
    assertions = some.select("id", F.col("ended").alias("at"), track.alias("track"))
    third = lambda p: F.when(i % 3 == 0, p)
    cite = lambda where, evidence, phase: some.where(where).select("id", evidence.alias("evidence"), phase.alias("phase"))
    citations = cite("id % 7 > 0", i - 1, third("pre")).unionByName(cite("id % 5 > 0", i + F.when(i % 11 == 0, 100_000_000).otherwise(1), third("post"))).unionByName(cite("id % 3 = 0 and id % 2 = 0", i - 1, F.lit("post")))
    evidence = rows.select(i.alias("evidence"), "started", "ended")
    found = decisions.causal(assertions, citations, evidence, rows.select(F.col("user_id").alias("track")).distinct())
    return found.select("id", F.array_join("violations", ",").alias("violations"))


@query("""WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS turns, max(turn) AS last_ FROM conversations GROUP BY conv_id),
  h AS (SELECT conv_id, turns, conv_id % 6 AS cutoff, 2 + conv_id % 5 AS starts, conv_id % 4 <> 3 AS same, conv_id % 3 = 0 AS short FROM c) SELECT conv_id, """ + _sql({"fields": "short", "other_group": "NOT same", "cutoff": "cutoff >= starts", "later_fact": "len(list_filter(turns, lambda t: t > cutoff)) > 0"}) + " AS violations FROM h")
def history_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    fields = F.when(n % 3 == 0, F.array(F.lit("state"))).otherwise(F.array(F.lit("state"), F.lit("recent")))
    checks = decisions.history(n % 6, 2 + n % 5, F.when(n % 4 == 3, -n).otherwise(n), n, F.col("turns"), fields, ["recent", "state"])
    return rows.select("conv_id", _listed(checks).alias("violations"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'timeout' END AS e1, CASE WHEN doc_id % 10 = 0 THEN 'bad' END AS e2, CASE WHEN doc_id % 4 > 0 THEN lang END AS decision, quality FROM documents LEFT JOIN labels USING (doc_id))
  SELECT doc_id, e1 IS NULL AND e2 IS NULL AND decision IS NOT NULL AS usable, CASE WHEN decision IS NULL THEN 'no_decision' WHEN coalesce(e1, e2) IS NOT NULL THEN coalesce(e1, e2) WHEN quality IS NULL THEN 'not_labelled' ELSE 'eligible' END AS reason FROM r""")
def usable_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which predictions can be scored, and why others can't; the first reason counts."""
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    error, decision = F.coalesce(F.when(n % 6 == 0, "timeout"), F.when(n % 10 == 0, "bad")), F.when(n % 4 > 0, F.col("lang"))
    reason = rules.first_rule([(decision.isNull(), "no_decision"), (error == "timeout", "timeout"), (error == "bad", "bad"), (F.col("quality").isNull(), "not_labelled")])
    return rows.select("doc_id", (error.isNull() & decision.isNotNull()).alias("usable"), F.coalesce(reason, F.lit("eligible")).alias("reason"))


@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN to_json({'lang': lang, 'summary': 'text of ' || n_chars}) ELSE to_json({'summary': 'text of ' || n_chars}) END AS VARCHAR) AS label FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL""")
def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as JSON with their fields in a given order, or the summary alone."""
    summary = F.concat(F.lit("text of "), F.col("n_chars")).alias("summary")
    text = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("lang", summary))).otherwise(F.to_json(F.struct(summary)))
    return table(spark, sf_dir, "documents").where("lang is not null and n_chars is not null").select("doc_id", text.alias("label"))


@query("""WITH {EV}, f AS (SELECT user_id, min(CASE WHEN kind = 'view' THEN started END) AS armed, min(CASE WHEN kind = 'click' THEN started END) AS met, min(CASE WHEN kind = 'purchase' THEN ended END) AS sent, max(CASE WHEN kind = 'error' THEN ended END) AS done FROM ev GROUP BY user_id)
  SELECT c_custkey AS watch_id, met - armed AS to_meet, sent - met AS to_send, done - sent AS to_done, done - armed AS whole FROM customer LEFT JOIN f ON user_id = c_custkey""")
def watch_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watch's clocks and what lies between them; null where either is."""
    at = lambda f, kind, c: f(F.when(F.col("kind") == kind, F.col(c)))
    clocks = events(spark, sf_dir).groupBy("user_id").agg(at(F.min, "view", "started").alias("armed"), at(F.min, "click", "started").alias("met"), at(F.min, "purchase", "ended").alias("sent"), at(F.max, "error", "ended").alias("done"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("watch_id")).join(clocks, F.col("user_id") == F.col("watch_id"), "left")
    return rows.select("watch_id", (F.col("met") - F.col("armed")).alias("to_meet"), (F.col("sent") - F.col("met")).alias("to_send"), (F.col("done") - F.col("sent")).alias("to_done"), (F.col("done") - F.col("armed")).alias("whole"))


@query("""WITH {EV}, p AS (SELECT id, user_id, started + CASE WHEN id % 4 = 0 THEN -30000 ELSE 0 END AS claimed, CASE WHEN id % 3 > 0 THEN k END AS confidence FROM ev WHERE kind = 'purchase'), v AS (SELECT user_id AS u, started AS seen_at, id AS seen FROM ev WHERE kind <> 'purchase'),
  n AS (SELECT p.*, (SELECT min(seen_at) FROM v WHERE u = p.user_id AND seen_at >= p.claimed) AS after FROM p), s AS (SELECT *, CASE WHEN after - claimed BETWEEN 1 AND 50000 THEN after ELSE claimed END AS at_ FROM n)
  SELECT s.id, at_ AS started, coalesce(confidence, 50) AS confidence, seen AS cited, array_to_string(list_filter([CASE WHEN at_ <> claimed THEN 'start' END, CASE WHEN confidence IS NULL THEN 'confidence' END, CASE WHEN seen IS NOT NULL THEN 'citation' END], lambda x: x IS NOT NULL), ',') AS filled FROM s ASOF LEFT JOIN v ON s.user_id = v.u AND s.at_ >= v.seen_at""")
def judged_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged events made whole: a start that misses a frame by up to 50 ms goes to it, a missing confidence is the middle,
    the frame cited is the latest one by then; filled says what was added."""
    rows, i = events(spark, sf_dir), F.col("id")
    claimed = F.col("started") - F.when(i % 4 == 0, 30_000).otherwise(0)
    raw = rows.where("kind = 'purchase'").select("id", "user_id", claimed.alias("claimed"), F.when(i % 3 > 0, F.col("k")).alias("confidence"))
    frames = rows.where("kind <> 'purchase'").select("user_id", F.col("started").alias("seen_at"), i.alias("seen"))
    # the next frame is the latest one before, with time reversed
    back = frames.select("user_id", (-F.col("seen_at")).alias("minus_seen"))
    ahead = asof.asof_join(raw.withColumn("minus", -F.col("claimed")), back, "user_id", "minus", "minus_seen", [])
    gap = -F.col("minus_seen") - F.col("claimed")
    snapped = ahead.withColumn("started", F.when(gap.between(1, 50_000), -F.col("minus_seen")).otherwise(F.col("claimed"))).drop("minus", "minus_seen")
    found = asof.asof_join(snapped, frames, "user_id", "started", "seen_at", ["seen"])
    filled = F.array_join(F.array_compact(F.array(F.when(F.col("started") != F.col("claimed"), "start"), F.when(F.col("confidence").isNull(), "confidence"), F.when(F.col("seen").isNotNull(), "citation"))), ",")
    return found.select("id", "started", F.coalesce("confidence", F.lit(50)).alias("confidence"), F.col("seen").alias("cited"), filled.alias("filled"))


@query("""WITH c AS (SELECT conv_id, list('turn_' || turn ORDER BY turn) AS ids FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(to_json({'type': 'array', 'maxItems': len(ids), 'items': {'enum': ids}}) AS VARCHAR) AS grammar FROM c""")
def evidence_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON schema for each row that lets a model cite only what it was shown."""
    turns = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.concat(F.lit("turn_"), t))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("ids"))
    return rows.select("conv_id", F.to_json(F.struct(F.lit("array").alias("type"), F.size("ids").alias("maxItems"), F.struct(F.col("ids").alias("enum")).alias("items"))).alias("grammar"))


@query("""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]*?([^./?#]+)(?:[/?#]|$)', 1) AS suffix, length(url) > 40 AS long_, regexp_matches(url, '\\?') AS query, regexp_matches(html, '(?i)base64') AS coded FROM pages)
  SELECT suffix, count(*) AS files, count_if(long_ OR query OR coded) AS with_findings, count_if(long_) AS "long", count_if(query) AS "query", count_if(coded) AS base64 FROM p GROUP BY suffix""")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a scan, summed up by the last label of the host that a file came from."""
    checks = {"long": F.length("url") > 40, "query": F.col("url").contains("?"), "base64": F.col("html").rlike("(?i)base64")}
    rows = rules.violations(table(spark, sf_dir, "pages"), checks)
    suffix = F.regexp_extract("url", r"^[a-z]+://[^/?#]*?([^./?#]+)(?:[/?#]|$)", 1)
    return rows.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("files"), F.count_if(F.size("violations") > 0).alias("with_findings"), *[F.count_if(F.array_contains("violations", k)).alias(k) for k in checks])


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'denied_key' WHEN value >= 20 THEN 'depth' ELSE '' END AS violations FROM events""")
def deep_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scanner over a JSON object of every event: its type is a key (that of errors is denied), and large values lie deep."""
    deep = F.concat(F.lit('{"a":{"b":{"c":{"d":{"e":{"f":'), F.col("value").cast("string"), F.lit("}}}}}}"))
    body = F.concat(F.lit('{"'), F.col("event_type"), F.lit('":'), F.when((F.col("value") >= 20) & (F.col("event_type") != "error"), deep).otherwise(F.col("value").cast("string")), F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return decisions.leaks(rows, "event_id", "body").select("event_id", F.array_join("violations", ",").alias("violations"))


@query("""WITH {EV}, g AS (SELECT *, min(started) OVER (PARTITION BY user_id) AS t0, max(started) OVER (PARTITION BY user_id) AS t1 FROM ev), w AS (SELECT *, (started - t0) // 172800000000 AS w FROM g)
  SELECT user_id, w, t0 + w * 172800000000 AS w0, least(t0 + (w + 1) * 172800000000, any_value(t1)) AS w1, count(*) AS n, count_if(started - (t0 + w * 172800000000) BETWEEN 43200000000 AND 129600000000) AS interior FROM w GROUP BY user_id, w, t0""")
def recording_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two days from each recording's start, the last one short, and the rows well inside them."""
    rows = events(spark, sf_dir)
    spans = rows.groupBy("user_id").agg(F.min("started").alias("t0"), F.max("started").alias("t1"))
    rows = rows.join(spans, "user_id").withColumn("w", F.floor((F.col("started") - F.col("t0")) / F.lit(2 * DAY)))
    start = F.col("t0") + F.col("w") * 2 * DAY
    inside = (F.col("started") - start).between(DAY // 2, DAY * 3 // 2)
    return rows.groupBy("user_id", "w", "t0", "t1").agg(F.count("*").alias("n"), F.count_if(inside).alias("interior")).select("user_id", "w", start.alias("w0"), F.least(start + 2 * DAY, F.col("t1")).alias("w1"), "n", "interior")


@query("""WITH RECURSIVE {EV}, r AS (SELECT user_id, id, started, k * 600000000 AS work, row_number() OVER (PARTITION BY user_id ORDER BY started, id) AS n FROM ev),
  q AS (SELECT user_id, id, n, started AS arrived, started AS begun, started + work AS done FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.id, r.n, r.started, greatest(r.started, q.done), greatest(r.started, q.done) + r.work FROM q JOIN r ON r.user_id = q.user_id AND r.n = q.n + 1),
  s AS (SELECT user_id, n, CASE WHEN begun - arrived > 7200000000 THEN 'deadline' END AS reason FROM q)
  SELECT user_id, count(*) AS jobs, coalesce(min(CASE WHEN reason IS NOT NULL THEN n END) - 1, count(*)) AS served, CASE WHEN bool_or(reason IS NOT NULL) THEN 'deadline' ELSE 'source_end' END AS stop FROM s GROUP BY user_id""")
def backlog_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs of a queue are served until one has waited for over two hours, and why it ends."""
    work = events(spark, sf_dir).select("user_id", "id", F.col("started").alias("arrived"), (F.col("k") * 10 * MINUTE).alias("work"))
    jobs = prefix.running(scoring.fifo(work, "user_id", ["arrived", "id"], 30 * DAY), ["user_id"], ["arrived", "id"], {"n": ("sum", F.lit(1))}, prefix.cell_of("arrived", 30 * DAY))
    late = F.min(F.when(F.col("begun") - F.col("arrived") > 120 * MINUTE, F.col("n")))
    return jobs.groupBy("user_id").agg(F.count("*").alias("jobs"), late.alias("late")).select("user_id", "jobs", F.coalesce(F.col("late") - 1, F.col("jobs")).cast("long").alias("served"), F.when(F.col("late").isNotNull(), "deadline").otherwise("source_end").alias("stop"))


@query("""WITH {EV}, f AS (SELECT user_id, kind, CASE k % 4 WHEN 0 THEN 'moved' WHEN 1 THEN 'unmoved' WHEN 2 THEN 'ambiguous' END AS moved, k >= 30 AS sure, {AS_OF} - started AS age, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS learned, id FROM ev),
  g AS (SELECT *, CASE WHEN age > 864000000000 OR moved IS NULL OR NOT sure THEN 'uncertain' ELSE moved END AS geometry FROM f)
  SELECT id, CASE WHEN geometry IN ('uncertain', 'ambiguous') THEN CASE WHEN learned IS NULL THEN 'uncertain' WHEN learned THEN 'probable' ELSE 'improbable' END WHEN learned IS NULL THEN CASE WHEN geometry = 'moved' THEN 'confirmed' ELSE 'refuted' END
    WHEN (geometry = 'moved') = learned THEN CASE WHEN learned THEN 'confirmed' ELSE 'refuted' END ELSE 'contradiction' END AS verdict FROM g""")
def learned_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    moved = F.when(k % 4 == 0, "moved").when(k % 4 == 1, "unmoved").when(k % 4 == 2, "ambiguous")
    learned = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    return events(spark, sf_dir).select("id", decisions.verdict(moved, k >= 30, F.lit(AS_OF) - F.col("started"), 10 * DAY, learned).alias("verdict"))


@query("""WITH {EV} SELECT id, CASE kind WHEN 'view' THEN 'sighting' WHEN 'click' THEN 'gesture' WHEN 'purchase' THEN 'order' ELSE 'blocked' END AS message, CASE kind WHEN 'view' THEN k END AS confidence, CASE kind WHEN 'click' THEN ended - started END AS length, CASE kind WHEN 'purchase' THEN value END AS amount FROM ev""")
def typed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each topic as its own type of message with its own fields; a topic that isn't known is blocked."""
    rows = events(spark, sf_dir)
    one = lambda kind, name, **fields: rows.where(F.col("kind") == kind).select("id", F.lit(name).alias("message"), *[c.alias(n) for n, c in fields.items()])
    parts = [one("view", "sighting", confidence=F.col("k")), one("click", "gesture", length=F.col("ended") - F.col("started")), one("purchase", "order", amount=F.col("value"))]
    out = rows.where(~F.col("kind").isin("view", "click", "purchase")).select("id", F.lit("blocked").alias("message"))
    for part in parts:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select("id", "message", "confidence", "length", "amount")


@query("""WITH {EV}, s AS (SELECT kind, started, ended, k, value, id FROM ev WHERE started BETWEEN {AS_OF} - 864000000000 AND {AS_OF})
  SELECT kind, count(*) AS n, min_by(value, (started, id)) AS first_value, max_by(value, (started, id)) AS last_value, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, quantile_cont(k::DOUBLE, 0.5) AS p50, quantile_cont(k::DOUBLE, 0.95) AS p95, count(*) / 10.0::DOUBLE AS per_day, bool_and(k < 99) AS kept_pace FROM s GROUP BY kind""")
def load_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the samples within a span of time."""
    rows = events(spark, sf_dir).where(F.col("started").between(AS_OF - 10 * DAY, AS_OF))
    order = F.struct("started", "id")
    figures = rows.groupBy("kind").agg(F.count("*").alias("n"), F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), (F.count("*") / F.lit(10.0)).alias("per_day"), F.bool_and(F.col("k") < 99).alias("kept_pace"))
    return figures.join(scoring.exact_percentiles(rows, "kind", "k", {"p50": 0.5, "p95": 0.95}, linear=True), "kind")


@query("""SELECT * FROM (VALUES ('event', 'id', 'bigint', 0), ('event', 'kind', 'string', 1), ('event', 'started', 'bigint', 2), ('command', 'id', 'bigint', 0), ('command', 'action', 'string', 1)) AS t(message, field, type, place)""")
def message_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine's own messages hold, told by their frames' schemas; none of it may be media."""
    rows = events(spark, sf_dir)
    messages = {"event": rows.select("id", "kind", "started"), "command": rows.select("id", F.col("kind").alias("action"))}
    fields = [(name, f.name, f.dataType.simpleString(), i) for name, df in messages.items() for i, f in enumerate(df.schema.fields)]
    if any(kind in ("binary", "variant") for _, _, kind, _ in fields):
        raise ValueError("a message holds media")
    return spark.createDataFrame(fields, "message string, field string, type string, place int")


SPECS = [("view", 0.5, None, ["u0"], None), ("view", 0.1, "even", [], "sensor"), ("click", 0.2, "odd", ["u1"], None), ("error", 0.9, None, [], "model")]


@query("""WITH {EV}, e AS (SELECT id, kind, k / 100.0 AS confidence, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS label, ['u' || user_id % 3, 'all'] AS subjects, CASE WHEN id % 2 = 0 THEN 'sensor' ELSE 'model' END AS origin, user_id, ended,
    lag(ended) OVER (PARTITION BY user_id ORDER BY started, id) AS seen FROM ev),
  s(name, kind, confidence, label, subjects, origin) AS (VALUES (0, 'view', 0.5, NULL, ['u0'], NULL), (1, 'view', 0.1, 'even', [], 'sensor'), (2, 'click', 0.2, 'odd', ['u1'], NULL), (3, 'error', 0.9, NULL, [], 'model'))
  SELECT e.id, CAST(s.name AS BIGINT) AS watch, e.confidence >= s.confidence AND (s.label IS NULL OR e.label = s.label) AND len(list_filter(s.subjects, lambda x: NOT list_contains(e.subjects, x))) = 0 AND (s.origin IS NULL OR e.origin = s.origin) AS met,
    coalesce(e.kind IN ('error', 'click') AND seen IS NOT NULL AND ended >= seen, false) AS resets FROM e JOIN s ON e.kind = s.kind""")
def event_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events against the conditions of the watches on their kind, and whether they undo what was seen before."""
    k = F.col("k")
    specs = spark.createDataFrame([(i, *s) for i, s in enumerate(SPECS)], "watch long, kind string, s_confidence double, s_label string, s_subjects array<string>, s_origin string")
    seen = F.lag("ended").over(Window.partitionBy("user_id").orderBy("started", "id"))
    rows = events(spark, sf_dir).withColumns({"seen": seen, "confidence": k / 100.0, "label": F.when(k % 2 == 0, "even").otherwise("odd"), "subjects": F.array(F.concat(F.lit("u"), F.col("user_id") % 3), F.lit("all")), "origin": F.when(F.col("id") % 2 == 0, "sensor").otherwise("model")})
    both = rows.join(F.broadcast(specs), "kind")  # four rows
    spec = {"kind": F.col("kind"), **{c: F.col(f"s_{c}") for c in ("confidence", "label", "subjects", "origin")}}
    met = decisions.matches(F.col("kind"), F.col("confidence"), F.col("label"), F.col("subjects"), F.col("origin"), spec)
    undone = decisions.resets(F.col("kind"), F.col("ended"), F.col("user_id"), F.array(F.lit("error"), F.lit("click")), F.col("seen"), F.when(F.col("seen").isNotNull(), F.col("user_id")))
    return both.select("id", "watch", met.alias("met"), F.coalesce(undone, F.lit(False)).alias("resets"))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'signup' THEN 'not_an_object' END, CASE WHEN event_type IN ('error', 'click') THEN 'other_key' END, CASE WHEN event_type <> 'signup' AND value < 3 THEN 'not_finite' END], lambda x: x IS NOT NULL), ',') AS violations FROM events""")
def closed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as JSON: signups as a list, errors and clicks with their type as a key, small values as a division by zero gives them."""
    kind, value = F.col("event_type"), F.col("value")
    number = F.when(value < 1, '"NaN"').when(value < 3, '"Infinity"').otherwise(value.cast("string"))
    key = F.when(kind.isin("error", "click"), F.concat(F.lit(',"'), kind, F.lit('":1'))).otherwise("")
    text = F.when(kind == "signup", F.concat(F.lit("["), value.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit('{"k":'), number, key, F.lit("}")))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    return rows.select("event_id", _listed(validation.closed(F.col("t"), ["k"], ["k"])).alias("violations"))


@query("""WITH d AS (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS declared, CAST(l_quantity AS DOUBLE) + CASE WHEN l_linenumber = 3 THEN 0.5 ELSE 0.05 END AS actual FROM lineitem)
  SELECT l_orderkey, bool_and(abs(declared - actual) <= 0.1) AS agree, CAST(sum(declared) AS DOUBLE) <= 120 AS within_budget FROM d GROUP BY l_orderkey""")
def duration_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against measured lengths, and the budget of all of a request."""
    declared = F.col("l_quantity").cast("double")
    actual = declared + F.when(F.col("l_linenumber") == 3, 0.5).otherwise(0.05)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(validation.agrees(declared, actual, 0.1)).alias("agree"), (F.sum(declared) <= 120).alias("within_budget"))


@query("""SELECT conv_id, turn, CAST(to_json({'t': CAST(turn AS DOUBLE) + 0.25}) AS VARCHAR) AS tick FROM conversations WHERE role <> 'user' UNION ALL SELECT conv_id, turn, CAST(to_json({'t': CAST(turn AS DOUBLE) + 0.25, 'say': role}) AS VARCHAR) FROM conversations WHERE role = 'user'""")
def tick_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as ticks on a shifted clock; what is null isn't told."""
    tick = projections.pruned({"t": F.round(F.col("turn") + 0.25, 3), "say": F.when(F.col("role") == "user", F.col("role"))})
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tick.alias("tick"))


@query("""WITH {EV}, w AS (SELECT user_id, started // 86400000000 AS day, min(started) AS w0, max(ended) AS w1, max(k) AS top, min(id) AS arrival FROM ev WHERE kind <> 'error' GROUP BY ALL), d AS (SELECT *, lag(w1) OVER (PARTITION BY user_id ORDER BY arrival) AS before FROM w),
  s AS (SELECT user_id AS u, started AS t, kind || ':' || k AS state FROM ev WHERE kind = 'error'), a AS (SELECT d.*, s.state, s.t FROM d ASOF LEFT JOIN s ON d.user_id = s.u AND d.w0 >= s.t)
  SELECT user_id, day, CASE WHEN w1 < before THEN 'out_of_order' WHEN top >= 90 AND state IS NOT NULL AND w0 - t <= 432000000000 THEN 'act' WHEN top >= 90 THEN 'act_without_state' ELSE 'noop' END AS outcome, CASE WHEN w0 - t <= 432000000000 THEN state END AS prior FROM a""")
def observed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording's windows in the order they came: one that goes back is refused; others are decided by what they show
    and by the state from before them, if it is fresh."""
    rows = events(spark, sf_dir)
    windows = rows.where("kind <> 'error'").groupBy("user_id", F.floor(F.col("started") / F.lit(DAY)).alias("day")).agg(F.min("started").alias("w0"), F.max("ended").alias("w1"), F.max("k").alias("top"), F.min("id").alias("arrival"))
    windows = windows.withColumn("before", F.lag("w1").over(Window.partitionBy("user_id").orderBy("arrival")))
    state = rows.where("kind = 'error'").select("user_id", F.col("started").alias("t"), F.concat_ws(":", "kind", "k").alias("state"))
    known = asof.asof_join(windows, state, "user_id", "w0", "t", ["state"], 30 * DAY)
    fresh = F.col("w0") - F.col("t") <= 5 * DAY
    outcome = rules.first_rule([(F.col("w1") < F.col("before"), "out_of_order"), ((F.col("top") >= 90) & F.col("state").isNotNull() & fresh, "act"), (F.col("top") >= 90, "act_without_state")])
    return known.select("user_id", "day", F.coalesce(outcome, F.lit("noop")).alias("outcome"), F.when(fresh, F.col("state")).alias("prior"))

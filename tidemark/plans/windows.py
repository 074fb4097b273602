"""Queries of nested windows: a user's events of one day, with views and clicks as frames and purchases as clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import projections as P
from tidemark.operators import rules, selection, validation
from tidemark.plans.bindings import events, table
from tidemark.plans.registry import DAY, MINUTE, query

HOUR = 60 * MINUTE
WINDOWS_SQL = """{EV}, win AS (SELECT user_id, started // 86400000000 AS day, min(started) AS w0, max(ended) - (user_id % 3) * 3600000000 AS w1,
    coalesce(list({'t': started, 'id': kind || ':' || k, 'k': k, 'path': '/media/' || id} ORDER BY started, id) FILTER (kind IN ('view', 'click')), []) AS frames,
    coalesce(list({'a': started, 'b': ended, 'id': 'clip:' || k} ORDER BY started, id) FILTER (kind = 'purchase'), []) AS clips, list_sort(list(DISTINCT kind)) AS kinds FROM ev GROUP BY 1, 2)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.when(F.col("kind").isin("view", "click"), F.struct(F.col("started").alias("t"), "event", F.concat_ws(":", "kind", "k").alias("id"), "k", F.concat(F.lit("/media/"), F.col("event")).alias("path")))
    clip = F.when(F.col("kind") == "purchase", F.struct(F.col("started").alias("a"), "event", F.col("ended").alias("b"), F.concat(F.lit("clip:"), F.col("k")).alias("id")))
    rows = events(spark, sf_dir).withColumnRenamed("id", "event").groupBy("user_id", F.floor(F.col("started") / F.lit(DAY)).alias("day"))
    rows = rows.agg(F.min("started").alias("w0"), (F.max("ended") - (F.col("user_id") % 3) * HOUR).alias("w1"), F.array_sort(F.collect_list(frame)).alias("frames"), F.array_sort(F.collect_list(clip)).alias("clips"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    return rows


def _ids() -> Column:
    return F.concat(F.transform("frames", lambda f: f["id"]), F.transform("clips", lambda c: c["id"]))


def _listed(checks: dict[str, Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()])), ",")


def _sql(checks: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in checks.items()) + "], lambda x: x IS NOT NULL), ',')"


WINDOW_CHECKS = _sql({
    "reversed": "w1 < w0", "too_long": "w1 - w0 > 43200000000", "no_frames": "len(frames) = 0", "frame_outside": "len(list_filter(frames, lambda f: f.t < w0 OR f.t > w1)) > 0",
    "frames_not_increasing": "len(list_filter(range(2, len(frames) + 1), lambda i: frames[i].t <= frames[i - 1].t)) > 0", "clip_outside": "len(list_filter(clips, lambda c: c.a < w0 OR c.b > w1)) > 0",
    "clip_empty": "len(list_filter(clips, lambda c: c.b <= c.a)) > 0", "id_repeated": "len(list_distinct(ids)) < len(ids)", "id_reserved": "len(list_filter(ids, lambda x: starts_with(x, 'view:1'))) > 0", "too_many": "len(frames) + len(clips) > 3",
})


@query(f"WITH {WINDOWS_SQL}, x AS (SELECT *, list_transform(frames, lambda f: f.id) || list_transform(clips, lambda c: c.id) AS ids FROM win) SELECT user_id, day, {WINDOW_CHECKS} AS violations FROM x")
def window_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = validation.window(F.col("w0"), F.col("w1"), F.col("frames"), F.col("clips"), _ids(), 12 * HOUR, 3, "view:1")
    return _windows(spark, sf_dir).select("user_id", "day", _listed(checks).alias("violations"))


@query(f"""WITH {WINDOWS_SQL}, f AS (SELECT user_id, day, unnest(frames) AS f FROM win), c AS (SELECT user_id, day, unnest(clips) AS c FROM win)
  SELECT user_id, day, f.id AS id, 'frame' AS kind, f.t AS started, f.t AS ended FROM f UNION ALL SELECT user_id, day, c.id, 'clip', c.a, c.b FROM c
  UNION ALL SELECT user_id, day, 'span', 'span', frames[1].t, frames[-1].t FROM win WHERE len(frames) > 0""")
def evidence_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.evidence_rows(_windows(spark, sf_dir), ["user_id", "day"])


@query(f"""WITH {WINDOWS_SQL} SELECT user_id, day, array_to_string(list_sort(list_distinct(list_transform(frames, lambda f: f.id) || list_transform(clips, lambda c: c.id) || list_transform(kinds, lambda k: 'device:' || k))), ',') AS ids FROM win""")
def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices = F.transform("kinds", lambda k: F.concat(F.lit("device:"), k))
    return _windows(spark, sf_dir).select("user_id", "day", F.array_join(F.array_sort(F.array_distinct(F.concat(_ids(), devices))), ",").alias("ids"))


@query(f"""WITH {WINDOWS_SQL}, s AS (SELECT user_id, day, list_filter(frames, lambda f: f.k >= 50) AS chosen FROM win)
  SELECT user_id, day, CAST(len(chosen) AS BIGINT) AS n, chosen[1].t AS first_at, chosen[-1].t AS last_at FROM s WHERE len(chosen) > 0""")
def manifest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the frames that were chosen for the model."""
    chosen = _windows(spark, sf_dir).select("user_id", "day", F.filter("frames", lambda f: f["k"] >= 50).alias("chosen")).where(F.size("chosen") > 0)
    return chosen.select("user_id", "day", F.size("chosen").cast("long").alias("n"), F.element_at("chosen", 1)["t"].alias("first_at"), F.element_at("chosen", -1)["t"].alias("last_at"))


@query(f"""WITH {WINDOWS_SQL}, f AS (SELECT user_id, day, w0, unnest(frames) AS f FROM win)
  SELECT substr(sha256('frame:' || user_id || ':' || day || ':' || f.id), 1, 24) AS id, substr(sha256('window:' || user_id || ':' || day), 1, 20) AS win_id, f.t - w0 + 1000000 AS t FROM f""")
def retimed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames under opaque names, on a clock that begins anew in each window."""
    rows = _windows(spark, sf_dir).select("user_id", "day", "w0", F.explode("frames").alias("f"))
    return rows.select(P.opaque("frame", F.col("user_id"), F.col("day"), F.col("f.id")).alias("id"), P.opaque("window", F.col("user_id"), F.col("day"), length=20).alias("win_id"), (F.col("f.t") - F.col("w0") + 1_000_000).alias("t"))


@query(f"""WITH {WINDOWS_SQL} SELECT user_id, day, CAST(to_json({{'window': day, 'until': w1, 'frames': list_transform(frames, lambda f: {{'t': f.t, 'id': f.id, 'k': f.k}})}}) AS VARCHAR) AS context FROM win""")
def context_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is given of a window: no path, no label, nothing that isn't listed."""
    return _windows(spark, sf_dir).select("user_id", "day", P.context_json({"window": F.col("day"), "until": F.col("w1")}, F.col("frames"), ["event", "path"]).alias("context"))


@query("""SELECT doc_id, 'source=' || source || ';doc_id=' || doc_id || ';lang=' || lang || ';n_chars=' || n_chars AS policy FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def ordered_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    entries = F.create_map(*[x for c in ("n_chars", "lang", "doc_id", "source") for x in (F.lit(c), F.col(c).cast("string"))])
    return rows.select("doc_id", F.array_join(F.transform(P.ordered_keys(entries, ["source"]), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("policy"))


@query(f"""WITH {WINDOWS_SQL}, g AS (SELECT user_id, day, list_transform(range(0, 4), lambda i: round(w0 / 1000000.0::DOUBLE + i / 2.0, 3)) AS grid, w0, frames FROM win)
  SELECT user_id, day, grid[1] AS first_tick, grid[4] AS last_tick, CAST(len(list_filter(frames, lambda f: f.t / 1000000.0::DOUBLE <= grid[4])) AS BIGINT) AS frames_in_grid FROM g""")
def tick_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = S.tick_grid(F.col("w0") / 1e6, 4, 2.0)
    rows = _windows(spark, sf_dir).withColumn("grid", grid)
    return rows.select("user_id", "day", F.element_at("grid", 1).alias("first_tick"), F.element_at("grid", 4).alias("last_tick"), F.size(F.filter("frames", lambda f: f["t"] / 1e6 <= F.element_at("grid", 4))).cast("long").alias("frames_in_grid"))


DECISION_CHECKS = _sql({"noop_not_empty": "noop AND n = 0", "empty_not_noop": "n > 0 AND NOT noop", "id_repeated": "len(list_distinct(ids)) < len(ids)", "off_grid": "times <> list_distinct(times)", "kind_unknown": "what NOT IN ('act', 'wait')", "payload_missing": "what = 'act' AND payload IS NULL", "payload_not_asked": "what = 'wait' AND payload IS NOT NULL"}).replace("noop AND n = 0", "noop AND n > 0").replace("n > 0 AND NOT noop", "n = 0 AND NOT noop")


@query(f"""WITH {WINDOWS_SQL}, d AS (SELECT user_id, day, len(clips) AS n, user_id % 4 = 0 AS noop, list_transform(clips, lambda c: c.id) AS ids, list_transform(clips, lambda c: c.a // 3600000000) AS times,
    CASE WHEN day % 7 = 0 THEN 'rest' WHEN len(clips) > 0 THEN 'act' ELSE 'wait' END AS what, CASE WHEN day % 3 > 0 THEN 'p' END AS payload FROM win) SELECT user_id, day, {DECISION_CHECKS.replace("times <> list_distinct(times)", "len(list_distinct(times)) < len(times)")} AS violations FROM d""")
def decision_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = F.transform("clips", lambda c: F.floor(c["a"] / F.lit(HOUR)))
    what = F.when(F.col("day") % 7 == 0, "rest").when(F.size("clips") > 0, "act").otherwise("wait")
    checks = validation.decision(F.size("clips") == 0, F.col("user_id") % 4 == 0, F.transform("clips", lambda c: c["id"]), F.array_sort(times), F.array_sort(F.array_distinct(times)), what, F.when(F.col("day") % 3 > 0, "p"))
    return _windows(spark, sf_dir).select("user_id", "day", _listed(checks).alias("violations"))


BOXES_SQL = """b AS (SELECT vec_id, label, embedding[1]::DOUBLE * 4 + 0.3 AS x0, embedding[2]::DOUBLE * 4 + 0.3 AS y0, embedding[1]::DOUBLE * 4 + 0.5 + embedding[3]::DOUBLE AS x1, embedding[2]::DOUBLE * 4 + 0.5 + embedding[4]::DOUBLE AS y1, embedding[5]::DOUBLE * 9 AS c FROM embeddings)"""
NORMAL = "{0}x0 BETWEEN 0 AND 1 AND {0}y0 BETWEEN 0 AND 1 AND {0}x1 BETWEEN 0 AND 1 AND {0}y1 BETWEEN 0 AND 1 AND {0}x1 > {0}x0 AND {0}y1 > {0}y0"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.element_at("embedding", i).cast("double") for i in range(1, 6)]
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (e[0] * 4 + 0.3).alias("x0"), (e[1] * 4 + 0.3).alias("y0"), (e[0] * 4 + 0.5 + e[2]).alias("x1"), (e[1] * 4 + 0.5 + e[3]).alias("y1"), (e[4] * 9).alias("c"))


BOX = ("x0", "y0", "x1", "y1")


@query("WITH " + BOXES_SQL + ", t AS (SELECT *, c < 0.2 AS visible, CASE WHEN vec_id % 5 > 0 THEN x0 END AS given FROM b) SELECT vec_id, " + _sql({
    "box_without_sight": "given IS NOT NULL AND NOT visible", "sight_without_box": "visible AND given IS NULL", "box_not_normal": f"given IS NOT NULL AND NOT ({NORMAL.format('')})",
    "confidence_range": "NOT (c BETWEEN 0 AND 1)", "payload_bytes": "strlen(repeat('x', CAST(vec_id % 40 AS INTEGER))) > 32"}) + " AS violations FROM t")
def tracking_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [F.when(F.col("vec_id") % 5 > 0, F.col(c)) for c in BOX]
    checks = validation.tracking(box, F.col("c") < 0.2, F.col("c"), F.repeat(F.lit("x"), (F.col("vec_id") % 40).cast("int")), 32)
    return _boxes(spark, sf_dir).select("vec_id", _listed(checks).alias("violations"))


@query("WITH " + BOXES_SQL + f""", p AS (SELECT b.*, lag(x0) OVER w AS ax0, lag(y0) OVER w AS ay0, lag(x1) OVER w AS ax1, lag(y1) OVER w AS ay1 FROM b WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
  i AS (SELECT *, greatest(0, least(x1, ax1) - greatest(x0, ax0)) * greatest(0, least(y1, ay1) - greatest(y0, ay0)) AS shared, (x1 - x0) * (y1 - y0) AS area, (ax1 - ax0) * (ay1 - ay0) AS before FROM p WHERE ax0 IS NOT NULL)
  SELECT vec_id, CASE WHEN NOT ({NORMAL.format('')}) THEN 'not_normal' WHEN x1 - x0 < 0.15 OR y1 - y0 < 0.15 THEN 'thin' WHEN sqrt(pow((x0 + x1 - ax0 - ax1) / 2, 2) + pow((y0 + y1 - ay0 - ay1) / 2, 2)) > 0.9 THEN 'jump'
    WHEN area > 3 * before OR area * 3 < before THEN 'size' WHEN coalesce(shared / nullif(area + before - shared, 0), 0) = 0 THEN 'apart' END AS reason,
    CASE WHEN {NORMAL.format('')} AND {NORMAL.format('a')} THEN round(shared / (area + before - shared), 9) ELSE 0 END AS iou FROM i""")
def box_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.with_before(_boxes(spark, sf_dir), "label", "vec_id", list(BOX), 4096).where("before_x0 is not null")
    now, before = [F.col(c) for c in BOX], [F.col(f"before_{c}") for c in BOX]
    return rows.select("vec_id", validation.plausible(now, before, 0.9, 3.0, 0.15).alias("reason"), F.round(S.valid_box_iou(now, before), 9).alias("iou"))


@query("""WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS turns, list(length(coalesce(text, ''))::BIGINT ORDER BY turn) AS sizes, list(CASE WHEN turn % 5 = 4 THEN conv_id + 1 ELSE conv_id END ORDER BY turn) AS groups FROM conversations GROUP BY conv_id)
  SELECT conv_id, """ + _sql({"too_many": "len(turns) > 6", "over_budget": "list_sum(sizes) > 1500", "future": "len(list_filter(turns, lambda t: t >= 7)) > 0", "other_group": "len(list_filter(groups, lambda g: g <> conv_id)) > 0"}) + " AS violations FROM c")
def context_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("turn") % 5 == 4, F.col("conv_id") + 1).otherwise(F.col("conv_id"))
    turn = F.struct("turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), other.alias("of"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("x"))
    each = lambda f: F.transform("x", lambda t: t[f])
    return rows.select("conv_id", _listed(validation.context(F.lit(7), each("turn"), each("size"), F.col("conv_id"), each("of"), 6, 1500)).alias("violations"))


@query("WITH s AS (SELECT c_custkey, 'watch_' || substr(sha256(c_name), 1, CAST(2 + c_custkey % 14 AS INTEGER)) AS name, c_nationkey AS starts, c_custkey % 30 AS deadline, c_custkey % 40 AS expires, CASE c_custkey % 4 WHEN 0 THEN 'Motion' WHEN 1 THEN 'leak' WHEN 2 THEN 'door-open' ELSE '9x' END AS kind, CASE WHEN c_custkey % 5 = 0 THEN 'switch' ELSE 'light' END AS domain, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 300 END AS brightness FROM customer) SELECT c_custkey, " + _sql({
    "name": "NOT regexp_matches(name, '^watch_[a-z0-9]{4,12}$')", "deadline_before_start": "deadline <= starts", "expires_before_deadline": "expires < deadline", "kind": "NOT regexp_matches(kind, '^[a-z][a-z0-9-]{0,31}$')", "domain": "domain <> 'light'", "brightness": "NOT (brightness BETWEEN 0 AND 255)"}) + " AS violations FROM s")
def spec_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    kind = F.when(key % 4 == 0, "Motion").when(key % 4 == 1, "leak").when(key % 4 == 2, "door-open").otherwise("9x")
    name = F.concat(F.lit("watch_"), F.substring(F.sha2(F.col("c_name").cast("binary"), 256), F.lit(1), (2 + key % 14).cast("int")))
    checks = validation.watch_spec(name, F.col("c_nationkey"), key % 30, key % 40, kind, F.when(key % 5 == 0, "switch").otherwise("light"), F.lit("light.turn_on"), F.when(key % 7 != 0, key % 300))
    return table(spark, sf_dir, "customer").select("c_custkey", _listed(checks).alias("violations"))


@query("WITH c AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'set' WHEN 2 THEN 'ask' ELSE 'odd' END AS kind, list_filter([CASE WHEN o_orderkey % 3 > 0 THEN 'entity' END, CASE WHEN o_orderkey % 5 > 1 THEN 'value' END], lambda x: x IS NOT NULL) AS fields FROM orders), w AS (SELECT *, CASE kind WHEN 'stop' THEN [] WHEN 'set' THEN ['entity', 'value'] WHEN 'ask' THEN ['entity'] END AS wanted FROM c) SELECT o_orderkey, " + _sql({
    "kind_unknown": "wanted IS NULL", "field_missing": "len(list_filter(wanted, lambda x: NOT list_contains(fields, x))) > 0", "field_extra": "wanted IS NOT NULL AND len(list_filter(fields, lambda x: NOT list_contains(wanted, x))) > 0"}) + " AS violations FROM w")
def command_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.when(key % 4 == 0, "stop").when(key % 4 == 1, "set").when(key % 4 == 2, "ask").otherwise("odd")
    fields = F.array_compact(F.array(F.when(key % 3 > 0, "entity"), F.when(key % 5 > 1, "value")))
    checks = validation.exact_fields(fields, kind, {"stop": [], "set": ["entity", "value"], "ask": ["entity"]})
    return table(spark, sf_dir, "orders").select("o_orderkey", _listed(checks).alias("violations"))


@query("""SELECT doc_id, CASE WHEN toxic IS NULL OR source IS NULL THEN 'all' WHEN quality = 1 THEN 'some' ELSE 'none' END AS mask, CASE WHEN toxic IS NULL OR source IS NULL OR quality = 1 THEN lang END AS lang,
    CASE WHEN toxic IS NULL OR source IS NULL THEN n_chars END AS n_chars FROM documents LEFT JOIN labels USING (doc_id)""")
def masked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label fields by a mask that is absent (all), for some fields, or for none."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    open_ = F.col("toxic").isNull() | F.col("source").isNull()
    mask = F.when(~open_, F.create_map(F.lit("lang"), F.col("quality") == 1))
    label = P.masked_label(mask, {"lang": F.col("lang"), "n_chars": F.col("n_chars")})
    rows = rows.select("doc_id", F.when(open_, "all").when(F.col("quality") == 1, "some").otherwise("none").alias("mask"), label.alias("x"))
    return rows.select("doc_id", "mask", "x.lang", "x.n_chars")


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN value >= 10 THEN 'on' ELSE 'off' END WHEN event_type = 'purchase' THEN CASE WHEN value >= 30 THEN 'on' ELSE 'off' END ELSE event_type END AS state,
    CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN value >= 10 THEN 'true' ELSE 'false' END WHEN event_type = 'purchase' THEN CASE WHEN value >= 30 THEN 'true' ELSE 'false' END ELSE '"' || event_type || '"' END AS encoded FROM events""")
def state_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States as they come, each kind of event in its own encoding (a flag, an object with a text or a number, a text), in one form and encoded again."""
    kind, value = F.col("event_type"), F.col("value")
    word = F.to_json(F.struct(F.when(value >= 10, "ON").otherwise("Off").alias("state")))
    raw = F.when(kind == "view", (value >= 10).cast("string")).when(kind == "click", word).when(kind == "purchase", F.to_json(F.struct((value >= 30).cast("int").alias("state")))).otherwise(F.concat(F.lit('"'), kind, F.lit('"')))
    return table(spark, sf_dir, "events").select("event_id", P.state_text(raw).alias("state"), P.encoded_state(P.state_text(raw)).alias("encoded"))


SECRETS_SQL = r"""regexp_replace(regexp_replace(regexp_replace({t}, '\b(?:sk|ghp|xox[bp]|hf|rpa)[-_][A-Za-z0-9_-]{8,}', '[redacted]', 'g'), '(?i)\b(authorization\s*[:=]\s*(?:bearer\s+)?|bearer\s+)[^\s"'']+', '\1[redacted]', 'g'), '(?i)\b((?:api[_-]?key|token|password|passwd|secret)\s*[:=]\s*)[^\s"'']+', '\1[redacted]', 'g')"""


@query(r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, regexp_replace(replace(replace(coalesce(text, ''), '\', '/'), '"', ' '), '[\x00-\x1f]', ' ', 'g') AS t FROM documents), r AS (SELECT doc_id, lang, """ + SECRETS_SQL.replace("{t}", "t") + r""" AS t FROM d)
  SELECT doc_id, sha256('{"lang":"' || lang || '","notes":["' || t || '"],"token":"[redacted]"}') AS digest, contains(t, '[redacted]') AS found FROM r""")
def redacted_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a JSON note with a secret by key, paths at two depths, and the text's own secrets: all are out of it."""
    plain = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), '\\"', "/ "), r"[\x00-\x1f]", " ")
    note = F.to_json(F.struct(F.array(plain).alias("notes"), F.lit("/b").alias("path"), F.struct(F.lit("/a").alias("path")).alias("token"), F.coalesce("lang", F.lit("")).alias("lang")))
    rows = table(spark, sf_dir, "documents").select("doc_id", P.redacted(note, ("path",)).alias("clean"))
    return rows.select("doc_id", F.sha2(F.col("clean").cast("binary"), 256).alias("digest"), F.get_json_object("clean", "$.notes[0]").contains("[redacted]").alias("found"))


@query("WITH r AS (SELECT doc_id, coalesce(text, '') AS text, " + SECRETS_SQL.replace("{t}", "coalesce(text, '')") + " AS t FROM documents) SELECT doc_id, sha256(t) AS digest, t <> text AS changed FROM r")
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the secrets in it, by its digest."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("clean", P.redacted_text(F.col("text")))
    return rows.select("doc_id", F.sha2(F.col("clean").cast("binary"), 256).alias("digest"), (F.col("clean") != F.col("text")).alias("changed"))

"""Queries of scalar functions on texts, JSON, arrays and clocks, and of joins by position, fallback and synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import structures as T
from tidemark.operators import linking, scoring
from tidemark.plans.bindings import events, table
from tidemark.plans.registry import AS_OF, SECOND, query


@query("""SELECT event_id, '{"a":[1,' || (event_id % 7) || '],"k":' || regexp_extract(props, '([0-9]+)', 1) || ',"z":null}' AS canonical, sha256('{"a":[1,' || (event_id % 7) || '],"k":' || regexp_extract(props, '([0-9]+)', 1) || ',"z":null}') AS digest,
    'delivery_' || substr(sha256(event_type || chr(0) || event_id), 1, 32) AS delivery FROM events""")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    raw = F.concat(F.lit('{ "z": null, "k": '), F.regexp_extract("props", "([0-9]+)", 1), F.lit(', "a": [1, '), (F.col("event_id") % 7).cast("string"), F.lit("]}"))
    rows = rows.select("event_id", T.canonical_json(raw).alias("canonical"), T.delivery_id(F.col("event_type"), F.col("event_id").cast("string")).alias("delivery"))
    return rows.select("event_id", "canonical", T.digest(F.col("canonical")).alias("digest"), "delivery")


@query(r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)
  SELECT conv_id, turn, '{"n":' || length(text) || ',"role":"' || replace(left(regexp_replace(text, '[^a-z ]', '', 'g'), 40), ' ', '_') || '"}' AS found FROM t""")
def json_from_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with an object put into the middle of its text, in a fence or not; the object is found again."""
    text = F.coalesce("text", F.lit(""))
    role = F.replace(F.substring(F.regexp_replace(text, "[^a-z ]", ""), 1, 40), F.lit(" "), F.lit("_"))
    body = F.concat(F.lit('{"n": '), F.length(text).cast("string"), F.lit(', "role": "'), role, F.lit('",}'))
    half = F.floor(F.length(text) / 2).cast("int")
    fence = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    said = F.concat(F.substring(text, F.lit(1), half), F.lit(" {"), F.when(F.length(text) % 2 == 0, fence).otherwise(body), F.substring(text, half + 1, F.length(text)))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"))
    return rows.select("conv_id", "turn", T.json_in_prose(F.col("said"), repair=True).alias("found"))


@query("""WITH {EV}, s AS (SELECT id, k % 3 AS h, k % 60 AS m, (k * 7) % 60 AS s, k * 10 % 1000 AS f, started FROM ev) SELECT id, h * 3600 + m * 60 + s + f / 1000.0::DOUBLE AS seconds, strftime(make_timestamp(started), '%Y-%m-%dT%H:%M:%S+00:00') AS at_utc FROM s""")
def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    text = F.format_string("%02d:%02d:%02d.%03d", k % 3, k % 60, (k * 7) % 60, k * 10 % 1000)
    return events(spark, sf_dir).select("id", T.clock_seconds(text).cast("double").alias("seconds"), T.iso_utc(F.col("started")).alias("at_utc"))


@query("""WITH {EV}, x AS (SELECT id, CASE WHEN k % 3 = 0 THEN NULL ELSE started END AS a, CASE WHEN k % 4 = 0 THEN NULL ELSE ended END AS b, k FROM ev)
  SELECT id, b - a AS elapsed, least(50, CAST(floor(k / 2.5) AS BIGINT) + 1) AS due, round(k / 7.0::DOUBLE, 6) AS rounded FROM x""")
def elapsed_and_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    a, b = F.when(F.col("k") % 3 != 0, F.col("started")), F.when(F.col("k") % 4 != 0, F.col("ended"))
    return rows.select("id", (b - a).alias("elapsed"), T.arrivals_due(F.col("k"), 2.5, F.lit(50)).cast("long").alias("due"), F.round(F.col("k") / 7.0, 6).alias("rounded"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Timeout' WHEN 1 THEN 'ValueError' WHEN 2 THEN 'E' END AS class, CASE WHEN event_type IN ('view', 'click') THEN 'look' WHEN event_type = 'purchase' THEN 'buy' ELSE 'other' END AS family,
    replace(lower(trim(' Motion ' || event_type || ' ')), ' ', '-') AS kind, 'u' || user_id AS participant, user_id AS sequence FROM events""")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 4
    error = F.when(m == 0, "net.io.Timeout: after 3 s").when(m == 1, "ValueError").when(m == 2, "a.E: b.c: d").otherwise("it broke, sadly")
    area = F.concat(F.lit("cam:north:"), F.col("user_id"))
    families = {"look": ["view", "click"], "buy": ["purchase"]}
    name = F.concat(F.lit("u"), F.col("user_id"), F.lit("_day_2"))
    return table(spark, sf_dir, "events").select("event_id", T.class_name(error).alias("class"), T.family(F.col("event_type"), families).alias("family"), T.kind_token(F.concat(F.lit(" Motion "), F.col("event_type"), F.lit(" "))).alias("kind"), F.substring_index(name, "_", 1).alias("participant"), F.regexp_extract(area, r"^(.*):([0-9]+)$", 2).cast("long").alias("sequence"))


@query("""SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\p{L}])(the|und|para)([^\\p{L}]|$)') AS common, regexp_matches('phys_' || substr(sha256(coalesce(text, '')), 1, CAST(8 + doc_id % 9 AS INTEGER)), '^phys_[0-9a-f]{12,32}$') AS named, len(string_split(coalesce(text, ''), ' ')) BETWEEN 50 AND 400 AND lang IN ('en', 'de') AS candidate FROM documents""")
def caption_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by words in their text, by the form of a name, by membership and length."""
    text = F.coalesce("text", F.lit(""))
    name = F.concat(F.lit("phys_"), F.substring(F.sha2(text.cast("binary"), 256), F.lit(1), (8 + F.col("doc_id") % 9).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(r"(?i)(^|[^\p{L}])(the|und|para)([^\p{L}]|$)").alias("common"), name.rlike("^phys_[0-9a-f]{12,32}$").alias("named"), (F.size(F.split(text, " ", -1)).between(50, 400) & F.col("lang").isin("en", "de")).alias("candidate"))


@query("""WITH w AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id), p AS (SELECT a.conv_id, a.roles, b.roles AS others FROM w a JOIN w b ON b.conv_id = a.conv_id + 1),
  c AS (SELECT *, list_filter(range(1, least(len(roles), len(others)) + 1), lambda i: roles[i] <> others[i]) AS differs FROM p)
  SELECT conv_id, CAST(CASE WHEN len(differs) > 0 THEN differs[1] - 1 ELSE least(len(roles), len(others)) END AS BIGINT) AS shared,
    CAST(coalesce(list_max(list_filter(range(1, len(roles) + 1), lambda i: roles[i] <> 'assistant')), 0) AS BIGINT) AS trimmed FROM c""")
def array_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    pairs = turns.join(turns.select((F.col("conv_id") - 1).alias("conv_id"), F.col("roles").alias("others")), "conv_id")
    return pairs.select("conv_id", T.common_prefix(F.col("roles"), F.col("others")).cast("long").alias("shared"), F.size(T.trimmed(F.col("roles"), F.lit("assistant"))).cast("long").alias("trimmed"))


@query("""WITH v AS (SELECT vec_id, list_transform(range(1, 9), lambda i: CAST(floor(abs(embedding[i]) * 100) AS BIGINT) % 7) AS tokens, embedding AS e FROM embeddings)
  SELECT vec_id, array_to_string(list_transform(range(1, 9), lambda i: CASE WHEN i - 1 < vec_id % 4 OR tokens[i] IN (0, 3) THEN -100 ELSE tokens[i] END), ',') AS labels,
    len(list_filter(range(1, 9), lambda i: abs(e[i]::DOUBLE - e[i + 1]::DOUBLE) > 0.1)) / 8.0::DOUBLE AS activity, list_sum(list_transform(range(1, 9), lambda i: e[i]::DOUBLE)) < 'inf'::DOUBLE AS finite FROM v""")
def token_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    tokens = F.transform(F.slice(e, 1, 8), lambda x: F.floor(F.abs(x) * 100) % 7)
    labels = T.masked_tokens(tokens, F.col("vec_id") % 4, [0, 3])
    total = F.aggregate(F.slice(e, 1, 8), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(labels, lambda x: x.cast("string")), ",").alias("labels"), T.changed_share(F.slice(e, 1, 8), F.slice(e, 2, 8), 0.1).alias("activity"), T.finite(total).alias("finite"))


@query("""WITH f AS (SELECT o_custkey AS entity, o_orderpriority AS attribute, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS state FROM orders GROUP BY ALL)
  SELECT entity, string_agg(attribute || '=' || state, ';' ORDER BY attribute) AS states, count(*) AS n FROM f GROUP BY entity""")
def nested_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of attributes to states for each entity, spelled out in order."""
    facts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("attribute")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("state"))
    pairs = F.array_sort(F.collect_list(F.struct("attribute", "state")))
    maps = facts.groupBy("entity").agg(pairs.alias("p"), F.count("*").alias("n")).select("entity", T.nested_map(F.transform("p", lambda x: x["attribute"]), F.transform("p", lambda x: x["state"])).alias("m"), "n")
    return maps.select("entity", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("states"), "n")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events ORDER BY CAST(json_extract_string(props, '$.k') AS DOUBLE) DESC, event_id LIMIT 50""")
def json_path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).orderBy(F.desc("k"), "event_id").limit(50)


@query("""WITH {EV} SELECT user_id, median(value) AS middle, median(abs(value - m)) AS spread FROM (SELECT *, median(value) OVER (PARTITION BY user_id) AS m FROM ev) GROUP BY user_id""")
def median_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of each key's values, and the median distance from it."""
    rows = events(spark, sf_dir).select("user_id", "value")
    middle = scoring.exact_percentiles(rows, "user_id", "value", {"middle": 0.5}, linear=True)
    apart = rows.join(middle, "user_id").withColumn("d", F.abs(F.col("value") - F.col("middle")))
    return middle.join(scoring.exact_percentiles(apart, "user_id", "d", {"spread": 0.5}, linear=True), "user_id")


# --- joins


@query("""WITH a AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents), b AS (SELECT doc_id AS other, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position FROM documents)
  SELECT position, doc_id, lang, other, n_chars FROM a JOIN b USING (position)""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by number next to documents by length, row by row."""
    docs = table(spark, sf_dir, "documents")
    return linking.zipped(docs.select("doc_id", "lang"), ["doc_id"], docs.select(F.col("doc_id").alias("other"), "n_chars"), ["n_chars", "other"])


@query("""WITH r AS (SELECT event_id, user_id FROM events), a AS (SELECT DISTINCT event_id, 'event ' || event_type AS name FROM events WHERE event_id % 3 = 0), b AS (SELECT c_custkey AS user_id, c_name AS name FROM customer)
  SELECT r.event_id, coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NOT NULL THEN 'event_id' WHEN b.name IS NOT NULL THEN 'user_id' END AS found_by FROM r LEFT JOIN a USING (event_id) LEFT JOIN b ON r.user_id = b.user_id""")
def fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    first = rows.where("event_id % 3 = 0").select("event_id", F.concat(F.lit("event "), F.col("event_type")).alias("name")).distinct()
    second = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return linking.by_fallback(rows.drop("event_type"), first, "event_id", second, "user_id", "name").select("event_id", "name", "found_by")


CLASSES = [("view", "look"), ("click", "look"), ("click", "touch"), ("purchase", "touch")]


@query("""WITH {EV}, c(term, class) AS (VALUES ('view', 'look'), ('click', 'look'), ('click', 'touch'), ('purchase', 'touch')),
  t AS (SELECT DISTINCT user_id, kind, list_sort(coalesce((SELECT list('c:' || class) FROM c WHERE term = kind), ['t:' || kind])) AS classes FROM ev)
  SELECT a.user_id, a.kind AS left_term, b.kind AS right_term FROM t a JOIN t b ON b.user_id = a.user_id AND len(list_intersect(a.classes, b.classes)) > 0""")
def synonym_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's kinds that share a class; one kind may be in several."""
    kinds = events(spark, sf_dir).select("user_id", F.col("kind").alias("term")).distinct()
    classes = spark.createDataFrame(CLASSES, "term string, class string")
    return linking.by_classes(kinds, kinds, "term", classes, by=["user_id"])


@query("""WITH {EV}, s AS (SELECT DISTINCT kind || ':' || k % 10 AS value, user_id FROM ev) SELECT value, count(*) AS n, string_agg(user_id, ',' ORDER BY user_id) AS keys FROM s GROUP BY value""")
def inverted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", F.array(F.concat_ws(":", "kind", (F.col("k") % 10).cast("string"))).alias("values"))
    return linking.inverted_whole(rows, "user_id", F.col("values"), 256)


@query("""WITH r AS (SELECT doc_id, sha256(coalesce(text, '')) AS raw FROM documents), p AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE sha256(coalesce(text, '')) END AS claimed FROM documents WHERE doc_id % 7 > 0)
  SELECT r.doc_id, claimed IS NOT NULL AS predicted, coalesce(claimed = raw, false) AS verified FROM r LEFT JOIN p USING (doc_id)""")
def verified_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions next to the raw outputs they were made from, with a check of the digest that they name."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("raw"))
    claims = raw.where("doc_id % 7 > 0").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.col("raw")).alias("claimed"))
    both = raw.join(claims, "doc_id", "left")
    return both.select("doc_id", F.col("claimed").isNotNull().alias("predicted"), F.coalesce(F.col("claimed") == F.col("raw"), F.lit(False)).alias("verified"))


@query("""WITH {EV}, g AS (SELECT user_id, started // 86400000000 AS frame, kind AS label, id, k FROM ev WHERE kind = 'view'), p AS (SELECT user_id, started // 86400000000 AS frame, 'view' AS label, id AS pid, k AS pk FROM ev WHERE kind = 'click'),
  s AS (SELECT g.id, p.pid, greatest(0, least(k + 40, pk + 40) - greatest(k, pk)) / (80 - greatest(0, least(k + 40, pk + 40) - greatest(k, pk)))::DOUBLE AS iou FROM g JOIN p ON g.user_id = p.user_id AND g.frame = p.frame AND g.label = p.label)
  SELECT id, pid, round(iou, 9) AS iou FROM s WHERE iou >= 0.3""")
def frame_object_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of truth and prediction in the same frame with the same label, scored by the overlap of their boxes."""
    rows = events(spark, sf_dir).withColumn("frame", F.floor(F.col("started") / F.lit(86_400 * SECOND)))
    truth = rows.where("kind = 'view'").select("user_id", "frame", F.lit("view").alias("label"), "id", "k")
    guess = rows.where("kind = 'click'").select("user_id", "frame", F.lit("view").alias("label"), F.col("id").alias("pid"), F.col("k").alias("pk"))
    box = lambda c: [F.col(c).cast("double"), F.lit(0.0), F.col(c) + 40.0, F.lit(1.0)]
    pairs = truth.join(guess, ["user_id", "frame", "label"]).withColumn("iou", S.box_iou(box("k"), box("pk")))
    return pairs.where("iou >= 0.3").select("id", "pid", F.round("iou", 9).alias("iou"))


@query("""WITH {EV}, w AS (SELECT *, {AS_OF} AS now FROM ev WHERE kind = 'purchase') SELECT id, greatest(started, ended) + 5000000 AS available_at, now - ended AS age, CASE WHEN k % 2 = 0 THEN 'sensor' ELSE 'model' END AS origin, 1704067200.0::DOUBLE + (started / 1000000.0::DOUBLE - 1700000000.0) * 0.5 AS wall FROM w""")
def delivered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as events on the wall clock, available when they have ended at the earliest."""
    rows = events(spark, sf_dir).where("kind = 'purchase'")
    return rows.select("id", (F.greatest("started", "ended") + 5 * SECOND).alias("available_at"), (F.lit(AS_OF) - F.col("ended")).alias("age"), F.when(F.col("k") % 2 == 0, "sensor").otherwise("model").alias("origin"), (F.lit(1_704_067_200.0) + (F.col("started") / 1e6 - 1_700_000_000.0) * 0.5).alias("wall"))

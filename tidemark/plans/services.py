"""Queries of services that keep state over a key's rows: late reports, watches, an observer, commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import structures as T
from tidemark.operators import asof, lifecycle
from tidemark.plans.bindings import events, table
from tidemark.plans.registry import DAY, MINUTE, query
from tidemark.sources import committed
from tidemark.streaming import commands, late, machines, watches
from tidemark.streaming import observer as observers


def replay_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (all but errors) and reports (errors) of each user: a report names the last frame before a time of up to four
    days after its own, and is received up to four days late, or a user's report names no frame at all."""
    rows = events(spark, sf_dir)
    k, n = F.col("k"), F.col("id")
    frames = rows.where("kind <> 'error'").select("user_id", F.col("started").alias("at"), "id", F.lit("frame").alias("kind"), (k / 100.0).alias("activity"), (k % 10 > 0).alias("steady"), F.when(k > 97, "blurred").otherwise("").alias("problem"))
    reports = rows.where("kind = 'error'").select("user_id", (F.col("ended") + (n % 5) * DAY).alias("at"), "id", F.concat(F.lit("t"), n % 7).alias("track"), (F.col("started") + (n % 3) * (2 * DAY)).alias("near"))
    placed = asof.asof_join(reports, frames.select("user_id", F.col("at").alias("t")), "user_id", "near", "t", [], 30 * DAY)
    anchor = F.when(n % 11 == 0, F.col("near") + 1).otherwise(F.coalesce("t", F.col("near")))
    return frames.unionByName(placed.select("user_id", "at", "id", F.lit("report").alias("kind"), "track", anchor.alias("anchor")), allowMissingColumns=True)


def replays(state: dict) -> late.Replays:
    return late.Replays(state, memory=12, most=3, bound=0.5, confirm=3, settle=2 * DAY, pause=15 * DAY, ttl=20 * DAY)


@query()
def late_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of late reports, and what the motion of their tracks was, replayed and live."""
    return machines.fold(replay_rows(spark, sf_dir), replays, late.Replays.schema)


def _spec() -> Column:
    """A signup's watch; its parts follow from the event's number and time."""
    k, at, null = F.col("k"), F.col("ended"), F.lit(None)
    wanted = F.element_at(F.array(F.lit("view"), F.lit("click"), F.lit("purchase")), (k % 3 + 1).cast("int"))
    label, resets = F.when(k % 5 == 0, "even"), F.when(k % 3 == 0, F.array(F.lit("error")))
    seen = F.struct(wanted.alias("kind"), (k % 4 / 5.0).alias("confidence"), label.alias("label"), F.when(k % 6 == 1, F.array(F.lit("all"))).alias("subjects"), F.when(k % 9 == 2, "sensor").alias("origin"), F.when(k % 2 == 1, 90 * MINUTE).alias("needed"), F.lit(3 * DAY).alias("gap"), resets.alias("resets"), F.when(k % 7 == 0, at + 2 * DAY).alias("due"))
    done = F.struct(F.struct(F.lit("click").alias("kind"), F.when(k % 5 == 1, F.array(F.lit("error"))).alias("resets")).alias("condition"), F.lit(4 * DAY).alias("within"))
    return F.to_json(F.struct(seen.alias("condition"), ((k % 10 + 3) * DAY).alias("ttl"), F.when(k % 8 == 3, at + DAY // 2).alias("not_before"), F.when(k % 12 == 5, at + DAY).alias("deadline_at"), ((k % 3 + 1) * 30 * MINUTE).alias("respond_within"), F.lit(2 * DAY).alias("max_age"), F.when(k % 2 == 0, done).otherwise(null).alias("outcome"), (k % 4 == 1).alias("device")))


def watch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups create watches, a few are cancelled, each gets an answer a day for eight days; other events come up to three hours
    late, and every thirteenth comes twice."""
    rows = events(spark, sf_dir)
    k, n = F.col("k"), F.col("id")
    made = rows.where("kind = 'signup'").withColumn("watch", F.concat(F.lit("w"), n))
    create = made.select("user_id", F.col("ended").alias("at"), (n * 32).alias("id"), F.lit("create").alias("what"), "watch", _spec().alias("body"))
    again = made.where(k % 15 == 4).select("user_id", (F.col("ended") + DAY).alias("at"), (n * 32 + 1).alias("id"), F.lit("create").alias("what"), "watch", F.when(n % 2 == 0, _spec()).otherwise("{}").alias("body"))
    cancel = made.where(k % 16 == 9).select("user_id", (F.col("ended") + DAY // 2).alias("at"), (n * 32 + 2).alias("id"), F.lit("cancel").alias("what"), "watch")
    day = made.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(8))))
    answer = day.select("user_id", (F.col("ended") + F.col("d") * F.lit(DAY)).alias("at"), (n * 32 + 2 + F.col("d")).alias("id"), F.lit("answer").alias("what"), "watch", F.to_json(F.struct((n % 6 > 0).alias("ok"), (F.col("ended") + F.col("d") * F.lit(DAY) - MINUTE).alias("delivered"))).alias("body"))
    body = F.to_json(F.struct(F.concat(F.lit("e"), n).alias("id"), "kind", "started", "ended", (k / 100.0).alias("confidence"), F.when(k % 2 == 0, "even").otherwise("odd").alias("label"), F.when(k % 3 > 0, F.array(F.concat(F.lit("u"), F.col("user_id")), F.lit("all"))).alias("subjects"), F.when(n % 2 == 0, "sensor").otherwise("model").alias("origin")))
    other = rows.where("kind <> 'signup'")
    event = other.select("user_id", (F.col("ended") + (n % 4) * (60 * MINUTE)).alias("at"), (n * 32).alias("id"), F.lit("event").alias("what"), body.alias("body"))
    twice = other.where(n % 13 == 0).select("user_id", (F.col("ended") + (n % 4) * (60 * MINUTE) + 5 * MINUTE).alias("at"), (n * 32 + 1).alias("id"), F.lit("event").alias("what"), F.when(n % 2 == 0, body).otherwise(F.regexp_replace(body, '"odd"', '"none"')).alias("body"))
    out = create
    for part in (again, cancel, answer, event, twice):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def watch_machine(state: dict) -> watches.Watches:
    return watches.Watches(state, max_age=2 * DAY, forget=5 * DAY)


@query()
def watch_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of every watch of every user, timers included."""
    return machines.fold(watch_rows(spark, sf_dir), watch_machine, watches.Watches.schema)


# --- an observer


def observer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are facts on a user's state; the rest of a day is a window, which comes when it begins."""
    rows = events(spark, sf_dir)
    facts = rows.where("kind = 'error'").select("user_id", F.col("started").alias("at"), "id", F.lit("fact").alias("what"), F.lit("state").alias("entity"), F.concat_ws(":", "kind", "k").alias("value"))
    day = F.floor(F.col("started") / F.lit(DAY))
    windows = rows.where("kind <> 'error'").groupBy("user_id", day.alias("day")).agg(F.min("started").alias("at"), F.max("ended").alias("until"), F.max("k").alias("top"), F.min("id").alias("id"))
    shown = F.to_json(F.struct("top", "day"))
    windows = windows.select("user_id", "at", (F.col("id") + 1_000_000_000_000).alias("id"), F.lit("window").alias("what"), F.col("day").cast("string").alias("entity"), "until", shown.alias("value"))
    return facts.unionByName(windows, allowMissingColumns=True)


def _decide(shown: dict, memory: dict) -> dict:
    """A window that shows much acts on the light, and says what the room is like."""
    if shown["top"] < 90:
        return {"outcome": "noop", "observations": [["room", "quiet", 0.5 + shown["top"] / 200]]}
    return {"outcome": "act" if "state" in memory else "act_without_state", "observations": [["room", "busy", 0.9]], "actions": [["light", "on" if shown["top"] % 2 else "off"], ["room", "busy"]]}


def observer(state: dict) -> observers.Observer:
    return observers.Observer(state, _decide, lambda shown: ["top_of_98"] if shown["top"] == 98 else [], ttl=5 * DAY, cooldown=6 * DAY)


@query()
def observer_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window's outcome and memory, and what becomes of its actions."""
    return machines.fold(observer_rows(spark, sf_dir), observer, observers.Observer.schema)


# --- commands


def command_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select((F.col("user_id") * 10 + F.col("k") % 10).alias("user_id"), F.col("started").alias("at"), "id", F.when(F.col("kind") == "error", "b").otherwise("a").alias("digest"), F.col("id").cast("string").alias("body"))


def command_machine(state: dict) -> commands.Commands:
    return commands.Commands(state, lambda body, at: f"done:{body}", 5 * DAY)


@query("""WITH RECURSIVE {EV}, r AS (SELECT user_id * 10 + k % 10 AS command, id, started AS at_, CASE WHEN kind = 'error' THEN 'b' ELSE 'a' END AS digest, row_number() OVER (PARTITION BY user_id * 10 + k % 10 ORDER BY started, id) AS n FROM ev),
  q AS (SELECT command, n, at_, digest AS kept, 'done:' || id AS answer, at_ + 432000000000 AS until, 'done' AS status FROM r WHERE n = 1
    UNION ALL SELECT r.command, r.n, r.at_, CASE WHEN r.at_ >= q.until THEN r.digest ELSE q.kept END, CASE WHEN r.at_ >= q.until THEN 'done:' || r.id ELSE q.answer END, CASE WHEN r.at_ >= q.until THEN r.at_ + 432000000000 ELSE q.until END,
      CASE WHEN r.at_ >= q.until THEN 'done' WHEN r.digest = q.kept THEN 'repeated' ELSE 'conflict' END FROM q JOIN r ON r.command = q.command AND r.n = q.n + 1)
  SELECT command, status, CASE WHEN status <> 'conflict' THEN answer END AS answer, at_ AS at FROM q""")
def command_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each command is answered: its first answer for five days, a conflict for other content."""
    return machines.fold(command_rows(spark, sf_dir), command_machine, commands.Commands.schema).withColumnRenamed("user_id", "command")


# --- ingestion


def ingest_batch(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Days of users as windows; views are detections, of which some name a known track, clicks observations, purchases events."""
    rows = events(spark, sf_dir).where("kind in ('view', 'click', 'purchase')")
    k, at = F.col("k"), F.col("started").cast("double")
    rows = rows.withColumns({"window_id": F.concat_ws(":", "user_id", F.floor(F.col("started") / F.lit(DAY))), "track": F.concat(F.lit("T"), F.col("user_id") % 20), "at": at, "name": F.concat(F.lit("d"), F.col("id"))})
    windows = rows.groupBy("window_id").agg(F.min("at").alias("started"), F.max("at").alias("ended"))
    views, clicks, buys = (rows.where(F.col("kind") == kind) for kind in ("view", "click", "purchase"))
    return {
        "windows": windows,
        "objects": views.select("window_id", F.col("name").alias("detection_id"), F.when(k % 5 == 0, F.col("track")).alias("track_id"), "at", k.cast("string").alias("payload")),
        "observations": clicks.select("window_id", F.concat(F.lit("o"), F.col("id")).alias("observation_id"), F.when(k % 4 == 0, F.col("track")).alias("subject_id"), "at", k.cast("string").alias("payload")),
        "events": buys.select("window_id", F.concat(F.lit("e"), F.col("id")).alias("event_id"), F.when(k % 3 == 0, F.array("track")).otherwise(F.array().cast("array<string>")).alias("subjects"), at.alias("ended"), k.cast("string").alias("payload")),
    }


@query("""WITH {EV}, r AS (SELECT *, user_id || ':' || started // 86400000000 AS window_id, user_id % 20 AS track, (kind = 'view' AND k % 5 = 0) OR (kind = 'click' AND k % 4 = 0) OR (kind = 'purchase' AND k % 3 = 0) AS names FROM ev WHERE kind IN ('view', 'click', 'purchase')),
  w AS (SELECT window_id, min(user_id) AS user_id, min(track) AS track, max(started) AS ended, max(started) // 86400000000 AS day, bool_or(names) AS names, count_if(kind = 'view') AS objects, count_if(kind = 'view' AND k % 5 <> 0) AS fresh FROM r GROUP BY window_id),
  v AS (SELECT *, CASE WHEN user_id % 10 = 3 AND day % 2 = 1 THEN 'conflict' WHEN user_id % 10 = 3 THEN 'repeated' WHEN names AND track >= 15 THEN 'unknown_track' WHEN names AND 1704067200000000 + track * 86400000000 > ended THEN 'future_track' ELSE 'new' END AS verdict FROM w)
  SELECT window_id, verdict, CASE WHEN verdict = 'new' THEN objects ELSE 0 END AS objects, CASE WHEN verdict = 'new' THEN fresh ELSE 0 END AS tracks FROM v""")
def window_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ingesting all windows would add, where those of every tenth user are there already, half of them with other content."""
    batch = ingest_batch(spark, sf_dir)
    user, day = (F.split("window_id", ":")[i].cast("long") for i in (0, 1))
    known = committed.contents(batch).where(user % 10 == 3).withColumn("digest", F.when(day % 2 == 1, "other").otherwise(F.col("digest")))
    tracks = spark.range(15).select(F.concat(F.lit("T"), "id").alias("track_id"), (F.lit(1_704_067_200_000_000) + F.col("id") * DAY).cast("double").alias("first_seen"))
    plan = committed.planned(batch, known, tracks)
    added = plan["objects"].select("window_id", F.lit(1).alias("objects"), F.lit(0).alias("tracks")).unionByName(plan["tracks"].select("window_id", F.lit(0).alias("objects"), F.lit(1).alias("tracks")))
    added = added.groupBy("window_id").agg(F.sum("objects").alias("objects"), F.sum("tracks").alias("tracks"))
    return plan["verdicts"].join(added, "window_id", "left").select("window_id", "verdict", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("objects", "tracks")))


# --- views, identifiers, hashes

CLOCK_SQL = {
    "eligible_at": ("click", "started"), "event_source_started_at": ("click", "started"), "event_source_ended_at": ("click", "ended"), "event_available_at": ("view", "ended"), "matched_at": ("view", "started"), "response_reserved_at": ("purchase", "started"),
    "response_queued_at": ("purchase", "started"), "response_sent_at": ("purchase", "ended"), "response_verified_at": ("signup", "ended"), "outcome_source_ended_at": ("error", "ended"), "outcome_available_at": ("error", "ended"), "outcome_verified_at": ("error", "ended"),
}


@query("WITH {EV}, f AS (SELECT user_id, " + ", ".join(f"min(CASE WHEN kind = '{k}' AND k < 60 THEN {c} END) AS {name}" for name, (k, c) in CLOCK_SQL.items()) + """, min(CASE WHEN kind = 'click' AND k < 60 THEN id END) AS event_id, min(CASE WHEN kind = 'error' AND k < 60 THEN id END) AS outcome_event_id FROM ev GROUP BY user_id),
  o AS (SELECT id, ended + k * 1000000 AS delivered_at, CASE WHEN id % 5 > 0 THEN ended + 2 * k * 1000000 END AS acked_at FROM ev WHERE id % 3 > 0),
  v AS (SELECT c_custkey AS watch_id, f.* EXCLUDE (user_id, event_id, outcome_event_id), a.delivered_at AS event_delivered_at, a.acked_at AS event_acked_at, b.delivered_at AS outcome_delivered_at, b.acked_at AS outcome_acked_at FROM customer LEFT JOIN f ON f.user_id = c_custkey LEFT JOIN o a ON a.id = event_id LEFT JOIN o b ON b.id = outcome_event_id)
  SELECT *, """ + ", ".join(f"{b} - {a} AS {name}" for name, (a, b) in lifecycle.LATENCIES.items()) + " FROM v")
def watch_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's watch with its clocks, those of its deliveries, and what lies between them."""
    rows = events(spark, sf_dir)
    early = lambda kind, c: F.min(F.when((F.col("kind") == kind) & (F.col("k") < 60), F.col(c)))
    found = rows.groupBy("user_id").agg(*(early(k, c).alias(name) for name, (k, c) in CLOCK_SQL.items()), early("click", "id").alias("event_id"), early("error", "id").alias("outcome_event_id"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("watch_id"))
    watches_ = customers.join(found, F.col("user_id") == F.col("watch_id"), "left").select("watch_id", F.to_json(F.struct(*CLOCK_SQL, "event_id", "outcome_event_id")).alias("progress"))
    second = F.col("k") * 1_000_000
    outbox = rows.where("id % 3 > 0").select(F.col("id").alias("event"), (F.col("ended") + second).alias("delivered_at"), F.when(F.col("id") % 5 > 0, F.col("ended") + 2 * second).alias("acked_at"))
    return lifecycle.watch_view(watches_, outbox)


@query("""WITH c AS (SELECT event_id, ['phys', 'pevt', 'export', 'delivery', 'audit', 'pver'][1 + event_id % 6] AS prefix, 20 + event_id // 6 % 14 AS n, event_id % 7 = 3 AS upper FROM events)
  SELECT event_id, array_to_string(list_filter([CASE WHEN prefix = 'phys' THEN 'track' END, CASE WHEN prefix = 'pevt' THEN 'event' END, CASE WHEN prefix = 'phys' AND n = 32 AND NOT upper THEN 'made_track' END, CASE WHEN prefix = 'pevt' AND n = 32 AND NOT upper THEN 'made_event' END,
    CASE WHEN prefix = 'pver' AND n = 32 AND NOT upper THEN 'verification' END, CASE WHEN prefix = 'export' AND n = 32 AND NOT upper THEN 'export' END, CASE WHEN prefix = 'delivery' AND n = 32 AND NOT upper THEN 'delivery' END, CASE WHEN prefix = 'audit' AND n = 24 AND NOT upper THEN 'audit' END, CASE WHEN NOT upper THEN 'token' END, 'name'], lambda x: x IS NOT NULL), ',') AS forms FROM c""")
def identifier_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers made of an event's digest, some with a capital, and all forms that each has."""
    n = F.col("event_id")
    prefix = F.element_at(F.array(*map(F.lit, ("phys", "pevt", "export", "delivery", "audit", "pver"))), (n % 6 + 1).cast("int"))
    rest = F.substring(F.sha2(n.cast("string").cast("binary"), 256), F.lit(1), (20 + F.floor(n / 6) % 14).cast("int"))
    rest = F.when(n % 7 == 3, F.concat(F.lit("Z"), F.substring(rest, F.lit(2), F.length(rest)))).otherwise(rest)
    text = F.concat(prefix, F.lit("_"), rest)
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return rows.select("event_id", F.array_join(F.array_compact(F.array(*(F.when(S.is_identifier(form, F.col("text")), form) for form in S.IDENTIFIERS))), ",").alias("forms"))


@query("""SELECT event_id, sha256('{"export_id":"export_' || event_id || '","message":{"confidence":' || CASE WHEN event_type = 'view' THEN '1.0' ELSE '0.5' END || ',"kind":"' || event_type || '","note":null,"seen":' || CASE WHEN event_type = 'click' THEN 'true' ELSE 'false' END || '},"schema_version":"v1","topic":"events"}') AS hash FROM events""")
def export_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each event's export; every second message spells out what the others leave to the defaults."""
    kind = F.col("event_type")
    given = F.struct(kind.alias("kind"), F.when(kind == "view", 1.0).alias("confidence"), F.when(kind == "click", True).alias("seen"))
    spelt = F.struct(F.coalesce(F.when(kind == "click", True), F.lit(False)).alias("seen"), F.lit(9).alias("other"), F.when(kind == "view", 1.0).otherwise(0.5).alias("confidence"), kind.alias("kind"))
    raw = F.when(F.col("event_id") % 2 == 0, F.to_json(given)).otherwise(F.to_json(spelt))
    message = T.with_defaults(raw, {"kind": ("string", None), "confidence": ("double", 0.5), "seen": ("boolean", False), "note": ("string", None)})
    name = F.concat(F.lit("export_"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.export_hash("v1", name, F.lit("events"), message).alias("hash"))


# --- queues and windows

ACTIONS = ("claim", "complete", "fail", "crash", "expire", "claim")


def queue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as entries of a queue item; the quantity says what a line does, the supplier who."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("user_id")).agg(F.array_sort(F.collect_list(order)).alias("x"))  # an order's lines
    rows = rows.select("user_id", F.posexplode("x").alias("id", "e"))
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), (F.col("e.l_quantity").cast("int") % 6 + 1).cast("int"))
    return rows.select("user_id", F.col("id").cast("long").alias("at"), F.col("id").cast("long").alias("id"), action.alias("action"), (F.col("e.l_suppkey") % 2).cast("long").alias("owner"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, ['claim', 'complete', 'fail', 'crash', 'expire', 'claim'][1 + CAST(l_quantity AS INTEGER) % 6] AS action, l_suppkey % 2 AS who FROM lineitem),
  q AS (SELECT item, 0 AS n, 'pending' AS status, CAST(NULL AS BIGINT) AS owner, CAST(NULL AS BIGINT) AS claimed_at, 0 AS claims, 0 AS refused FROM l WHERE n = 1
    UNION ALL SELECT l.item, l.n, CASE to_ WHEN 'refused' THEN status ELSE to_ END, CASE to_ WHEN 'refused' THEN owner WHEN 'processing' THEN who END, CASE to_ WHEN 'refused' THEN claimed_at WHEN 'processing' THEN l.n - 1 END, claims + CASE to_ WHEN 'processing' THEN 1 ELSE 0 END, refused + CASE to_ WHEN 'refused' THEN 1 ELSE 0 END
    FROM q JOIN l ON l.item = q.item AND l.n = q.n + 1, LATERAL (SELECT CASE WHEN status = 'pending' AND action = 'claim' THEN 'processing' WHEN status = 'pending' AND action = 'expire' THEN 'expired' WHEN status = 'processing' AND who = owner AND action = 'complete' THEN 'complete' WHEN status = 'processing' AND who = owner AND action = 'fail' THEN 'failed' WHEN status = 'processing' AND who = owner AND action = 'crash' THEN 'pending' ELSE 'refused' END AS to_))
  SELECT item, max_by(status, n) AS status, arg_max_null(owner, n) AS owner, arg_max_null(claimed_at, n) AS claimed_at, CAST(max(claims) AS BIGINT) AS claims, CAST(max(refused) AS BIGINT) AS refused FROM q GROUP BY item""")
def queue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each queue item: who holds it since when, how often it was claimed, and what was refused."""
    return machines.fold(queue_rows(spark, sf_dir), commands.QueueItem, commands.QueueItem.schema).withColumnRenamed("user_id", "item")


@query("""WITH {EV}, l AS (SELECT user_id * 100 + k AS window_id, id, kind, CASE WHEN kind IN ('view', 'click') THEN kind END AS digest, CASE kind WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' END AS outcome FROM ev WHERE kind <> 'signup'),
  b AS (SELECT window_id, min(id) AS begun, min_by(digest, id) AS digest FROM l WHERE outcome IS NULL GROUP BY window_id),
  o AS (SELECT l.window_id, count_if(l.id > begun AND l.digest = b.digest) AS repeated, count_if(l.id > begun AND l.digest <> b.digest) AS conflicts FROM l JOIN b USING (window_id) WHERE outcome IS NULL GROUP BY l.window_id),
  f AS (SELECT l.window_id, min(id) AS finished, min_by(outcome, id) AS status FROM l JOIN b USING (window_id) WHERE outcome IS NOT NULL AND id > begun GROUP BY l.window_id)
  SELECT b.window_id, begun, digest, finished, coalesce(status, 'open') AS status, repeated, conflicts FROM b JOIN o USING (window_id) LEFT JOIN f USING (window_id)""")
def window_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows begun once, by views and clicks, and finished once, by purchases and errors."""
    kind = F.col("kind")
    log = events(spark, sf_dir).where("kind <> 'signup'").select((F.col("user_id") * 100 + F.col("k")).alias("window_id"), "id", F.when(kind.isin("view", "click"), kind).alias("digest"), F.when(kind == "purchase", "complete").when(kind == "error", "error").alias("outcome"))
    return lifecycle.begun_and_finished(log, "window_id", "id")

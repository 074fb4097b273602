"""Life cycles as folds over logs: what a table of states would hold after every entry has been applied in order.

Each takes a log (append-only rows) and gives the state by aggregation or by a window within the key; nothing is
updated in place, so a fold can be repeated and gives the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import backoff
from tidemark.operators.prefix import cell_of, running


def upsert(log: DataFrame, keys: Sequence[str], observed: str, arrival: str) -> DataFrame:
    """Of each key the value observed last; of equal times the one that arrived later."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(observed, arrival)).alias("x")).select(*keys, "x.*")


def appended(log: DataFrame, key: str, digest: str, arrival: str) -> DataFrame:
    """log with verdict: new (the key's first entry), repeated (same content again) or conflict (other content). The
    first entry of a key is a grouped minimum, joined back, so that a key with any number of entries isn't
    sorted in one task."""
    first = log.groupBy(key).agg(F.min_by(F.struct(digest, arrival), F.col(arrival)).alias("_first"))
    rows = log.join(first, key)
    verdict = F.when(F.col(arrival) == F.col("_first")[arrival], "new").when(F.col(digest) == F.col("_first")[digest], "repeated").otherwise("conflict")
    return rows.withColumn("verdict", verdict).drop("_first")


def batches_taken(entries: DataFrame, batch: str, known: Column) -> DataFrame:
    """(batch, n, taken): a batch is taken as a whole if none of its entries conflicts and all refer to what is known."""
    wrong = F.bool_or((F.col("verdict") == "conflict") | ~known)
    return entries.groupBy(batch).agg(F.count("*").alias("n"), (~F.coalesce(wrong, F.lit(False))).alias("taken"))


def deliveries(outbox: DataFrame, attempts: DataFrame, lease: int, now: int) -> DataFrame:
    """(id, attempts, delivered_at, due, status) of outbox rows (id, created) after attempts (id, at, answered, ok).

    An answer counts only within the lease of its attempt; a later one is stale. The first answer that says ok delivers,
    later attempts change nothing. What isn't delivered is due again after a back-off that doubles with
    each attempt; a lease that still runs keeps it claimed."""
    valid = F.col("answered") <= F.col("at") + lease
    done = attempts.where(valid & F.col("ok")).groupBy("id").agg(F.min("answered").alias("delivered_at"))
    made = attempts.join(done, "id", "left").where(F.col("delivered_at").isNull() | (F.col("at") <= F.col("delivered_at")))
    tried = made.groupBy("id").agg(F.count("*").alias("tries"), F.count_if(~valid).alias("stale"), F.max("at").alias("last_at"), F.first("delivered_at").alias("delivered_at"))
    rows = outbox.join(tried, "id", "left").withColumns({"attempts": F.coalesce("tries", F.lit(0)), "stale": F.coalesce("stale", F.lit(0))})
    due = F.when(F.col("delivered_at").isNull(), F.coalesce(F.col("last_at") + (backoff(F.col("attempts")) * 1_000_000).cast("long"), F.col("created")))
    status = F.when(F.col("delivered_at").isNotNull(), "delivered").when(F.col("last_at") + lease > now, "leased").when(F.col("due") <= now, "due").otherwise("waiting")
    return rows.withColumn("due", due).select("id", "attempts", "stale", "delivered_at", "due", status.alias("status"))


def acknowledgements(delivered: DataFrame, acks: DataFrame) -> DataFrame:
    """acks (id, hash, at) with verdict, against delivered (id, hash, delivered_at): the payload must be known, be the
    exact one and have been delivered before; the first good one acknowledges, others repeat it."""
    known = delivered.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "delivered_at")
    rows = acks.join(known, F.col("id") == F.col("_id"), "left")
    wrong = F.when(F.col("_id").isNull(), "unknown").when(F.col("hash") != F.col("_hash"), "other_payload").when(F.col("delivered_at").isNull() | (F.col("at") < F.col("delivered_at")), "not_delivered")
    rows = rows.withColumn("_wrong", wrong)
    first = rows.where("_wrong is null").groupBy("id").agg(F.min("at").alias("_first"))
    rows = rows.join(first, "id", "left")
    return rows.withColumn("verdict", F.coalesce("_wrong", F.when(F.col("at") == F.col("_first"), "acknowledged").otherwise("repeated"))).drop("_id", "_hash", "_wrong", "_first", "delivered_at")


def intake(log: DataFrame, now: str, most_age: int) -> DataFrame:
    """log (id, digest, ended, arrival, and `now`: when it came) with verdict: future, too_old, conflict, repeated, or
    new, which is the id's first entry that is neither."""
    early = F.when(F.col("ended") > F.col(now), "future").when(F.col(now) - F.col("ended") > most_age, "too_old")
    rows = log.withColumn("_early", early)
    first = rows.where("_early is null").groupBy("id").agg(F.min_by(F.struct("digest", "arrival"), F.col("arrival")).alias("_first"))
    rows = rows.join(first, "id", "left")
    rest = F.when(F.col("arrival") == F.col("_first.arrival"), "new").when(F.col("digest") == F.col("_first.digest"), "repeated").otherwise("conflict")
    return rows.withColumn("verdict", F.coalesce("_early", rest)).drop("_early", "_first")


def transitions(log: DataFrame, key: str, order: Sequence[str], status: str, final: Sequence[str], reopened: dict[str, str], width: int | None = None) -> DataFrame:
    """(key, status, changes): the state after all entries; width, here and below: of the cells of a key (see prefix). A final status stays, whatever comes later; at the end a status
    that a crash leaves behind goes back (reopened: processing -> pending)."""
    rows = running(log, [key], order, {"_over": ("max", F.col(status).isin(*final).cast("int"))}, cell_of(order[0], width), before=["_over"])
    taken = rows.where("_over is null or _over = 0")
    last = taken.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("s"), F.count("*").alias("changes"))
    out = F.col("s")
    for a, b in reopened.items():
        out = F.when(F.col("s") == a, b).otherwise(out)
    return last.select(key, out.alias("status"), "changes")


def late_reconciled(track: DataFrame, late: DataFrame, key: str, memory: int, width: int | None = None) -> DataFrame:
    """late (key, id, at, seen) with verdict and anchor, against a track's frames (key, t): the anchor is the last frame at or
    before `at`; a report whose anchor is gone from the last `memory` frames when it is seen has expired, one that is
    ahead of the track waits, others are replayed from the anchor (frames: how many follow it until then)."""
    frame = F.when(F.col("_side") == 0, F.col("t"))
    count = (F.col("_side") == 0).cast("int")

    def placed(rows: DataFrame, newest: str, n: str) -> DataFrame:
        """rows (t, _side = 1, ...) with the last frame at or before t, and the number of frames until then."""
        both = track.select(key, F.col("t"), F.lit(0).alias("_side")).unionByName(rows, allowMissingColumns=True)
        return running(both, [key], ["t", "_side"], {newest: ("max", frame), n: ("sum", count)}, cell_of("t", width)).where("_side = 1").drop("t", "_side")

    rows = placed(late.select(key, F.col("at").alias("t"), F.lit(1).alias("_side"), "id", "at", "seen"), "anchor", "_n")
    seen = placed(rows.select(key, F.col("seen").alias("t"), F.lit(1).alias("_side"), "id", "at", "anchor", "_n"), "_newest", "_until")
    behind = F.col("_until") - F.col("_n")
    verdict = F.when(F.col("_newest").isNull() | (F.col("at") > F.col("_newest")), "waits").when(F.col("anchor").isNull() | (behind >= memory), "expired").otherwise("replayed")
    return seen.select(key, "id", "anchor", verdict.alias("verdict"), F.when(verdict == "replayed", behind).alias("frames"))


def lateness_policies(log: DataFrame, key: str, order: Sequence[str], ended: str, now: str, most_age: int, width: int | None = None) -> DataFrame:
    """log with what each policy of late rows says: out_of_order (it ends before one that came earlier), not_monotone (it is
    not after the row before it), too_old, future."""
    rows = running(log, [key], order, {"_reach": ("max", ended), "_before": ("last", ended)}, cell_of(order[0], width), before=["_reach", "_before"])
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumns({"out_of_order": no(F.col(ended) < F.col("_reach")), "not_monotone": no(F.col(ended) <= F.col("_before")), "too_old": F.col(now) - F.col(ended) > most_age, "future": F.col(ended) > F.col(now)}).drop("_reach", "_before")


#: The clocks of a watch that its progress holds.
CLOCKS = "eligible_at event_source_started_at event_source_ended_at event_available_at matched_at response_reserved_at response_queued_at response_sent_at response_verified_at outcome_source_ended_at outcome_available_at outcome_verified_at".split()
#: What lies between two clocks, by name.
LATENCIES = {
    "source_to_available": ("event_source_ended_at", "event_available_at"),
    "available_to_match": ("event_available_at", "matched_at"),
    "source_to_delivery": ("event_source_ended_at", "event_delivered_at"),
    "source_to_response": ("event_source_ended_at", "response_sent_at"),
    "source_to_verified_response": ("event_source_ended_at", "response_verified_at"),
    "response_to_verified_outcome": ("response_sent_at", "outcome_verified_at"),
}


def watch_view(watches: DataFrame, outbox: DataFrame) -> DataFrame:
    """(watch_id, clocks, delivery clocks, latencies) of watches (watch_id, progress: JSON with event_id, outcome_event_id and the clocks) and the
    outbox (event, delivered_at, acked_at) that their events went through. A latency is null where either clock is."""
    kinds = ", ".join(["event_id long", "outcome_event_id long", *(f"{c} long" for c in CLOCKS)])
    rows = watches.select("watch_id", F.from_json("progress", kinds).alias("p")).select("watch_id", "p.*")
    for side, event in (("event", "event_id"), ("outcome", "outcome_event_id")):
        sent = outbox.select(F.col("event").alias(event), F.col("delivered_at").alias(f"{side}_delivered_at"), F.col("acked_at").alias(f"{side}_acked_at"))
        rows = rows.join(sent, event, "left")
    return rows.select("watch_id", *CLOCKS, *(f"{s}_{x}_at" for s in ("event", "outcome") for x in ("delivered", "acked")), *((F.col(b) - F.col(a)).alias(name) for name, (a, b) in LATENCIES.items()))


def begun_and_finished(log: DataFrame, key: str, arrival: str) -> DataFrame:
    """(key, begun, digest, finished, status, repeated, conflicts) of a log of begins and finishes (key, arrival, digest, outcome: null for a begin): the first
    begin counts, others repeat or contradict it; the first finish after it sets the status, until when the key is open."""
    begins, ends = log.where(F.col("outcome").isNull()), log.where(F.col("outcome").isNotNull())
    first = begins.groupBy(key).agg(F.min(arrival).alias("begun"), F.min_by("digest", arrival).alias("digest"))
    others = begins.join(first.withColumnRenamed("digest", "_digest"), key).where(F.col(arrival) > F.col("begun"))
    others = others.groupBy(key).agg(F.count_if(F.col("digest") == F.col("_digest")).alias("repeated"), F.count_if(F.col("digest") != F.col("_digest")).alias("conflicts"))
    done = ends.join(first.select(key, "begun"), key).where(F.col(arrival) > F.col("begun")).groupBy(key).agg(F.min(arrival).alias("finished"), F.min_by("outcome", arrival).alias("status"))
    rows = first.join(others, key, "left").join(done, key, "left")
    return rows.select(key, "begun", "digest", "finished", F.coalesce("status", F.lit("open")).alias("status"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("repeated", "conflicts")))

"""Decisions against policies, evidence and history; leaks in JSON of any shape; verdicts from several sources."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import rules


def policy(entity: Column, domain: Column, service: Column, brightness: Column, cited: Column, shown: Column, n: Column, length: Column, entities: Sequence[str], services: dict[str, Sequence[str]], most: int, longest: int) -> dict[str, Column]:
    """What a policy says against an action: its entity, service and their domain, the evidence that it cites, a brightness
    that is no whole number or out of range, and bounds for all actions of a decision."""
    allowed = F.lit(False)
    for d, names in services.items():
        allowed = allowed | ((domain == d) & service.isin(list(names)))
    number = brightness.try_cast("double")
    return {
        "entity": ~entity.isin(list(entities)),
        "service": ~allowed,
        "other_domain": F.substring_index(entity, ".", 1) != domain,
        "no_evidence": F.size(cited) == 0,
        "evidence": F.size(F.array_except(cited, shown)) > 0,
        "brightness_type": brightness.isNotNull() & (number.isNull() | (number != F.floor(number))),
        "brightness_range": ~number.between(0, 255),
        "too_many": n > most,
        "too_long": length > longest,
    }


def satisfied(wanted: Column, brightness: Column, state: Column, level: Column) -> Column:
    """Whether a device is already as an action wants it."""
    return (wanted == state) & (brightness.isNull() | brightness.eqNullSafe(level))


def matches(kind: Column, confidence: Column, label: Column, subjects: Column, origin: Column, spec: dict[str, Column]) -> Column:
    """Whether an event meets a condition: its kind, a least confidence, and a label, subjects and an origin where the
    condition names them (null: any)."""
    return (
        (kind == spec["kind"]) & (confidence >= spec["confidence"]) & (spec["label"].isNull() | label.eqNullSafe(spec["label"]))
        & (F.size(F.array_except(spec["subjects"], subjects)) == 0) & (spec["origin"].isNull() | origin.eqNullSafe(spec["origin"]))
    )


def resets(kind: Column, ended: Column, key: Column, kinds: Column, candidate_end: Column, candidate_key: Column) -> Column:
    """Whether an event undoes what was seen: of a kind that does, about the same key, not older than what was seen."""
    return F.array_contains(kinds, kind) & candidate_key.isNotNull() & (key == candidate_key) & (ended >= candidate_end)


def causal(assertions: DataFrame, citations: DataFrame, evidence: DataFrame, known: DataFrame) -> DataFrame:
    """(id, violations) of assertions (id, at, track) that cite (id, evidence, phase: 'pre', 'post' or null) pieces of evidence
    (evidence, started, ended): each must exist and have ended by then; tracks must be known; what is cited before and after
    must be different and in order, and after the event not from before it."""
    cited = citations.join(evidence, "evidence", "left").join(assertions.select("id", "at"), "id")
    is_ = lambda p: F.col("phase") == p
    per = cited.groupBy("id").agg(
        F.count_if(F.col("ended").isNull()).alias("unknown"), F.count_if(F.col("ended") > F.col("at")).alias("later"), F.max(F.when(is_("pre"), F.col("ended"))).alias("pre"),
        F.min(F.when(is_("post"), F.col("started"))).alias("post"), F.count_if(is_("post") & (F.col("ended") < F.col("at"))).alias("early"),
    )
    both = citations.where("phase is not null").groupBy("id", "evidence").agg(F.count_distinct("phase").alias("p")).where("p > 1").select("id").distinct().withColumn("_both", F.lit(True))
    rows = assertions.join(per, "id", "left").join(both, "id", "left").join(known.select("track", F.lit(True).alias("_known")), "track", "left")
    checks = {"no_citation": F.col("unknown").isNull(), "unknown_evidence": F.col("unknown") > 0, "future_evidence": (F.col("later") > 0) & ~F.coalesce(F.col("post").isNotNull(), F.lit(False)), "unknown_track": F.col("track").isNotNull() & F.col("_known").isNull(), "pre_and_post": F.col("_both").isNotNull(), "pre_after_post": F.col("pre") >= F.col("post"), "post_before_event": F.col("early") > 0}
    return rules.violations(rows, checks).select("id", "violations")


def history(cutoff: Column, starts: Column, group: Column, own: Column, times: Column, fields: Column, wanted: Sequence[str]) -> dict[str, Column]:
    """Context from before a window: exactly the fields, of the same group, cut off before the window, no fact later."""
    names = F.array(*map(F.lit, sorted(wanted)))
    return {"fields": ~F.array_sort(fields).eqNullSafe(names), "other_group": ~group.eqNullSafe(own), "cutoff": cutoff >= starts, "later_fact": F.exists(times, lambda t: t > cutoff)}


#: Keys that an export must not have, but for a message at the top; the form of keys; budgets.
DENIED_KEYS = tuple(
    "path paths url urls uri href manifest full_sequence_manifest raw_output content_base64 base64 media jpeg jpg png image images frame frames audio audio_path embedding embeddings features "
    "transcript ocr description uncertainty text message error summary spec result window clips payload context prompt narration evidence_ids pre_evidence_ids post_evidence_ids box boxes detection "
    "detections objects observations events tracks adapter model_id engine_url camera_id attributes data traceback exception".split()
)
KEY_FORM = r"\A[a-z][a-z0-9_]{0,47}\Z"
MOST_BYTES, MOST_DEPTH, MOST_ITEMS = 16_384, 6, 64


def flattened(column: Column) -> Column:
    """Every key and value in a JSON text: an array of (depth, key, text, items, closed); items: how many a list or object
    holds; closed: a key that must not be there, whose value isn't looked at. A text that isn't finite JSON gives one
    entry with the key '<not json>'."""
    form = re.compile(KEY_FORM)

    def refuse(name: str) -> None:
        raise ValueError(name)

    def flat(text: str) -> list[dict]:
        try:
            todo: list[tuple] = [(0, None, json.loads(text, parse_constant=refuse))]
        except ValueError:
            return [{"depth": 0, "key": "<not json>", "closed": "not_json"}]
        out = []
        while todo:
            depth, key, value = todo.pop()
            closed = None
            if key is not None:
                closed = "key_form" if not form.match(key) else "denied_key" if key in DENIED_KEYS and (depth, key) != (1, "message") else None
            inside = None if closed else list(value.items()) if isinstance(value, dict) else [(None, v) for v in value] if isinstance(value, list) else None
            out.append({"depth": depth, "key": key, "text": value if isinstance(value, str) and not closed else None, "items": None if inside is None else len(inside), "closed": closed})
            if depth <= MOST_DEPTH:
                todo += [(depth + 1, k, v) for k, v in inside or ()]
        return out

    @F.pandas_udf("array<struct<depth: int, key: string, text: string, items: int, closed: string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [{"text": None, "items": None, **x} for x in flat(t)], na_action="ignore")

    return run(column)


def leaks(df: DataFrame, key: str, column: str, version: str | None = None) -> DataFrame:
    """(key, violations) of JSON texts: budgets of bytes, depth and items, keys that are denied or of another form, a
    schema_version at the top that isn't `version`, and the rules for strings at any depth. Names are sorted."""
    each = df.select(key, F.octet_length(column).alias("_bytes"), F.explode_outer(flattened(F.col(column))).alias("x")).select(key, "_bytes", "x.*")
    marked = (F.col("key") == "schema_version") & (F.col("depth") == 1)
    each = each.withColumn("_string", F.when(~F.coalesce(marked, F.lit(False)), F.col("text")))
    checks = {
        "bytes": F.col("_bytes") > MOST_BYTES, "depth": F.col("depth") > MOST_DEPTH, "items": F.col("items") > MOST_ITEMS, "schema_version": marked & ~F.col("text").eqNullSafe(F.lit(version)),
        **{k: F.col("closed") == k for k in ("not_json", "denied_key", "key_form")}, **{f"string_{k}": c for k, c in rules.string_rules("_string").items()},
    }
    found = rules.violations(each, checks).groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("violations")))).alias("violations"))
    return found


def verdict(moved: Column, sure: Column, age: Column, stale: int, learned: Column) -> Column:
    """From geometry (moved, unmoved, ambiguous, or null), the age of what was seen, and what a model says (true, false, null)."""
    geometry = F.when(age > stale, "uncertain").when(moved.isNull() | ~sure, "uncertain").otherwise(moved)
    agrees = (geometry == "moved") == learned
    return (
        F.when(geometry.isin("uncertain", "ambiguous"), F.when(learned.isNull(), "uncertain").when(learned, "probable").otherwise("improbable"))
        .when(learned.isNull(), F.when(geometry == "moved", "confirmed").otherwise("refuted"))
        .when(agrees, F.when(learned, "confirmed").otherwise("refuted")).otherwise("contradiction")
    )

"""Projections of nested rows: what a model may see, flat evidence, opaque names, masked labels."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def opaque(purpose: str, *parts: Column, length: int = 24) -> Column:
    """A name that tells nothing: the beginning of a digest of its purpose and parts."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(purpose), *[p.cast("string") for p in parts]).cast("binary"), 256), 1, length)


def context_json(allowed: dict[str, Column], frames: Column, hidden: list[str]) -> Column:
    """JSON of the allowed columns and of frames without the hidden fields."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in allowed.items()], F.transform(frames, lambda f: f.dropFields(*hidden)).alias("frames")))


def without_nested(clips: Column, outer: list[str], inner: str, hidden: list[str]) -> Column:
    """An array of structs without some fields, and without some fields of the structs in an array inside each."""
    clean = lambda c: c.withField(inner, F.transform(c[inner], lambda f: f.dropFields(*hidden)))
    return F.transform(clips, lambda c: clean(c).dropFields(*outer) if outer else clean(c))


def pruned(fields: dict[str, Column]) -> Column:
    """JSON of the fields that aren't null, in the order given."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "true"})


def ordered_keys(entries: Column, first: list[str]) -> Column:
    """A map's entries: the keys in `first` in that order, then the others sorted."""
    places = F.array(*map(F.lit, first))
    rank = lambda e: F.struct(F.when(F.array_contains(places, e["key"]), F.array_position(places, e["key"])).otherwise(F.lit(len(first) + 1)).alias("p"), e["key"].alias("key"), e["value"].alias("value"))
    return F.transform(F.array_sort(F.transform(F.map_entries(entries), rank)), lambda e: F.struct(e["key"], e["value"]))


def evidence_rows(windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, kind, started, ended) of each frame and clip of windows with frames (t, id) and clips (a, b, id), and
    of each window's span of sampled frames, from the first to the last."""
    frames = windows.select(*keys, F.explode("frames").alias("f")).select(*keys, F.col("f.id").alias("id"), F.lit("frame").alias("kind"), F.col("f.t").alias("started"), F.col("f.t").alias("ended"))
    clips = windows.select(*keys, F.explode("clips").alias("c")).select(*keys, F.col("c.id").alias("id"), F.lit("clip").alias("kind"), F.col("c.a").alias("started"), F.col("c.b").alias("ended"))
    span = windows.where(F.size("frames") > 0).select(*keys, F.lit("span").alias("id"), F.lit("span").alias("kind"), F.element_at("frames", 1)["t"].alias("started"), F.element_at("frames", -1)["t"].alias("ended"))
    return frames.unionByName(clips).unionByName(span)


def state_text(value: Column) -> Column:
    """'on' or 'off' of a state that is given as true, 1, "on", or {"state": ...} with any of these; else the text itself."""
    inner = F.coalesce(F.get_json_object(value, "$.state"), F.regexp_replace(value, '^"|"$', ""))
    low = F.lower(inner)
    return F.when(low.isin("on", "true", "1"), "on").when(low.isin("off", "false", "0"), "off").otherwise(inner)


def encoded_state(state: Column) -> Column:
    """The inverse of state_text(), in its shortest encoding: true and false for on and off, a JSON text for others."""
    return F.when(state == "on", "true").when(state == "off", "false").otherwise(F.concat(F.lit('"'), F.regexp_replace(state, r'(["\\])', r"\\$1"), F.lit('"')))


#: Keys whose values are secret; forms of tokens; names after which a text gives a secret.
SECRET_KEY = re.compile(r"pass|token|secret|api[_-]?key|credential|authorization", re.IGNORECASE)
TOKENS = r"\b(?:sk|ghp|xox[bp]|hf|rpa)[-_][A-Za-z0-9_-]{8,}"
BEARER = r"(?i)\b(authorization\s*[:=]\s*(?:bearer\s+)?|bearer\s+)[^\s\"']+"
NAMED = r"(?i)\b((?:api[_-]?key|token|password|passwd|secret)\s*[:=]\s*)[^\s\"']+"


def redacted_text(text: Column) -> Column:
    """A text without the secrets in it: tokens by their form, and what follows a name as in `password: x` or `Authorization: Bearer x`."""
    out = F.regexp_replace(text, TOKENS, "[redacted]")
    return F.regexp_replace(F.regexp_replace(out, BEARER, "$1[redacted]"), NAMED, "$1[redacted]")


def redacted(column: Column, drop: tuple[str, ...] = ()) -> Column:
    """A JSON text without the keys in drop at any depth, secrets replaced by key and, in every string, as redacted_text() has it;
    what isn't JSON is cleaned as a text. Canonical form: keys sorted, no blanks. Built-in functions can't walk JSON of unknown
    shape: objects are cleaned as the parser closes them, innermost first."""
    gone = frozenset(drop)
    forms = [(re.compile(TOKENS, re.ASCII), "[redacted]"), (re.compile(BEARER, re.ASCII), r"\1[redacted]"), (re.compile(NAMED, re.ASCII), r"\1[redacted]")]

    def text(value: str) -> str:
        for form, mark in forms:
            value = form.sub(mark, value)
        return value

    def strings(value: object) -> object:
        """Strings, alone or in lists; objects have been closed before."""
        if isinstance(value, list):
            return [strings(v) for v in value]
        return text(value) if isinstance(value, str) else value

    def closed(pairs: list[tuple[str, object]]) -> dict[str, object]:
        return {k: "[redacted]" if SECRET_KEY.search(k) else strings(v) for k, v in pairs if k not in gone}

    def clean(raw: str) -> str:
        try:
            return json.dumps(strings(json.loads(raw, object_pairs_hook=closed)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return text(raw)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(clean, na_action="ignore")

    return run(column)


def masked_label(mask: Column, fields: dict[str, Column]) -> Column:
    """A struct of the fields that the mask (a map of field to boolean; null: all) lets through; the others are null,
    which is not the same as empty."""
    let = lambda k: mask.isNull() | F.coalesce(mask[k], F.lit(False))
    return F.struct(*[F.when(let(k), c).alias(k) for k, c in fields.items()])

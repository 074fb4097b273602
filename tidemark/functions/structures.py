"""Functions on texts, JSON and arrays: canonical JSON, keyed references, JSON in prose, clocks, prefixes, masks.

Built-in functions where they can say it. What they can't (byte-exact JSON, HMAC, brace matching) runs as
pandas UDFs over Arrow batches.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _text_udf(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return run


def canonical_json(column: Column, ascii_only: bool = True) -> Column:
    """A JSON text with sorted keys and no blanks; null for what isn't JSON, or holds a number that JSON can't."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    def f(text: str) -> str | None:
        try:
            return json.dumps(json.loads(text, parse_constant=refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)
        except ValueError:
            return None

    return _text_udf(f)(column)


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def delivery_id(topic: Column, key: Column) -> Column:
    """A name that is the same for every delivery of a key on a topic."""
    return F.concat(F.lit("delivery_"), F.substring(F.sha2(F.concat(topic, F.lit("\0"), key).cast("binary"), 256), 1, 32))


def keyed_reference(secret: bytes, purpose: str, value: Column, length: int = 24) -> Column:
    """A reference that only the holder of the secret can make: HMAC-SHA256 over purpose and value."""
    return _text_udf(lambda v: hmac.new(secret, f"{purpose}\0{v}".encode(), hashlib.sha256).hexdigest()[:length])(value)


_FENCE = re.compile(r"```(?:json)?\s*\n(.*?)```", re.DOTALL)


def json_in_prose(column: Column, repair: bool = False) -> Column:
    """The first complete JSON object in a text, from within a code fence if there is one, in canonical form; null if there
    is none. repair: commas before a closing bracket are left out."""

    def f(text: str) -> str | None:
        decoder = json.JSONDecoder()
        fenced = _FENCE.search(text)
        body = fenced[1] if fenced else text
        body = re.sub(r",(\s*[}\]])", r"\1", body) if repair else body
        at = body.find("{")
        while at >= 0:
            try:
                return json.dumps(decoder.raw_decode(body, at)[0], sort_keys=True, separators=(",", ":"))
            except ValueError:
                at = body.find("{", at + 1)
        return None

    return _text_udf(f)(column)


def clock_seconds(text: Column) -> Column:
    """hh:mm:ss.fff as seconds, exact to the microsecond."""
    parts = F.split(text, ":")
    part = lambda i: F.element_at(parts, i).cast("decimal(18,6)")
    return (part(1) * 3600 + part(2) * 60 + part(3)).cast("decimal(18,6)")


def class_name(text: Column) -> Column:
    """The class of an error text `a.b.C: what happened`; null if it has no such form."""
    return F.nullif(F.regexp_extract(text, r"^(?:[A-Za-z_]\w*\.)*([A-Za-z_]\w*)(?::|$)", 1), F.lit(""))


def kind_token(text: Column) -> Column:
    return F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("-"))


def family(kind: Column, families: dict[str, list[str]], other: str = "other") -> Column:
    """The family that a kind is listed in."""
    out = F.lit(other)
    for name, kinds in families.items():
        out = F.when(kind.isin(kinds), name).otherwise(out)
    return out


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def arrivals_due(elapsed: Column, interval: float, total: Column) -> Column:
    """How many of total arrivals at equal intervals, the first at once, are due."""
    return F.least(total, F.floor(elapsed / F.lit(interval)) + 1)


def iso_utc(micros: Column) -> Column:
    return F.date_format(F.to_timestamp_ntz(F.timestamp_micros(micros).cast("string")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def common_prefix(a: Column, b: Column) -> Column:
    """How many elements two arrays share from the start."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.transform(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y)), lambda same, i: F.when(~same, i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(differs, F.lit(0)), n)


def trimmed(values: Column, pad: Column) -> Column:
    """An array without the padding at its end."""
    kept = F.array_max(F.transform(values, lambda x, i: F.when(~x.eqNullSafe(pad), i + 1).otherwise(0)))
    return F.slice(values, F.lit(1), F.coalesce(kept, F.lit(0)))


def masked_tokens(values: Column, prefix: Column, ignored: list[int], mark: int = -100) -> Column:
    """Training labels of a token array: its prefix and ignored tokens are marked."""
    return F.transform(values, lambda x, i: F.when((i < prefix) | x.isin(ignored), F.lit(mark)).otherwise(x))


def changed_share(a: Column, b: Column, bound: float) -> Column:
    """The share of places where two vectors differ by more than bound."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y) > bound), lambda x: x)) / F.size(a)


def nested_map(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)


def with_defaults(raw: Column, fields: dict[str, tuple[str, object]]) -> Column:
    """A JSON object's fields (name: (type, default)) as a struct in order of name; a field that isn't there, or is null, has its default,
    others are left out. Null where the text is no object."""
    kinds = ", ".join(f"`{k}` {t}" for k, (t, _) in sorted(fields.items()))
    parsed = F.from_json(raw, kinds)
    whole = F.struct(*[(F.coalesce(parsed[k], F.lit(d).cast(t)) if d is not None else parsed[k]).alias(k) for k, (t, d) in sorted(fields.items())])
    return F.when(F.ltrim(raw).startswith("{") & parsed.isNotNull(), whole)


def export_hash(version: str, export_id: Column, topic: Column, message: Column) -> Column:
    """The digest of an export's canonical JSON. message: a struct, of with_defaults(), so that a default that is spelt out never changes the hash."""
    whole = F.struct(export_id.alias("export_id"), message.alias("message"), F.lit(version).alias("schema_version"), topic.alias("topic"))
    return F.when(message.isNotNull(), digest(F.to_json(whole, {"ignoreNullFields": "false"})))

"""Scalar functions as column expressions: ratios, similarities, normal forms, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {column})")


def ratio(n: Column, d: Column) -> Column:
    """n / d, null where d is 0: an unknown ratio is never 0 or 1."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def nearest_rank(column: str, p: float) -> Column:
    """The value at rank ceil(n * p) of a group."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def linear_percentile(column: str, q: float) -> Column:
    """The percentile with linear interpolation at (n - 1) * q."""
    return F.percentile(column, F.lit(q))


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over union of [a0, a1] and [b0, b1]: equal points give 1, an empty union or an interval that ends
    before it begins gives 0."""
    shared = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - shared
    valid = (a1 >= a0) & (b1 >= b0)
    return F.when(~valid, 0.0).when((a0 == b0) & (a1 == b1), 1.0).otherwise(F.coalesce(ratio(shared, union), F.lit(0.0)))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap over union of two boxes (left, top, right, bottom); 0 for an empty union."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    shared = side(0) * side(1)
    return F.coalesce(ratio(shared, area(a) + area(b) - shared), F.lit(0.0))


def valid_box_iou(a: list[Column], b: list[Column]) -> Column:
    """box_iou() of two boxes in the unit square with an area, else 0."""
    fine = F.lit(True)
    for box in (a, b):
        for x in box:
            fine = fine & x.between(0.0, 1.0)
        fine = fine & (box[2] > box[0]) & (box[3] > box[1])
    return F.when(fine, box_iou(a, b)).otherwise(0.0)


def tick_grid(start: Column, n: int, hz: float) -> Column:
    """The times of n ticks from start (seconds) on, to the millisecond."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(start + i / hz, 3))


def normal_name(text: Column) -> Column:
    """Lower case, white space collapsed to single blanks and cut at the ends; null gives ''."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(""))


def normal_token(text: Column, most: int = 48) -> Column:
    """Lower case, other characters than a-z 0-9 _ - as one dash, dashes and underscores cut at the ends, then
    at most so many characters; null if nothing is left."""
    token = F.regexp_replace(F.lower(text), "[^a-z0-9_-]+", "-")
    token = F.substring(F.regexp_replace(token, "^[-_]+|[-_]+$", ""), 1, most)
    return F.when(token.rlike("^[a-z0-9]"), token)


def vocabulary_token(token: Column, vocabulary: list[str]) -> Column:
    return F.when(token.isin(vocabulary), token).otherwise("other")


def hash_bucket(text: Column, buckets: int = 100) -> Column:
    """The first 32 bits of the SHA-256 digest, modulo buckets."""
    return (F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long") % buckets).cast("long")


def split_name(bucket: Column) -> Column:
    """70 / 15 / 15."""
    return F.when(bucket < 70, "train").when(bucket < 85, "val").otherwise("test")


def uncertainty(confidence: Column, geometric: Column) -> Column:
    level = F.when(confidence.isNull(), "unknown").when(confidence >= 0.8, "low").when(confidence >= 0.5, "medium").otherwise("high")
    return F.when(geometric & (level == "low"), "medium").otherwise(level)


def backoff(attempts: Column) -> Column:
    """Seconds to wait: doubling, at most 300."""
    return F.least(F.lit(300.0), F.pow(F.lit(2.0), F.least(attempts, F.lit(8))))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


#: The forms of identifiers, each matched as a whole.
IDENTIFIERS = {
    "track": r"phys_[A-Za-z0-9_-]{1,96}",
    "event": r"pevt_[A-Za-z0-9_-]{1,96}",
    "made_track": r"phys_[a-f0-9]{32}",
    "made_event": r"pevt_[a-f0-9]{32}",
    "verification": r"pver_[a-f0-9]{32}",
    "export": r"export_[a-f0-9]{32}",
    "delivery": r"delivery_[a-f0-9]{32}",
    "audit": r"audit_[a-f0-9]{24}",
    "digest": r"[a-f0-9]{64}",
    "token": r"[a-z][a-z0-9_-]{0,47}",
    "name": r"[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}",
}


def is_identifier(form: str, text: Column) -> Column:
    """Whether a text is, as a whole, an identifier of a form; false for null."""
    return F.coalesce(text.rlike(rf"\A(?:{IDENTIFIERS[form]})\z"), F.lit(False))

"""Validators as dicts of checks: name -> condition that is true where the row is wrong.

rules.violations() turns them into an array of names; a null condition is no violation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def increasing(values: Column) -> Column:
    """Whether an array's values are each greater than the one before."""
    n = F.size(values)
    pairs = F.zip_with(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a < b)
    return F.forall(pairs, lambda x: x)


def window(start: Column, end: Column, frames: Column, clips: Column, ids: Column, longest: int, most: int, reserved: str) -> dict[str, Column]:
    """A window of frames (t, ...) and clips (a, b): its own times, what lies outside, names, bounds."""
    return {
        "reversed": end < start,
        "too_long": end - start > longest,
        "no_frames": F.size(frames) == 0,
        "frame_outside": F.exists(frames, lambda f: (f["t"] < start) | (f["t"] > end)),
        "frames_not_increasing": ~increasing(F.transform(frames, lambda f: f["t"])),
        "clip_outside": F.exists(clips, lambda c: (c["a"] < start) | (c["b"] > end)),
        "clip_empty": F.exists(clips, lambda c: c["b"] <= c["a"]),
        "id_repeated": F.size(F.array_distinct(ids)) < F.size(ids),
        "id_reserved": F.exists(ids, lambda x: x.startswith(reserved)),
        "too_many": F.size(frames) + F.size(clips) > most,
    }


def normal_box(b: list[Column]) -> Column:
    """Whether (left, top, right, bottom) lies in the unit square and has an area."""
    inside = F.lit(True)
    for x in b:
        inside = inside & x.between(0.0, 1.0)
    return inside & (b[2] > b[0]) & (b[3] > b[1])


def tracking(box: list[Column], visible: Column, confidence: Column, payload: Column, most_bytes: int) -> dict[str, Column]:
    """A tracker's state: visible exactly if it has a normal box, a confidence in range, a bounded payload."""
    some = box[0].isNotNull()
    return {
        "box_without_sight": some & ~visible,
        "sight_without_box": visible & ~some,
        "box_not_normal": some & ~normal_box(box),
        "confidence_range": ~confidence.between(0.0, 1.0) | not_finite(confidence),
        "payload_bytes": F.octet_length(payload) > most_bytes,
    }


def plausible(now: list[Column], before: list[Column], jump: float, growth: float, thin: float) -> Column:
    """The first reason why a box can't follow the one before; null if it can."""
    width, height = now[2] - now[0], now[3] - now[1]
    centre = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    (x, y), (x0, y0) = centre(now), centre(before)
    area, area0 = width * height, (before[2] - before[0]) * (before[3] - before[1])
    return (
        F.when(~normal_box(now), "not_normal").when((width < thin) | (height < thin), "thin").when(F.hypot(x - x0, y - y0) > jump, "jump")
        .when((area > growth * area0) | (area * growth < area0), "size").when(S.box_iou(now, before) == 0, "apart")
    )


def decision(empty: Column, noop: Column, ids: Column, times: Column, grid: Column, kind: Column, payload: Column) -> dict[str, Column]:
    """A decision is a no-op exactly if it is empty, names each item once, speaks at the grid's times, and carries a
    payload exactly if its kind asks for one."""
    return {
        "noop_not_empty": noop & ~empty,
        "empty_not_noop": empty & ~noop,
        "id_repeated": F.size(F.array_distinct(ids)) < F.size(ids),
        "off_grid": times != grid,
        "kind_unknown": ~kind.isin("act", "wait"),
        "payload_missing": (kind == "act") & payload.isNull(),
        "payload_not_asked": (kind == "wait") & payload.isNotNull(),
    }


def context(now: Column, times: Column, sizes: Column, group: Column, groups: Column, most: int, budget: int) -> dict[str, Column]:
    """What may be told besides a window: at most so much, nothing from after `now`, nothing of another group."""
    return {
        "too_many": F.size(times) > most,
        "over_budget": F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x) > budget,
        "future": F.exists(times, lambda t: t >= now),
        "other_group": F.exists(groups, lambda g: g != group),
    }


def watch_spec(name: Column, starts: Column, deadline: Column, expires: Column, kind: Column, domain: Column, service: Column, brightness: Column) -> dict[str, Column]:
    """A watch's specification: its name's form, ordered lifetimes, a service of the right domain, a brightness in range."""
    return {
        "name": ~name.rlike("^watch_[a-z0-9]{4,12}$"),
        "deadline_before_start": deadline <= starts,
        "expires_before_deadline": expires < deadline,
        "kind": ~kind.rlike("^[a-z][a-z0-9-]{0,31}$"),
        "domain": F.substring_index(service, ".", 1) != domain,
        "brightness": ~brightness.between(0, 255),
    }


def exact_fields(fields: Column, kind: Column, wanted: dict[str, list[str]]) -> dict[str, Column]:
    """The fields that are set are those of the kind, no more and no fewer."""
    names = F.lit(None).cast("array<string>")
    for k, v in wanted.items():
        names = F.when(kind == k, F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")).otherwise(names)
    return {"kind_unknown": names.isNull(), "field_missing": F.size(F.array_except(names, fields)) > 0, "field_extra": F.size(F.array_except(fields, names)) > 0}


def closed(text: Column, allowed: list[str], numbers: list[str]) -> dict[str, Column]:
    """A JSON object with no other keys than the allowed ones, and finite numbers where numbers are asked for."""
    fields = F.from_json(text, "map<string, string>")
    value = lambda k: fields[k].try_cast("double")
    bad = F.lit(False)
    for k in numbers:
        bad = bad | F.coalesce(fields[k].isNotNull() & (value(k).isNull() | not_finite(value(k))), F.lit(False))
    return {"not_an_object": fields.isNull(), "other_key": F.size(F.array_except(F.map_keys(fields), F.array(*map(F.lit, allowed)))) > 0, "not_finite": bad}


def agrees(declared: Column, actual: Column, within: float) -> Column:
    return F.abs(declared - actual) <= within

"""Rules over rows: violations as arrays of codes, leak rules, change-only rules, geometric verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import box_iou
from tidemark.operators.selection import with_before


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df with `violations`: the names of the checks that hold (a null check doesn't)."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()])))


def leak_rules(column: str, long: Column) -> dict[str, Column]:
    """What a text must not carry out: long base 64, over-long or non-ASCII text, paths, URLs. Plain searches go before
    patterns, and lengths in place of one."""
    text = F.col(column)
    return {
        "base64": text.rlike("[A-Za-z0-9+/]{40,}"),
        "long": long,
        "not_ascii": F.octet_length(text) != F.char_length(text),
        "path": text.contains("/") & text.rlike("(?:^|[^A-Za-z0-9])(?:/[A-Za-z0-9_.-]+){2,}"),
        "url": text.contains("http://") | text.contains("https://"),
    }


#: Characters that count as white space, and file extensions that an export must not name.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EXTENSIONS = "jpe?g|png|webp|gif|bmp|tiff?|heic|mp4|m4v|mov|avi|mkv|webm|wav|flac|ogg|mp3|m4a|aac|json|jsonl|sqlite3?|db|txt|log|csv|npy|npz|pt|pth|safetensors|bin|gguf|tar|gz|zip"


def string_rules(column: str) -> dict[str, Column]:
    """The rules for a string of an export, in the order of their names."""
    text = F.col(column)
    return {
        "base64": text.rlike("[A-Za-z0-9+/=]{48,}") & ~text.rlike(r"\A[a-f0-9]{1,64}\z"),
        "extension": text.rlike(rf"(?i)\.({EXTENSIONS})([^a-z0-9]|\z)"),
        "long": F.char_length(text) > 128,
        "not_printable": text.rlike(r"[^\x20-\x7E]"),
        "path": text.rlike(r"(?i)[/\\]|\A(data:)|base64|\.\."),
        "space": text.rlike(SPACE),
    }


def first_rule(decided: Sequence[tuple[Column, str]]) -> Column:
    """The name of the first condition that holds, else null."""
    out = F.when(decided[0][0], F.lit(decided[0][1]))
    for condition, name in decided[1:]:
        out = out.when(condition, F.lit(name))
    return out


def changed(df: DataFrame, key: str, state: str, time: str, order: Sequence[str], stale: int) -> DataFrame:
    """df with `reason`: absent, stale or changed against the key's state before; null where it stands."""
    w = Window.partitionBy(key).orderBy(*order)
    before, at = F.lag(state).over(w), F.lag(time).over(w)
    return df.withColumns({"_before": before, "_at": at}).withColumn("reason", F.when(F.col("_before").isNull(), "absent").when(F.col(time) - F.col("_at") > stale, "stale").when(F.col("_before") != F.col(state), "changed")).drop("_before", "_at")


def geometry_verdicts(boxes: DataFrame, key: str, order: str, low: float = 0.3, high: float = 0.6, far: float = 0.15, near: float = 0.08) -> DataFrame:
    """Each box (x0, y0, x1, y1) against the key's box before: moved, unmoved or ambiguous, by overlap and by how far
    the centre went."""
    rows = with_before(boxes, key, order, ["x0", "y0", "x1", "y1"], 4096).where("before_x0 is not null")
    now, then = [F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(f"before_{c}") for c in ("x0", "y0", "x1", "y1")]
    moved = F.hypot((now[0] + now[2]) / 2 - (then[0] + then[2]) / 2, (now[1] + now[3]) / 2 - (then[1] + then[3]) / 2)
    rows = rows.withColumns({"iou": box_iou(now, then), "_moved": moved})
    return rows.withColumn("verdict", F.when((F.col("iou") < low) | (F.col("_moved") > far), "moved").when((F.col("iou") > high) & (F.col("_moved") < near), "unmoved").otherwise("ambiguous"))

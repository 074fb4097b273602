"""Repair of conversations: the cheapest edits that give roles (s?(ua)+)?, by A* on the edit lattice.

A place in the lattice is a number of rows that are done and what the roles so far end with. A row is kept (no cost), reroled to user or
assistant (3) or deleted (4); an empty row of user or assistant may be inserted anywhere (3). Blank and repeated rows
must be deleted; a truncated row that isn't deleted costs 3 more. Places are taken from a queue by (cost so far + heuristic, audit), where the audit has
the edits' initials and the heuristic adds up, over the rows to come, 4 for each row that must be deleted and 3 for each truncated
one, which pays that or more in any case. It is consistent, so a place's first visit has its least cost, and of equal costs the
ASCII-least audit. (Two audits of equal cost that lead to one place are never one the other's beginning, so their order stays
whatever follows.)

1. Faults are found row by row, and repeats by each text's first turn, as grouped minima over digests: equal rows are counted before
   they move, and what repeats a hot text is met in a join that Spark can split.
2. A conversation's rows, as codes of one byte, pass in order through one task, without their texts. Long ones are searched
   SEGMENT rows at a time, from each place that the rows before can end in; what all ways so far share of the audit is
   settled and set aside. So memory is that of the audit, which the result holds anyway.
3. The texts follow once, in the same order and behind their conversation's audit, and are digested as they pass.

Step 3 is one task for a conversation of any size, because a digest reads its bytes in order; it holds one batch of rows.

Rows (conv_id, turn, role, text): nulls of role and text count as one space. Rows are in order of turn, nulls first; equal turns by role, then by the
text's first 32 characters, then by a digest of role and text. A role's initial is its first character; an empty role has none, and
can't be kept. A null conv_id is a conversation of its own. Repeated rows are repeats (and deleted). Other columns,
whatever their names, have no effect; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches_of, stage

#: Rows that are searched at once, and rows of a conversation up to which its repair is remembered for equal ones.
SEGMENT = 256
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: A row's code: 4 times its role's initial (s, u, a, other) plus its first fault.
SOUND, BLANK, REPEAT, TRUNCATED = range(4)
#: What the roles so far are or end with.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: By place: where an inserted or reroled row leads, always the one role that may follow.
_NEXT = (USER, USER, ASSISTANT, USER)
#: By place and initial: where a kept row leads.
_KEPT = {(NOTHING, 0): SYSTEM, (NOTHING, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
_SPACES = " \t\n\x0b\x0c\r"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _search(codes: bytes, entry: int) -> dict[int, tuple[int, bytes]]:
    """For each place that the rows can end in from entry: (cost, audit), by A*."""
    rest = [0] * (len(codes) + 1)  # the heuristic
    for i in range(len(codes) - 1, -1, -1):
        rest[i] = rest[i + 1] + (0, DELETE, DELETE, min(CUT_OFF, DELETE))[codes[i] & 3]
    queue, closed, ends = [(rest[0], b"", 0, entry)], set(), {}
    while queue and len(ends) < 4:
        total, audit, i, place = heapq.heappop(queue)
        if (i, place) in closed:
            continue
        closed.add((i, place))
        cost = total - rest[i]
        after = _NEXT[place]
        heapq.heappush(queue, (total + INSERT, audit + b"I", i, after))
        if i == len(codes):
            ends[place] = (cost, audit)
            continue
        initial, fault = codes[i] >> 2, codes[i] & 3
        heapq.heappush(queue, (cost + DELETE + rest[i + 1], audit + b"D", i + 1, place))
        if fault in (SOUND, TRUNCATED):
            more = cost + rest[i + 1] + (CUT_OFF if fault == TRUNCATED else 0)
            heapq.heappush(queue, (more + REROLE, audit + b"R", i + 1, after))
            if (place, initial) in _KEPT:
                heapq.heappush(queue, (more + KEEP, audit + b"K", i + 1, _KEPT[place, initial]))
    return ends


_search_segment = lru_cache(50_000)(_search)


def _cheapest(codes: bytes) -> tuple[int, bytes]:
    ways, settled = {NOTHING: (0, b"")}, []
    for k in range(0, len(codes), SEGMENT):
        ends: dict[int, tuple[int, bytes]] = {}
        for entry, (cost, audit) in ways.items():
            for place, (more, edits) in _search_segment(codes[k : k + SEGMENT], entry).items():
                way = (cost + more, audit + edits)
                if place not in ends or way < ends[place]:
                    ends[place] = way
        shared = len(os.path.commonprefix([audit for _, audit in ends.values()]))
        settled.append(next(iter(ends.values()))[1][:shared])
        ways = {place: (cost, audit[shared:]) for place, (cost, audit) in ends.items()}
    cost, audit = min(ways[place] for place in (NOTHING, ASSISTANT) if place in ways)
    return cost, b"".join([*settled, audit])


_cheapest_short = lru_cache(50_000)(_cheapest)


def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows with these codes."""
    cost, audit = (_cheapest_short if len(codes) <= SEGMENT else _cheapest)(codes)
    return cost, audit.decode()


class _Conversation:
    """What is known of a conversation's rows so far, as they come in order."""

    def __init__(self, key: object):
        self.key, self.codes, self.turns, self.first, self.last, self.illegal = key, bytearray(), 0, None, None, 0

    def add(self, turn: int | None, code: int, n: int) -> None:
        """n equal rows, the first with this code, the others its repeats."""
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        initial = code >> 2
        if self.codes:
            self.illegal += (self.codes[-1] >> 2, initial) not in ((0, 1), (1, 2), (2, 1))
        self.illegal += n - 1  # no initial may follow itself
        self.codes.append(code)
        self.codes.extend(bytes([code if code & 3 == BLANK else initial << 2 | REPEAT]) * (n - 1))

    def row(self) -> tuple:
        codes = bytes(self.codes)
        cost, audit = cheapest(codes)
        faults = [0, 0, 0, 0]
        for code in set(codes):
            faults[code & 3] += codes.count(code)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.key, gaps, faults[BLANK], faults[REPEAT], faults[TRUNCATED], self.illegal, cost, audit)


def _planner(kind: pa.DataType):  # noqa: ANN202
    names = ["conv_id", *_COUNTS, "audit"]
    types = [kind, *[pa.int64()] * len(_COUNTS), pa.string()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, held = None, [], 0
        for batch in batches:
            for key, turn, code, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "code", "n")), strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now.row())
                        held += len(done[-1][-1]) + 100
                        if held > 4_000_000:
                            yield out(done)
                            done, held = [], 0
                    now = _Conversation(key)
                if n:
                    now.add(turn, code, n)
        if now is not None:
            yield out([*done, now.row()])

    return run


class _Digest:
    """The digest of a repaired conversation, row by row."""

    def __init__(self, audit: str):
        self.edits, self.at, self.place, self.hash, self.any = audit, 0, NOTHING, hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def inserted(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.place = _NEXT[self.place]
            self.put("user" if self.place == USER else "assistant", "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "R":
            self.place = _NEXT[self.place]
            self.put("user" if self.place == USER else "assistant", text)
        elif edit == "K":
            self.place = _KEPT[self.place, "sua".index(role[0])]
            self.put(role, text)

    def value(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations, each a row with its counts and audit and then its texts, to a row each."""
    header, digest = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*header.columns, pa.array([digest.value()])], names=[*header.schema.names, "repaired_sha256"])

    for batch in batches:
        plans = batch.select(["conv_id", *_COUNTS, "audit"])
        for i, (audit, role, text) in enumerate(zip(*(batch.column(c) for c in ("audit", "role", "text")), strict=True)):
            if audit.is_valid:
                if header is not None:
                    yield out()
                header, digest = plans.slice(i, 1), _Digest(audit.as_py())
            else:
                digest.add(role.as_py(), text.as_py())
    if header is not None:
        yield out()


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in, by crc32 of conv_id:turn (nulls: one space) modulo 20: 0 drops the row,
    1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), space)
    rows = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20)
    rows = rows.toDF("conv_id", "turn", "role", "text", "fault").where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _coded(rows: DataFrame) -> DataFrame:
    """Rows with what orders them (role, head, digest) and their codes, repeats left out."""
    core = F.rtrim(F.col("text"), F.lit(_SPACES))
    initial = F.substring("role", 1, 1)
    first = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(core == "", BLANK).when(~F.substring(core, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    named = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumns({"code": first * 4 + fault, "head": F.substring("text", 1, 32), "digest": F.substring(F.unhex(F.sha2(named.cast("binary"), 256)), 1, 16)})


def plans(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation of ids."""
    counted = _coded(rows).drop("text").groupBy("conv_id", "turn", "role", "head", "digest", "code").agg(F.count("*").alias("n"))
    counted = stage(counted, "turns")
    seen = stage(counted.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("seen")), "seen")
    counted = counted.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    repeat = (F.col("code") % 4 != BLANK) & ~F.col("seen.turn").eqNullSafe(F.col("turn"))
    code = F.when(repeat, F.col("code") - F.col("code") % 4 + REPEAT).otherwise(F.col("code"))
    counted = counted.select("conv_id", "turn", "role", "head", "digest", code.cast("int").alias("code"), "n")
    empty = ids.select("conv_id").distinct().selectExpr("conv_id", "null turn", "null role", "null head", "null digest", "0 code", "0L n")
    dealt = counted.unionByName(empty).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "head", "digest", "n")
    kind = dict(ids.dtypes)["conv_id"]
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"
    return dealt.select("conv_id", "turn", "code", "n").mapInArrow(_planner(pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), schema)


def repaired(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row for each conversation of rows, and of
    ids (conv_id) too, where a conversation without rows has zeros, an empty audit and the digest of nothing.

    conv_id is of type bigint, int or string."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text)
    found = stage(plans(rows, rows if ids is None else ids.select("conv_id")), "repairs")
    texts = _coded(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "head", "digest", "text")
    both = texts.unionByName(found.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "head", "digest").select("conv_id", *_COUNTS, "audit", "role", "text")
    with batches_of(rows.sparkSession, 8_000_000):
        return stage(dealt.mapInArrow(_digests, f"conv_id {dict(found.dtypes)['conv_id']}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"), "repaired")

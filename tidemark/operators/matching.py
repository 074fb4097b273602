"""One-to-one matching within islands of rows that can affect each other, which SQL can't state: an island's rows are in memory at once."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prefix import cell_of, running


def kuhn(edges: dict[int, list[tuple[float, int]]]) -> dict[int, int]:
    """A matching of the largest number of targets: each, in order, tries its candidates by falling score,
    then index; a taken candidate is given on if its owner can move."""
    owner: dict[int, int] = {}

    def place(target: int) -> None:
        tried: set[int] = set()
        path = [(target, iter(sorted((-s, c) for s, c in edges[target])))]
        taken: list[int] = []  # the candidate that each target of the path but the last waits for
        while path:
            for _, candidate in path[-1][1]:
                if candidate not in tried:
                    break
            else:
                path.pop()
                del taken[-1:]
                continue
            tried.add(candidate)
            taken.append(candidate)
            if candidate not in owner:
                owner.update(zip(taken, (t for t, _ in path), strict=True))
                return
            moved = owner[candidate]
            path.append((moved, iter(sorted((-s, c) for s, c in edges[moved]))))

    for target in sorted(edges):
        place(target)
    return {t: c for c, t in owner.items()}


#: How the rows of an island are matched: its rows, in any order, to (target, match, figure).
_Matcher = Callable[[list[tuple]], list[tuple]]
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _by_island(rows: DataFrame, key: str, island: str | None, columns: Sequence[str], match: _Matcher, names: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, names...): what match() makes of the rows (columns) of each island of a key. Rows come sorted by island, and one island's rows are
    held at a time, so that many small ones cost no more than their rows."""
    keys = [key, *([island] if island else [])]
    kinds = dict(rows.dtypes)
    types = [_KINDS[kinds[key]], *(_KINDS[kind] for _, kind in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[key, *(n for n, _ in names)])
        for batch in batches:
            for k, row in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if k != now:
                    out += [(now[0], *r) for r in match(held)] if held else []
                    now, held = k, []
                held.append(row)
            if len(out) >= 10_000:
                yield batch_of()
                out = []
        out += [(now[0], *r) for r in match(held)] if held else []
        if out:
            yield batch_of()

    schema = ", ".join([f"{key} {kinds[key]}", *(f"{n} {kind}" for n, kind in names)])
    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


_PAIR = (("target", "bigint"), ("match", "bigint"), ("score", "double"))


def bipartite(candidates: DataFrame, key: str, island: str | None = None) -> DataFrame:
    """(key, target, match, score) of candidate pairs (key, target, candidate, score). A column island, which no
    target and no candidate has two values of, cuts a key into groups that are matched apart, with the same result."""

    def match(pairs: list[tuple]) -> list[tuple]:
        if len(pairs) == 1:
            return pairs
        edges: dict[int, list[tuple[float, int]]] = {}
        for t, c, s in pairs:
            edges.setdefault(t, []).append((s, c))
        scores = {(t, c): s for t, c, s in pairs}
        return [(t, c, scores[t, c]) for t, c in sorted(kuhn(edges).items())]

    return _by_island(candidates, key, island, ["target", "candidate", "score"], match, _PAIR)


def greedy_nearest(rows: DataFrame, key: str, collar: int, width: int | None = None) -> DataFrame:
    """(key, a, b, distance): of rows (key, side, id, at), each of side 'a' in order of time takes the nearest free one of
    side 'b' within the collar; of equally near ones the earliest. A key is cut where neighbouring rows are more
    than the collar apart, which no pair can cross; the cuts are found in cells of width (see prefix)."""

    def match(group: list[tuple]) -> list[tuple]:
        group = sorted(group, key=lambda r: (r[2], r[1]))
        free = [(t, i) for s, i, t in group if s == "b"]
        times = [t for t, _ in free]
        out = []
        for s, i, t in group:
            if s != "a" or not free:
                continue
            after = bisect_left(times, t)
            near = [(times[after] - t, after)] if after < len(times) else []
            if after:
                near.append((t - times[after - 1], bisect_left(times, times[after - 1])))
            distance, best = min(near)
            if distance <= collar:
                out.append((i, free.pop(best)[1], distance))
                times.pop(best)
        return out

    order, cell = ["at", "id"], cell_of("at", width)
    cut = running(rows, [key], order, {"_before": ("last", "at")}, cell, before=["_before"])
    cut = running(cut, [key], order, {"_island": ("sum", F.when(F.col("at") - F.col("_before") > collar, 1).otherwise(0))}, cell)
    return _by_island(cut, key, "_island", ["side", "id", "at"], match, (("a", "bigint"), ("b", "bigint"), ("distance", "bigint")))


def first_fit(pairs: DataFrame, key: str, island: str) -> DataFrame:
    """(key, target, match, score) of candidate pairs (key, island, target, l0, candidate, w0, score): targets in order of
    time each take the first candidate, in order of time, that is still free."""

    def match(group: list[tuple]) -> list[tuple]:
        done, taken, out = set(), set(), []
        for _, t, _, c, s in sorted(group):
            if t not in done and c not in taken:
                done.add(t)
                taken.add(c)
                out.append((t, c, s))
        return out

    return _by_island(pairs, key, island, ["l0", "target", "w0", "candidate", "score"], match, _PAIR)

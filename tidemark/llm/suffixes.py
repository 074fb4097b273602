"""Repeated passages by maximal repeats of enhanced suffix arrays, built where repeats can be.

A full suffix array of a corpus doesn't fit a shuffle, so suffixes are first brought together:

1. Every window of `length` bytes picks an anchor, its least-hashed gram of GRAM bytes, by content alone:
   equal windows pick the same gram at the same place. Neighbouring windows mostly share an anchor,
   and make one context: the bytes of all windows that an anchor owns.
2. Contexts meet by their anchor's hash. Equal contexts are settled at once: all but the first are repeated
   throughout (within a task even before the shuffle). Contexts that differ, but share an anchor, go on.
3. A context is cut into pieces of windows that share a longer core than the anchor: windows that reach far to
   the left of it, and those that reach far to the right. Pieces with equal cores are a group. A group
   that is large is cut again by the same rule, so that cores grow by content until groups are
   small, or until a core is a whole window, of which a grouped minimum keeps the first.
4. In a group, the suffixes that start windows are put in order (first by their first `length` bytes, whose
   order between each other is of no importance to deeper intervals, then by the rest), with the
   common prefixes of neighbours. A stack scan walks the common-prefix intervals; suffixes that
   all have the same byte to the left are covered by the suffix one byte earlier and left out.
   An interval is a maximal repeat with all its occurrences.
5. Every occurrence of a repeat but the first is a span to remove; a document's spans are merged.

Equality of contexts rests on two 64-bit hashes, that of windows in a group on one: for a billion windows that meet,
the chance of any false match is about 3 %, and it would remove one window too many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed, stage, text_slices

GRAM = 24
#: Pieces of one group that a task puts in a suffix array at once; a larger group is cut by longer cores.
GROUP_PIECES = 20_000
#: maximal_repeats(): classes of one anchor whose windows are grouped in a task; beyond it, by Spark. Same rows.
MOST_CLASSES = 2_000
#: Windows of a text that are hashed at once.
SEGMENT = 4_000_000
_INDEX_BITS = np.uint64(24)
_LOW = np.uint64((1 << 24) - 1)
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Powers:
    """Powers of the hash's step and of its inverse, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up))
            cls.up, cls.down = (np.r_[np.uint64(1), np.cumprod(np.full(n - 1, x))] for x in (_STEP, _BACK))
        return cls.up, cls.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which every substring's hash follows."""
    up, _ = _Powers.of(len(data) + 1)
    return np.r_[np.uint64(0), np.cumsum(_BYTES[data] * up[: len(data)])]


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _Powers.of(len(sums))
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _M2)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def contexts(segments: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """For (document, start of the segment, bytes) of each segment: the contexts (document, start in the
    document, windows - 1, anchor - start, hash of the anchor's gram, hash of the context)."""
    long = [s for s in segments if len(s[2]) >= length]
    if not long:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, np.int64))
    data = np.frombuffer(b"".join(s[2] for s in long), np.uint8)
    sizes = np.array([len(s[2]) for s in long])
    base = np.cumsum(sizes) - sizes
    sums = _sums(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = _hashes(sums, at, at + GRAM)
    least = _sliding_least((grams & ~_LOW) | at.astype(np.uint64), length - GRAM + 1)
    windows = sizes - length + 1
    which = np.repeat(np.arange(len(long)), windows)
    p = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + base[which]
    anchor = (least[p] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[new[1:] - 1, len(p) - 1]
    first, span, a, which = p[new], p[last] - p[new], anchor[new], which[new]
    document, start = np.array([s[0] for s in long])[which], np.array([s[1] for s in long])[which]
    return document, first - base[which] + start, span, a - first, grams[a].view(np.int64), _hashes(sums, first, first + span + length).view(np.int64)


def _first_of_class(h: np.ndarray, e: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (anchor, context, key, place) and, in it, which rows begin a class of equal contexts."""
    order = np.lexsort((at, key, e, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (e[order][1:] != e[order][:-1])
    return order, new


#: kind: 0 a span that is settled, 1 a context to be looked at.
_ROWS = ["h", "e", "key", "at", "span", "off", "kind"]
ROWS_SCHEMA = "h long, e long, key long, at long, span int, off int, kind int"


def _batch(h, e, key, at, span, off, kind) -> pa.RecordBatch:
    arrays = [pa.array(x, pa.int64()) for x in (h, e, key, at)] + [pa.array(x.astype(np.int32)) for x in (span, off, kind)]
    return pa.RecordBatch.from_arrays(arrays, names=_ROWS)


def _segments(first: int, texts: list[bytes | None], length: int) -> Iterator[tuple[int, int, bytes]]:
    for i, text in enumerate(texts):
        text = text or b""
        for s in range(0, max(1, len(text) - length + 1), SEGMENT):
            yield first + i, s, text[s : s + SEGMENT + length - 1]


def _anchoring(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                keys = batch.column("key").to_numpy()
                found = []
                for first, texts in text_slices(batch, "text"):
                    group: list = []
                    for s in _segments(first, texts, length):
                        if sum(len(x[2]) for x in group[-1:]) + len(s[2]) > SEGMENT:
                            found.append(contexts(group, length))
                            group = []
                        group.append(s)
                    found.append(contexts(group, length))
                document, at, span, off, h, e = (np.concatenate(x) for x in zip(*found, strict=True)) if found else contexts([], length)
                key = keys[document]
                order, new = _first_of_class(h, e, key, at)
                # a repetition within the batch is settled here: its first stands for it
                h[order[~new]] = _mix(key[order[~new]].view(np.uint64) * _STEP + at[order[~new]].view(np.uint64)).view(np.int64)
                kind = np.ones(len(h), np.int32)
                kind[order[~new]] = 0
                e[kind == 0] = 0
                for i in range(0, len(h), 200_000):
                    yield _batch(*(x[i : i + 200_000] for x in (h, e, key, at, span, off, kind)))

    return run


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (h, e, key, at): settled ones as they are, later ones of a class settled, and the first of each
    class where its anchor has another class. What goes from batch to batch is one row."""
    held: tuple | None = None  # the first row of an anchor that has one class so far
    past: tuple | None = None  # the (h, e) of the last row, and whether its anchor's first row is out
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in _ROWS]
        done = rows[6] == 0
        if done.any():
            yield _batch(*(x[done] for x in rows))
            rows = [x[~done] for x in rows]
        h, e, key, at, span, off, _ = rows
        n = len(h)
        if not n:
            continue
        other = np.r_[past is None or h[0] != past[0], h[1:] != h[:-1]]  # a new anchor
        new = other | np.r_[past is None or e[0] != past[1], e[1:] != e[:-1]]  # a new class
        zero = np.zeros(int((~new).sum()), np.int64)
        if len(zero):
            yield _batch(zero, zero, key[~new], at[~new], span[~new], off[~new], zero)
        second = new & ~other  # classes after an anchor's first one
        starts = np.flatnonzero(other)
        several = np.add.reduceat(second, starts) > 0 if len(starts) else np.empty(0, bool)
        before = starts[0] if len(starts) else n  # rows that go on with the last batch's anchor
        if held is not None and second[:before].any():
            yield _batch(*(np.array([x]) for x in held))
            held = None
        if len(starts):
            held = None if several[-1] else tuple(x[starts[-1]] for x in rows)
        keep = second.copy()
        keep[starts[several]] = True
        if keep.any():
            yield _batch(h[keep], np.zeros(int(keep.sum()), np.int64), key[keep], at[keep], span[keep], off[keep], np.ones(int(keep.sum())))
        past = (h[-1], e[-1])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for start, texts in text_slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(start, len(texts)), batch.column("doc_id").slice(start, len(texts)), pa.array([press.compress(t or b"") for t in texts], pa.binary())], names=["key", "doc_id", "blob"])


#: A piece: windows at .. at + span of a document, all of which hold the core low .. low + core. code names the
#: core's bytes and how it was reached.
PIECES_SCHEMA = "code long, key long, at long, span int, low long, core int, bytes binary"
_PIECES = ["code", "key", "at", "span", "low", "core", "bytes"]
_PIECE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]


def _halves(key: int, at: int, span: int, low: int, core: int, code: int, data: bytes, length: int) -> Iterator[tuple]:
    """The piece cut in two: windows that reach at least half of what a window holds besides the core to the left of
    it, and the others, which reach far to the right. Each part has a longer core; an empty part is left out."""
    slack = length - core
    half = (slack + 1) // 2
    bound = low - half  # the last window of the left part
    for side, first, last, start, size in ((1, at, min(at + span, bound), low - half, core + half), (2, max(at, bound + 1), at + span, low, core + slack - half + 1)):
        if first <= last:
            part = data[first - at : last - at + length]
            name = xxhash.xxh3_64_intdigest(data[start - at : start - at + size], seed=code * 3 + side & 0xFFFFFFFF)
            yield name - (1 << 63), key, first, last - first, start, size, part


def _pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)], names=_PIECES)


def _cutting(length: int) -> Callable:
    """The pieces of each document's contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        rows: list[tuple] = []
        for batch in batches:
            for row in range(batch.num_rows):
                text, key = open_.decompress(batch.column("blob")[row].as_py()), batch.column("key")[row].as_py()
                for x in batch.column("places")[row].as_py():
                    data = text[x["at"] : x["at"] + x["span"] + length]
                    rows += _halves(key, x["at"], x["span"], x["at"] + x["off"], GRAM, 0, data, length)
                    if len(rows) >= 10_000:
                        yield _pieces_batch(rows)
                        rows = []
        if rows:
            yield _pieces_batch(rows)

    return run


def _cutting_again(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, key, at, span, low, core, data = (batch.column(c).to_pylist() for c in _PIECES)
            rows = [y for i in range(len(code)) for y in _halves(key[i], at[i], span[i], low[i], core[i], code[i], data[i], length)]
            if rows:
                yield _pieces_batch(rows)

    return run


def enhanced_suffix_array(texts: list[bytes], spans: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of each text that start at 0 .. span, in an order in which suffixes with equal first
    `length` bytes are together and sorted by the rest: (text, start, lcp, group), where lcp is
    the common prefix with the suffix before, 0 between groups. Groups of one suffix, and groups
    whose suffixes all follow one same byte, are left out."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    n = spans.astype(np.int64) + 1
    text = np.repeat(np.arange(len(texts)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = base[text] + start
    code = _hashes(_sums(data), place, place + length)
    left = np.where(start > 0, data[np.maximum(place - 1, 0)].astype(np.int16), -1)
    order = np.argsort(code, kind="stable")
    first = np.r_[True, code[order][1:] != code[order][:-1]] if len(order) else np.empty(0, bool)
    starts = np.flatnonzero(first)
    count = np.diff(np.r_[starts, len(order)])
    if not len(starts):
        return text[:0], start[:0], start[:0], start[:0]
    low, high = np.minimum.reduceat(left[order], starts), np.maximum.reduceat(left[order], starts)
    keep = np.repeat((count > 1) & ((low != high) | (low < 0)), count)
    group = np.repeat(np.arange(len(starts)), count)[keep]
    text, start, place = text[order][keep], start[order][keep], place[order][keep]
    rest = base[text] + sizes[text] - place - length
    width = -(-(int(rest.max(initial=0)) + 1) // 8) * 8
    columns = np.arange(width)
    tail = np.where(columns < rest[:, None], data[np.minimum(place[:, None] + length + columns, len(data) - 1)], 0).astype(np.uint8)
    words = tail.view(">u8").astype(np.uint64)
    order = np.lexsort((rest, *words.T[::-1], group))
    text, start, group, rest, tail = text[order], start[order], group[order], rest[order], tail[order]
    same = np.argmax(np.c_[tail[1:] != tail[:-1], np.ones(max(0, len(tail) - 1), bool)], axis=1) if len(tail) else np.empty(0, np.int64)
    lcp = np.zeros(len(text), np.int64)
    lcp[1:] = np.where(group[1:] == group[:-1], length + np.minimum(same, np.minimum(rest[1:], rest[:-1])), 0)
    return text, start, lcp, group


def lcp_intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each common-prefix interval, children before parents, by a stack scan."""
    stack: list[tuple[int, int]] = []
    values = [*lcp.tolist(), 0]
    for i in range(1, len(values)):
        left = i - 1
        while stack and stack[-1][0] > values[i]:
            depth, left = stack.pop()
            yield depth, left, i - 1
        if values[i] and (not stack or stack[-1][0] < values[i]):
            stack.append((values[i], left))


def later_spans(lcp: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each suffix, the length of the deepest interval in which another one ranks first, or 0.
    One stack scan: an interval keeps its first suffix only, and each suffix stops being first once."""
    out = [0] * len(lcp)
    ranks, values = rank.tolist(), [*lcp.tolist(), 0]
    stack: list[list[int]] = []  # depth, first suffix
    for i in range(1, len(values)):
        best, depth = i - 1, values[i]
        while stack and stack[-1][0] > depth:
            over, other = stack.pop()
            if ranks[other] < ranks[best]:
                best, other = other, best
            out[other] = max(out[other], over)
        if depth:
            if stack and stack[-1][0] == depth:
                other = stack[-1][1]
                if ranks[other] < ranks[best]:
                    best, other = other, best
                out[other] = max(out[other], depth)
                stack[-1][1] = best
            else:
                stack.append([depth, best])
    return np.array(out, np.int64)


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 20_000, by: str = "h") -> Iterator[pa.Table]:
    """Tables of whole groups of a partition that is sorted by them, of about so many rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows and batch.num_rows:
            table = pa.Table.from_batches(held)
            h = table.column(by).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield table.slice(0, cut)
            held, n = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def _scanning(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for table in _whole_groups(batches, by="code"):
                code = table.column("code").to_numpy()
                same = code[1:] == code[:-1]
                table = table.filter(pa.array(np.r_[False, same] | np.r_[same, False]))  # a core that stands alone repeats nothing
                if not table.num_rows:
                    continue
                key, at = table.column("key").to_numpy(), table.column("at").to_numpy()
                text, start, lcp, _ = enhanced_suffix_array(table.column("bytes").to_pylist(), table.column("span").to_numpy(), length)
                place = at[text] + start
                order = np.lexsort((place, key[text]))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                size = later_spans(lcp, rank)
                some = size > 0
                yield pa.RecordBatch.from_arrays([pa.array(key[text[some]]), pa.array(place[some]), pa.array(place[some] + size[some])], names=["key", "start", "end"])

    return run


def _candidates(rows: DataFrame, length: int) -> DataFrame:
    scanned = rows.select("key", "text").mapInArrow(_anchoring(length), ROWS_SCHEMA)
    met = scanned.repartition("h").sortWithinPartitions("h", "e", "key", "at").mapInArrow(_meeting, ROWS_SCHEMA)
    return stage(met.select("key", "at", "span", "off", "kind"), "contexts")


def _surrounded(length: int) -> Callable:
    """The contexts of each document with the bytes before and after them, -1 where the text ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                keys = batch.column("key").to_numpy()
                for first, texts in text_slices(batch, "text"):
                    for i, text in enumerate(texts):
                        for segment in _segments(i, [text], length):
                            document, at, span, _, h, e = contexts([segment], length)
                            if not len(at):
                                continue
                            data, end = np.frombuffer(text, np.uint8).astype(np.int16), at + span + length
                            left = np.where(at > 0, data[at - 1], -1)
                            right = np.where(end < len(data), data[np.minimum(end, len(data) - 1)], -1)
                            arrays = [*(pa.array(x, pa.int64()) for x in (h, e, keys[first + document], at)), *(pa.array(x.astype(np.int32)) for x in (span, left, right))]
                            yield pa.RecordBatch.from_arrays(arrays, names=["h", "e", "key", "at", "span", "before", "after"])

    return run


#: What a class of equal contexts knows of its members: their number and the range of the bytes around them.
_CLASS = ["n", "l0", "l1", "r0", "r1"]
#: what: 0 windows s .. t of the class are repeated, 1 a repeat can start at window s, 2 a repeat can end with window s.
MARKS_SCHEMA = "h long, e long, s int, t int, what int"
_WINDOWS = ["code", "h", "e", "s", *_CLASS]
WINDOWS_SCHEMA = "code long, h long, e long, s int, n long, l0 int, l1 int, r0 int, r1 int"


def _class_windows(table: pa.Table, length: int) -> dict[str, np.ndarray]:
    """Each window of each context: its code, class, place in it, number of members, range of the bytes around."""
    blobs, span = table.column("bytes").to_pylist(), table.column("span").to_numpy().astype(np.int64)
    data, sizes = np.frombuffer(b"".join(blobs), np.uint8), np.array([len(b) for b in blobs])
    text = np.repeat(np.arange(len(blobs)), span + 1)
    s = np.arange(len(text)) - np.repeat(np.cumsum(span + 1) - span - 1, span + 1)
    place = (np.cumsum(sizes) - sizes)[text] + s
    out = {c: table.column(c).to_numpy()[text] for c in ("h", "e", *_CLASS)}
    out["code"], out["s"] = _hashes(_sums(data), place, place + length).view(np.int64), s
    inner, values = s > 0, data.astype(np.int64)
    out["l0"], out["l1"] = (np.where(inner, values[np.maximum(place - 1, 0)], out[c]) for c in ("l0", "l1"))
    inner, following = s < span[text], np.minimum(place + length, len(data) - 1)
    out["r0"], out["r1"] = (np.where(inner, values[following], out[c]) for c in ("r0", "r1"))
    return out


def _coding(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for i in range(0, batch.num_rows, 2_000):
                    w = _class_windows(pa.Table.from_batches([batch.slice(i, 2_000)]), length)
                    yield pa.RecordBatch.from_arrays([pa.array(w[c].astype(np.int64 if c in ("code", "h", "e", "n") else np.int32)) for c in _WINDOWS], names=_WINDOWS)

    return run


def _marking(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for table in _whole_groups(batches):
                w = _class_windows(table, length)
                _, group = np.unique(w["code"], return_inverse=True)
                n = np.bincount(group, w["n"])[group]
                flags = [n > 1]
                for low, high in (("l0", "l1"), ("r0", "r1")):
                    least, most = np.full(group.max() + 1, 999), np.full(group.max() + 1, -1)
                    np.minimum.at(least, group, w[low])
                    np.maximum.at(most, group, w[high])
                    flags.append((n > 1) & ((least < most) | (least < 0))[group])
                s = w["s"]
                goes_on = np.r_[False, flags[0][1:] & flags[0][:-1] & (s[1:] > 0)] if len(s) else flags[0]
                begin = np.flatnonzero(flags[0] & ~goes_on)
                last = np.flatnonzero(flags[0] & ~np.r_[goes_on[1:], False])
                at = np.concatenate([begin, np.flatnonzero(flags[1]), np.flatnonzero(flags[2])])
                to = np.concatenate([last, at[len(begin) :]])
                what = np.repeat([0, 1, 2], [len(begin), flags[1].sum(), flags[2].sum()])
                arrays = [pa.array(w["h"][at]), pa.array(w["e"][at]), *(pa.array(x.astype(np.int32)) for x in (s[at], s[to], what))]
                yield pa.RecordBatch.from_arrays(arrays, names=["h", "e", "s", "t", "what"])

    return run


def _cutting_classes(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                text = open_.decompress(batch.column("blob")[row].as_py())
                cut = [(*(x[c] for c in ("h", "e", "span", "kinds", *_CLASS)), text[x["at"] : x["at"] + x["span"] + length]) for x in batch.column("places")[row].as_py()]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cut, strict=True), types, strict=True)], names=["h", "e", "span", "kinds", *_CLASS, "bytes"])

    return run


def _pairing(length: int, most: int = 500_000) -> Callable:
    """All substrings from a place where a repeat can start to one where it can end, within runs of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        with np.errstate(over="ignore"):
            for batch in batches:
                for row in range(batch.num_rows):
                    key, data = batch.column("key")[row].as_py(), np.frombuffer(open_.decompress(batch.column("blob")[row].as_py()), np.uint8)
                    marks = batch.column("marks")[row].values
                    s, t, what = (marks.field(c).to_numpy() for c in ("s", "t", "what"))
                    sums = _sums(data)
                    starts, ends = np.unique(s[what == 1]), np.unique(s[what == 2])
                    runs = np.array(merged((a, b + 1) for a, b in zip(s[what == 0].tolist(), t[what == 0].tolist(), strict=True))).reshape(-1, 2)
                    limit = runs[np.searchsorted(runs[:, 0], starts, "right") - 1, 1] if len(runs) else starts
                    low, high = np.searchsorted(ends, starts), np.searchsorted(ends, limit)
                    n = np.maximum(high - low, 0)
                    i = 0
                    while i < len(starts):
                        j = max(i + 1, int(np.searchsorted(np.cumsum(n[i:]), most, "right")) + i)
                        count = n[i:j]
                        a = np.repeat(starts[i:j], count)
                        b = ends[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[i:j], count)] + length
                        left = np.where(a > 0, data[np.maximum(a - 1, 0)].astype(np.int32), -1)
                        right = np.where(b < len(data), data[np.minimum(b, len(data) - 1)].astype(np.int32), -1)
                        arrays = [pa.array(_hashes(sums, a, b).view(np.int64)), pa.array(b - a), pa.array(np.full(len(a), key)), pa.array(a), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(arrays, names=["repeat", "length", "key", "start", "before", "after"])
                        i = j

    return run


def maximal_repeats(docs: DataFrame, length: int = 100, most: int = MOST_CLASSES) -> DataFrame:
    """(repeat, length, key, start): every occurrence of each maximal repeat of `length` bytes or more, exact copies
    among them; key as in keyed(). A maximal repeat occurs at least twice, and neither the bytes before all its
    occurrences are the same nor those after them (an end of a text differs from anything).

    A repeat starts with a window whose occurrences follow different bytes and ends with one that different bytes
    follow. Equal windows share an anchor, so these are found in classes of equal contexts: at the edges where
    an anchor has one class, else by grouping the windows of one context of each class (in a task, or,
    beyond `most` classes, by Spark's grouped minima). Substrings between such places are then grouped."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    rows = keyed(docs)
    packed = rows.mapInArrow(_packed, "key long, doc_id long, blob binary").select("key", "blob")
    met = stage(rows.select("key", "text").mapInArrow(_surrounded(length), "h long, e long, key long, at long, span int, before int, after int"), "contexts")
    shared = met.groupBy("h").agg(F.count("*").alias("members")).where("members > 1").select("h")
    met = stage(met.join(shared, "h"), "shared")
    classes = met.groupBy("h", "e").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one"), F.min("span").alias("span"), F.min("before").alias("l0"), F.max("before").alias("l1"), F.min("after").alias("r0"), F.max("after").alias("r1"))
    classes = stage(classes, "classes")
    kinds = classes.groupBy(F.col("h").alias("g")).agg(F.count("*").alias("kinds"))
    classes = classes.join(kinds, F.col("h") == F.col("g")).drop("g")
    mark = lambda s, t, what: F.struct(F.col(s).cast("int").alias("s") if isinstance(s, str) else F.lit(s).alias("s"), F.col(t).cast("int").alias("t") if isinstance(t, str) else F.lit(t).alias("t"), F.lit(what).alias("what"))
    starts, ends = F.expr("l0 < l1 or l0 < 0"), F.expr("r0 < r1 or r0 < 0")
    exploded = lambda df, *marks: df.select("h", "e", F.explode(F.array_compact(F.array(*marks))).alias("m")).select("h", "e", "m.*")
    alone = exploded(classes.where("kinds = 1"), mark(0, "span", 0), F.when(starts, mark(0, 0, 1)), F.when(ends, mark("span", "span", 2)))
    places = classes.where("kinds > 1").select(F.col("one.key").alias("key"), F.struct("h", "e", F.col("one.at").alias("at"), "span", "kinds", *_CLASS).alias("place"))
    places = places.groupBy("key").agg(F.collect_list("place").alias("places"))
    cut = stage(packed.join(places, "key").select("key", "blob", "places").mapInArrow(_cutting_classes(length), "h long, e long, span int, kinds long, n long, l0 int, l1 int, r0 int, r1 int, bytes binary"), "cut")
    few = cut.where(F.col("kinds") <= most).repartition("h").sortWithinPartitions("h").mapInArrow(_marking(length), MARKS_SCHEMA)
    windows = cut.where(F.col("kinds") > most).mapInArrow(_coding(length), WINDOWS_SCHEMA)
    codes = windows.groupBy(F.col("code").alias("c")).agg(F.sum("n").alias("n"), F.min("l0").alias("l0"), F.max("l1").alias("l1"), F.min("r0").alias("r0"), F.max("r1").alias("r1")).where("n > 1")
    many = exploded(windows.select("h", "e", "s", "code").join(codes, F.col("code") == F.col("c")), mark("s", "s", 0), F.when(starts, mark("s", "s", 1)), F.when(ends, mark("s", "s", 2)))
    marks = alone.unionByName(few).unionByName(many)
    marks = met.select("h", "e", "key", "at").join(marks, ["h", "e"]).select("key", F.struct((F.col("at") + F.col("s")).alias("s"), (F.col("at") + F.col("t")).alias("t"), "what").alias("m"))
    marks = marks.groupBy("key").agg(F.collect_list("m").alias("marks"))
    found = packed.join(marks, "key").select("key", "blob", "marks").mapInArrow(_pairing(length), "repeat long, length long, key long, start long, before int, after int")
    found = stage(found, "substrings")
    whole = found.groupBy("repeat", "length").agg(F.count("*").alias("n"), F.min("before").alias("l0"), F.max("before").alias("l1"), F.min("after").alias("r0"), F.max("after").alias("r1"))
    return found.select("repeat", "length", "key", "start").join(whole.where("n > 1").where(starts & ends).select("repeat", "length"), ["repeat", "length"])


def repeated_spans(rows: DataFrame, packed: DataFrame, length: int, most: int = GROUP_PIECES) -> DataFrame:
    """(key, start, end): spans that cover exactly the bytes which a string of `length` bytes that also
    starts earlier covers. most: pieces of a group beyond which it is cut again (the spans cover the same bytes)."""
    met = _candidates(rows, length)
    spans = met.where("kind = 0").select("key", F.col("at").alias("start"), (F.col("at") + F.col("span") + length).alias("end"))
    places = met.where("kind = 1").groupBy("key").agg(F.collect_list(F.struct("at", "span", "off")).alias("places"))
    pieces = stage(packed.join(places, "key").select("key", "blob", "places").mapInArrow(_cutting(length), PIECES_SCHEMA), "pieces")
    scan = lambda df: df.repartition("code").sortWithinPartitions("code").mapInArrow(_scanning(length), "key long, start long, end long")
    while True:
        large = stage(pieces.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") > most).select("code"), "large")
        if large.isEmpty():
            return spans.unionByName(stage(scan(pieces), "spans"))
        spans = spans.unionByName(stage(scan(pieces.join(large, "code", "left_anti")), "spans"))
        pieces = stage(pieces.join(large, "code", "left_semi").select(*_PIECES), "large-pieces")
        whole = pieces.where(F.col("core") >= length)  # one window each
        first = stage(whole.groupBy("code").agg(F.min(F.struct("key", "at")).alias("first")), "firsts")
        later = whole.join(first, "code").where(F.struct("key", "at") != F.col("first"))
        spans = spans.unionByName(later.select("key", F.col("at").alias("start"), (F.col("at") + length).alias("end")))
        pieces = stage(pieces.where(F.col("core") < length).mapInArrow(_cutting_again(length), PIECES_SCHEMA), "pieces")


def _removing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            text = open_.decompress(batch.column("blob")[row].as_py())
            spans = batch.column("spans")[row].as_py() or []
            kept, runs, removed, at = [], 0, 0, 0
            for start, end in merged((s["start"], s["end"]) for s in spans):
                kept.append(text[at:start])
                runs, removed, at = runs + 1, removed + end - start, end
            kept.append(text[at:])
            out.append((batch.column("doc_id")[row].as_py(), len(text), removed, runs, hashlib.sha256(b"".join(kept)).hexdigest()))
        if out:
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merged(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, length: int = 100, most: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row: the text's UTF-8 bytes without every
    byte that a string of `length` bytes covers which also starts earlier, in a row of smaller doc_id or
    in the same text. Matches never cross rows.

    Edge cases: a null text is empty; texts below `length` keep everything; very long texts are hashed in
    segments that overlap; null doc_ids come first; rows of equal doc_id go by text, and of equal
    rows one is the first. An empty table gives an empty table. Other columns are ignored."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    rows = keyed(docs)
    packed = rows.mapInArrow(_packed, "key long, doc_id long, blob binary")
    spans = repeated_spans(rows, packed, length, most).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = packed.join(spans.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left").select("doc_id", "blob", "spans")
    return joined.mapInArrow(_removing, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

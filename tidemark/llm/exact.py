"""Exact duplicates by a tree-merge of sorted digest runs.

1. One scan makes a row for each document: its place, its id, and a key of 48 bytes, which is the SHA-256 of its text, the
   text's length in bytes and a second hash by another function. Texts leave the scan no further than that.
2. The rows of a partition, sorted by key, are its run: an entry for each key, with the best identifier and the
   number of rows. A partition is a node, named by a number of `rounds` digits.
3. In each round nodes exchange runs along one digit: a node sends each entry to the node whose name differs from its own in
   that digit only, which becomes the digit of the entry's key. So a node gets sorted pieces from `fan` partners, and merges
   them in order, block by block. After the last round all entries of a key are at the node that it names.
   With a fan of two these are the rounds of a binomial tree; a larger fan takes several of them at once.
4. At every level entries merge only if digest, length and second hash all agree, so an identifier is never retained
   for a text that merely shares a digest. The best identifier and the number of rows go on: a text that
   a third of all rows have is one entry in each run, and the work of a node follows the keys that it holds.
5. Keys of several rows go back to the rows. Those that more than one row in `HEAVY` has (so at most HEAVY of them) are broadcast, the
   others meet their rows by key, where the rows of a heavy key are spread by their place.

Rows. A null text is empty. Of equal texts the row with the largest (or smallest) doc_id stays; rows without a
doc_id come last, and of rows that are equal in both, one stays (repeated rows give repeated results, of which one is
kept). If no row of a group has a doc_id, keep_id is null. Only doc_id and text are read; other columns, whatever their
names, have no effect. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: Bits of a digit of a node's name: 2 ** BITS partners meet in a round.
BITS = 3
#: Entries that a node holds on average in the last round, at most.
NODE_ENTRIES = 250_000
#: Entries in a piece of a run, which is one row of an exchange (73 bytes each).
PIECE = 16_384
#: A key is broadcast if it has more than this share of all rows, so the broadcast has fewer rows than this (72 bytes each).
HEAVY = 10_000
#: An entry: the key, whether the identifier is missing, its order (smallest first), its row, the rows of the key.
ENTRY = np.dtype([("key", "S48"), ("missing", "u1"), ("order", "<i8"), ("place", "<i8"), ("n", "<i8")])
_PIECES = "node int, first binary, entries binary"


def text_key(text: Column) -> Column:
    """48 bytes: SHA-256, length in bytes, and a hash by another function, of a text."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    number = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    return F.concat(F.unhex(F.sha2(data, 256)), number(F.octet_length(data).cast("long")), number(F.xxhash64(data)))


def _prefixes(entries: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the keys, as numbers in the order of the keys."""
    return np.ndarray(len(entries), ">u8", entries, 0, entries.strides).astype(np.uint64)


def _names(entries: np.ndarray, rounds: int) -> np.ndarray:
    """The nodes that the keys name: the last bits of their digests."""
    return np.ndarray(len(entries), ">u4", entries, 28, entries.strides).astype(np.int64) & ((1 << BITS * rounds) - 1)


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """One run of several: keys in order, each once, with its best identifier and the sum of its rows."""
    entries = runs[0] if len(runs) == 1 else np.concatenate(runs)
    if len(entries) < 2:
        return entries
    prefixes = _prefixes(entries)
    order = np.argsort(prefixes, kind="stable")  # merges what is in order already
    entries, prefixes = entries[order], prefixes[order]
    alike = prefixes[1:] == prefixes[:-1]
    if not alike.any():
        return entries
    keys = entries["key"]
    if (alike & (keys[1:] != keys[:-1])).any():  # keys that share 8 bytes
        entries = entries[np.argsort(keys, kind="stable")]
        keys = entries["key"]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(entries)]))
    best = entries[np.lexsort((entries["place"], entries["order"], entries["missing"], group))[starts]]
    best["n"] = np.add.reduceat(entries["n"], starts)
    return best


def _pieces(run: np.ndarray, node: int, digit: int, rounds: int, size: int) -> Iterator[tuple[int, bytes, bytes]]:
    """A run's pieces for the partners of node along a digit (none if digit is rounds: the run stays)."""
    if digit == rounds:
        targets = np.full(len(run), node)
    else:
        mask = ((1 << BITS) - 1) << BITS * digit
        targets = (node & ~mask) | (_names(run, rounds) & mask)
    for target in np.unique(targets):
        own = run[targets == target]
        for i in range(0, len(own), size):
            piece = own[i : i + size]
            yield int(target), piece[:1].tobytes()[:8], piece.tobytes()


def _batches(rows: Iterator[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    for node, first, entries in rows:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([first], pa.binary()), pa.array([entries], pa.binary())], names=["node", "first", "entries"])


def _first_runs(rounds: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a partition, as they come, to pieces of sorted runs for the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() & ((1 << BITS * rounds) - 1)
        held, n = [], 0

        def pieces() -> Iterator[pa.RecordBatch]:
            return _batches(_pieces(merged(held), node, 0, rounds, size))

        for batch in batches:
            if batch.num_rows:
                entries = np.empty(batch.num_rows, ENTRY)
                entries["key"] = batch.column("key").cast(pa.binary(48)).to_numpy(zero_copy_only=False)
                entries["missing"] = batch.column("order").is_null().to_numpy(zero_copy_only=False)
                entries["order"] = batch.column("order").fill_null(0).to_numpy(zero_copy_only=False)
                entries["place"] = batch.column("place").to_numpy(zero_copy_only=False)
                entries["n"] = 1
                held, n = [*held, entries], n + len(entries)
            if n > 64 * size:  # a run is as long as memory allows; the partition has several then
                held = [merged(held)]
                n = len(held[0])
                if n > 32 * size:
                    yield from pieces()
                    held, n = [], 0
        if n:
            yield from pieces()

    return run


def _round(digit: int, rounds: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges a node's pieces, which come in the order of their first keys, and deals the run along the next digit. What is below the
    first key of the piece that came last is settled, as all pieces to come are above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        node = TaskContext.get().partitionId()
        for batch in batches:
            for first, entries in zip(batch.column("first"), batch.column("entries"), strict=True):
                if n > 4 * size << BITS:
                    run = merged(held)
                    cut = int(np.searchsorted(_prefixes(run), np.uint64(int.from_bytes(first.as_py(), "big"))))
                    yield from _batches(_pieces(run[:cut], node, digit, rounds, size))
                    held = [run[cut:]]
                    n = len(held[0])
                held.append(np.frombuffer(entries.as_py(), ENTRY))
                n += len(held[-1])
        if n:
            yield from _batches(_pieces(merged(held), node, digit, rounds, size))

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for entries in batch.column("entries"):
            e = np.frombuffer(entries.as_py(), ENTRY)
            e = e[e["n"] > 1]
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(48), len(e), [None, pa.py_buffer(np.ascontiguousarray(e["key"]).tobytes())]).cast(pa.binary())
            order = pa.array(np.ascontiguousarray(e["order"]), pa.int64(), mask=e["missing"].astype(bool))
            yield pa.RecordBatch.from_arrays([keys, order, pa.array(np.ascontiguousarray(e["place"])), pa.array(np.ascontiguousarray(e["n"]))], names=["of", "best", "stays", "n"])


def rounds_for(rows: int, most: int = NODE_ENTRIES) -> int:
    """Rounds after which a node holds `most` keys on average at most; two at least, so that small inputs are dealt
    to several tasks too."""
    rounds = 2
    while rows > most << BITS * rounds:
        rounds += 1
    return rounds


def tree_merge(rows: DataFrame, rounds: int, size: int = PIECE) -> DataFrame:
    """(of, best, stays, n) for each key of several rows (key, order, place): the order and place of the one that stays, by
    least order, nulls last, then place; and the number of rows. size: entries in a piece."""
    pieces = rows.select("key", "order", "place").mapInArrow(_first_runs(rounds, size), _PIECES)
    for digit in range(1, rounds + 1):
        dealt = pieces.repartitionById(1 << BITS * rounds, "node").sortWithinPartitions("first")
        pieces = dealt.mapInArrow(_round(digit, rounds, size), _PIECES)
    return stage(pieces.mapInArrow(_unpacked, "of binary, best long, stays long, n long"), "copies")


def exact_duplicates(docs: DataFrame, keep: str = "largest", normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs (doc_id, text).

    keep: which doc_id of equal texts stays, the "largest" or the "smallest"; normal: makes the text that is compared from
    the text (its digest is then that of the normal form)."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is largest or smallest, not {keep}")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(normal(text) if normal else text).alias("key"))
    rows = stage(rows.withColumn("place", F.monotonically_increasing_id()), "keys")
    turned = F.bitwise_not if keep == "largest" else lambda x: x  # turns the order of longs round
    total = rows.count()
    copies = tree_merge(rows.withColumn("order", turned(F.col("doc_id"))), rounds_for(total))
    copies = copies.select("of", turned(F.col("best")).alias("keep"), "stays", "n")
    heavy, light = copies.where(F.col("n") * HEAVY > total), copies.where(F.col("n") * HEAVY <= total)
    rows = rows.join(F.broadcast(heavy), F.col("key") == F.col("of"), "left").drop("of")
    spread = F.when(F.col("n").isNotNull(), F.unhex(F.hex("place"))).otherwise(F.col("key"))  # 8 bytes at most, which no key has
    rows = rows.withColumn("by", spread).join(light.toDF("of", "k", "s", "m"), F.col("by") == F.col("of"), "left")
    n, stays = F.coalesce("n", "m"), F.coalesce("stays", "s")
    return rows.select(
        "doc_id",
        F.when(n.isNull(), F.col("doc_id")).when(F.col("n").isNotNull(), F.col("keep")).otherwise(F.col("k")).alias("keep_id"),
        F.coalesce(n, F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(stays == F.col("place"), F.lit(True)).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )

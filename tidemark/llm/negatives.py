"""Hard negatives by a norm-bucketed search for the largest inner products.

1. Vectors of whole numbers are sorted by norm, largest first, and cut into buckets of BUCKET rows; a bucket says its largest
   norm. For positives the buckets are those of a label, for negatives those of all labels.
2. A window is what an anchor looks for: scores between a lower and an upper limit, the best k of them. Its bar is the
   lower limit, or the k-th best score so far once there are k.
3. By Cauchy-Schwarz no score exceeds the anchor's norm times a bucket's largest norm. A bucket whose bound lies below the
   bar of all windows of an anchor is pruned, and as norms fall, so are all buckets after it.
4. Buckets are searched in waves of rows that grow fourfold, largest norms first, and bars rise between them. In a wave, blocks of
   anchors that need like norms meet the buckets that they still need: anchors move to the buckets, a bucket moves
   once a wave. Scores are exact: products of blocks in floating point where the bound shows that no sum can round,
   in Python's whole numbers otherwise.

The first search finds each anchor's positives, whose scores set the windows of the second.

Rows. Those without vec_id, label or vector, or with a component that is null, NaN or infinite, take no part (usable());
repeated rows are rows of their own. Vectors of unequal lengths have no score. A component of 2^31 or more is an error. Windows of
a negative positive's score are empty. Columns beyond the three have no effect; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

#: Rows of a bucket (at most), anchors of a block.
BUCKET, BLOCK = 4096, 256
#: By so much more rows have been searched after a wave than before it.
GROWTH = 4
#: What a bound computed in floating point may be too small by.
SLACK = 1 + 1e-9
_LEAST, _MOST = -(2**63), 2**63 - 1
_Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
_BUCKETS = "dim int, lab long, part int, j int, top double, n int, items array<bigint>, ids array<bigint>, labels array<bigint>, x binary"
_BLOCKS = "dim int, lab long, part int, j int, need double, anchors array<bigint>, mine array<bigint>, norms array<double>, a binary, at array<int>, w array<int>, lo array<bigint>, hi array<bigint>, bar array<bigint>"


def usable(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows that take part: with vec_id, label and a vector of finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & ~odd)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    values = batch.column("v").flatten().cast(pa.int32()).to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, dim)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most `most`, each of one (dim, lab); rows come in order of these."""
    held: list[pa.RecordBatch] = []
    n, key = 0, None

    def out() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        i = 0
        dims, labs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "lab"))
        ends = np.r_[np.flatnonzero((dims[1:] != dims[:-1]) | (labs[1:] != labs[:-1])) + 1, batch.num_rows]
        for end in ends if batch.num_rows else []:
            while i < end:
                if held and (n >= most or key != (dims[i], labs[i])):
                    yield out()
                    held, n = [], 0
                step = min(int(end) - i, most - n)
                held, n, key = [*held, batch.slice(i, step)], n + step, (dims[i], labs[i])
                i += step
    if held:
        yield out()


def _one(schema: str, values: list) -> pa.RecordBatch:
    """A batch of one row."""
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([v], _KINDS[t]) for v, t in zip(values, types, strict=True)], names=list(names))


def _bucket_packer(most: int) -> _Task:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for j, b in enumerate(_runs(batches, most)):
            dim, lab = b.column("dim")[0].as_py(), b.column("lab")[0].as_py()
            lists = [b.column(c).to_numpy(zero_copy_only=False) for c in ("item", "vec_id", "label")]
            yield _one(_BUCKETS, [dim, lab, part, j, b.column("norm")[0].as_py(), b.num_rows, *lists, _matrix(b, dim).tobytes()])

    return pack


def _block_packer(most: int) -> _Task:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for j, b in enumerate(_runs(batches, most)):
            dim, lab = b.column("dim")[0].as_py(), b.column("lab")[0].as_py()
            windows = b.column("windows")
            flat = windows.flatten()
            fields = [flat.field(x).to_numpy(zero_copy_only=False) for x in ("w", "lo", "hi", "bar")]
            at = np.r_[0, np.cumsum(windows.value_lengths().to_numpy(zero_copy_only=False))]
            own = [b.column(c).to_numpy(zero_copy_only=False) for c in ("item", "label", "norm")]
            yield _one(_BLOCKS, [dim, lab, part, j, b.column("need")[0].as_py(), *own, _matrix(b, dim).tobytes(), at, *fields])

    return pack


def products(a: np.ndarray, x: np.ndarray, bound: float) -> np.ndarray:
    """The whole-number inner products of rows of a with rows of x, none of which exceeds bound, nor does any partial sum's size."""
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return (a.astype(kind) @ x.astype(kind).T).astype(np.int64)
    out = a.astype(object) @ x.astype(object).T
    return np.array(out.tolist(), dtype=np.int64).reshape(len(a), len(x))


def _searcher(k: int, same: bool) -> _Task:
    """Pairs of a block and a bucket to (a, w, score, id, item): the best k of the bucket in each window that may have one."""

    def best(scores: np.ndarray, ids: np.ndarray, items: np.ndarray, found: np.ndarray) -> np.ndarray:
        if len(found) > k:  # all that may be among the first k, ties at the end included
            found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k]]
        return found[np.lexsort((items[found], ids[found], -scores[found]))[:k]]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = {n: batch.column(n)[i] for n in batch.schema.names}
                get = lambda n: at[n].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                dim, norms, cuts, bars = at["dim"].as_py(), get("norms"), get("at"), get("bar")
                reach = norms * at["top"].as_py() * SLACK
                open_ = np.flatnonzero(np.minimum.reduceat(bars, cuts[:-1]) <= reach)
                if not len(open_):
                    continue
                a = np.frombuffer(at["a"].as_py(), np.int32).reshape(len(norms), dim)[open_]
                x = np.frombuffer(at["x"].as_py(), np.int32).reshape(at["n"].as_py(), dim)
                all_scores = products(a, x, float(reach[open_].max()))
                anchors, mine, w, lo, hi, items, ids, labels = map(get, ("anchors", "mine", "w", "lo", "hi", "items", "ids", "labels"))
                rows: list[list[np.ndarray]] = []
                for q, scores in zip(open_, all_scores, strict=True):
                    fits = (items != anchors[q]) & ((labels == mine[q]) == same)
                    for c in range(cuts[q], cuts[q + 1]):
                        found = best(scores, ids, items, np.flatnonzero(fits & (scores >= bars[c]) & (scores <= hi[c])))
                        if len(found):
                            rows.append([np.full(len(found), anchors[q]), np.full(len(found), w[c], np.int32), scores[found], ids[found], items[found]])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["a", "w", "score", "id", "found"])

    return search


def bucketed(items: DataFrame, by_label: bool, most: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """The buckets of items, and their places: (dim, lab, k, wave, top, part, j) with k from 0 by falling norm. The first wave has the buckets that
    begin within the first `most` rows, however short they are; then by GROWTH."""
    rows = items.withColumn("lab", F.col("label") if by_label else F.lit(0).cast("long"))
    order = ["dim", "lab", F.desc("norm"), "vec_id", "item"]
    buckets = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_bucket_packer(most), _BUCKETS), "buckets")
    order = Window.partitionBy("dim", "lab").orderBy("part", "j")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wave = F.when(F.col("before") < most, 0).otherwise(1 + F.floor(F.log(float(GROWTH), F.col("before") / F.lit(most)) + 1e-9)).cast("int")
    places = buckets.select("dim", "lab", (F.row_number().over(order) - 1).alias("k"), "top", "part", "j", before.alias("before"))
    return buckets, stage(places.withColumn("wave", wave).drop("before"), "places")


def wave_pairs(blocks: DataFrame, wave: DataFrame) -> DataFrame:
    """(bp, bj, xp, xj): the blocks and buckets of a wave that must meet, as a bucket's largest norm is what the block needs or more."""
    ranges = wave.groupBy("dim", "lab").agg(F.min("k").alias("from"), F.max("k").alias("to"))
    pairs = blocks.select("dim", "lab", "part", "j", "need").join(ranges, ["dim", "lab"])
    pairs = pairs.select("dim", "lab", F.col("part").alias("bp"), F.col("j").alias("bj"), "need", F.explode(F.sequence("from", "to")).alias("k"))
    return pairs.join(wave, ["dim", "lab", "k"]).where(F.col("top") >= F.col("need")).select("bp", "bj", F.col("part").alias("xp"), F.col("j").alias("xj"))


def search(anchors: DataFrame, windows: DataFrame, items: DataFrame, k: int, same: bool, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(a, w, score, id, found): the best k items in each window (a, w, lo, hi) of anchors (rows of items), of the
    anchor's label if same, else of others; by score, largest first, then by vec_id. bucket, block: rows of each."""
    buckets, places = bucketed(items, same, bucket)
    last = places.agg(F.max("wave").alias("w")).first().w
    best = anchors.sparkSession.createDataFrame([], "a long, w int, score long, id long, found long")
    rank = F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), "id", "found"))
    for number in range(0 if last is None else last + 1):
        kth = best.groupBy("a", "w").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).drop("n")
        bars = windows.join(kth, ["a", "w"], "left").withColumn("bar", F.greatest("lo", F.coalesce("kth", "lo")))
        bars = bars.groupBy("a").agg(F.collect_list(F.struct("w", "lo", "hi", "bar")).alias("windows"), F.min("bar").alias("least"))
        need = F.when(F.col("least") <= 0, 0.0).when(F.col("norm") == 0, float("inf")).otherwise(F.col("least") / (F.col("norm") * SLACK))
        rows = anchors.withColumn("lab", F.col("label") if same else F.lit(0).cast("long"))
        rows = rows.join(bars, F.col("item") == F.col("a")).withColumn("need", need)
        order = ["dim", "lab", "need", "item"]
        blocks = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_block_packer(block), _BLOCKS), "blocks")
        pairs = wave_pairs(blocks, places.where(F.col("wave") == number).drop("wave"))
        work = pairs.join(blocks.drop("need", "lab", "dim"), (F.col("bp") == F.col("part")) & (F.col("bj") == F.col("j"))).drop("part", "j")
        work = work.join(buckets.drop("lab"), (F.col("xp") == F.col("part")) & (F.col("xj") == F.col("j"))).drop("part", "j", "xp", "xj", "bp", "bj")
        found = work.mapInArrow(_searcher(k, same), "a long, w int, score long, id long, found long")
        best = stage(best.unionByName(found).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "best")
    return best


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a row of vectors where is_anchor, an
    expression over vec_id and label) and each of its best positives, the best negatives whose score is between low and high
    per cent of the positive's.

    vectors: vec_id, label (whole numbers) and v, an array of whole numbers without nulls."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<int>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    items = stage(rows.where("vec_id is not null and label is not null and v is not null").withColumns({"dim": F.size("v"), "norm": norm, "item": F.monotonically_increasing_id()}), "vectors")
    anchors = stage(items.where(is_anchor), "anchors")
    whole = anchors.select(F.col("item").alias("a"), F.lit(0).alias("w"), F.lit(_LEAST).cast("long").alias("lo"), F.lit(_MOST).cast("long").alias("hi"))
    best = search(anchors, whole, items, positives, True, bucket, block)
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "id", "found"))
    chosen = best.where("score >= 0").select("a", place.alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    per = lambda p, up: F.expr(f"(positive_score div 100) * {p} + ((positive_score % 100) * {p} + {up}) div 100")
    windows = stage(chosen.withColumns({"lo": per(low, 99), "hi": per(high, 0)}), "windows")
    found = search(anchors, windows.select("a", "w", "lo", "hi"), items, negatives, False, bucket, block)
    rank = F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), "id", "found")).cast("int")
    found = found.select("a", "w", rank.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = windows.join(anchors.select(F.col("item").alias("a"), F.col("vec_id").alias("anchor_id")), "a")
    return found.join(named, ["a", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

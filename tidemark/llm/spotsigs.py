"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A document's fingerprint is the set of its spot signatures. Likeness is the Jaccard similarity of two
sets, pruned by their lengths. Neighbours in the order of doc_id meet without a global sort in one
task: split points (bounded in number) cut the order into buckets, each bucket gets a copy of the
first document after it, and one shuffle brings the texts together.

The search of all near-duplicates (near_duplicates) makes equal sets one class, partitions classes by set
length into ranges that can match themselves and the next one only, and joins the inverted lists of each
set's rarest signatures there; pairs that are left are compared on whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, keyed, stage

#: Slots in which signatures are counted, to put common ones last; so many numbers go to the driver and to the tasks.
SLOTS = 1 << 18
#: Common words of four languages that anchor signatures.
ANCHORS = tuple(
    "a an and are as at be been but by for from had has have he her his i in is it not of on or said she so that the their there they this to was were what which with you "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le les et en un une du que qui dans pour pas par sur plus ne se ce il elle au aux des est sont avec son sa "
    "el los las del y que se no con por para su al lo como más pero sus una este".split()
)
#: Content words in a chain, and the distance from one to the next.
CHAIN, DISTANCE = 2, 1
#: Text (code points) that a bucket of neighbours is meant to hold, and the most buckets that the order is cut to.
BUCKET_CHARS, MAX_BUCKETS = 16_000_000, 10_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Codes(dict):
    """word -> 64-bit code, odd for an anchor, even for a content word, 0 for what has no letter or digit."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit, self.anchors = limit, {w.encode() for w in ANCHORS}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        core = word.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        value = 0 if not core else xxhash.xxh3_64_intdigest(core) & ~1 | (core in self.anchors)
        self[word] = value
        return value


_CODES = _Codes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def spot_set(text: str, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """The sorted distinct 32-bit spot signatures of a text. A text without any (too short, or no
    anchor) has one: that of its whole sequence of words."""
    words = text.encode("utf-8", "replace").lower().split()
    codes = np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))
    codes = codes[codes != 0]
    anchor = (codes & np.uint64(1)).astype(bool)
    content, anchors = codes[~anchor], np.flatnonzero(anchor)
    first = anchors - np.arange(len(anchors))  # content words before each anchor
    whole = first + (chain - 1) * distance < len(content)
    first, value = first[whole], codes[anchors[whole]]
    with np.errstate(over="ignore"):
        for i in range(chain):
            value = _mix(value * _A + content[first + i * distance])
    if not len(value):
        value = np.array([xxhash.xxh3_64_intdigest(b"\0".join(words))], np.uint64)
    return np.unique((value >> np.uint64(32)).astype(np.uint32))


def fingerprint(spots: np.ndarray) -> str:
    """Eight hexadecimal digits for each signature, in order."""
    return spots.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without comparing where the lengths rule out `least`."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(doc_id: int | None, text: str, spots: np.ndarray, following: str, after: np.ndarray, chain: int, distance: int) -> tuple:
    edited = edited_text(text, following)
    changed = spot_set(edited, chain, distance)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(spots), fingerprint(changed), likeness(spots, changed), likeness(spots, after)


def _walker(chain: int, distance: int) -> Callable:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before: bucket, extra, doc_id, text, spots
        out: list[tuple] = []
        size = 0
        for batch in batches:
            buckets, extras, ids = (batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id"))
            for bucket, extra, doc_id, text in zip(buckets, extras, ids, batch.column("text"), strict=True):
                text = text.as_py() or ""
                spots = spot_set(text, chain, distance)
                if bucket is None:  # no place in the order: nothing follows
                    out.append(_compare(doc_id, text, spots, "", spot_set("", chain, distance), chain, distance))
                else:
                    if held and held[0] == bucket and not held[1]:
                        out.append(_compare(held[2], held[3], held[4], text, spots, chain, distance))
                    held = (bucket, extra, doc_id, text, spots)
                size += len(text)
                if out and size >= 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_OUT)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_OUT)

    return walk


def splits_from(splits: list[int], value: Column) -> Column:
    """How many of the descending splits are at least value, found in two steps of about the root of their number."""
    if not splits:
        return F.lit(0)
    step = math.isqrt(len(splits)) + 1
    parts = [splits[i : i + step] for i in range(0, len(splits), step)]
    many = lambda x, array: F.size(F.filter(array, lambda s: s >= x))
    whole = many(value, F.lit([p[-1] for p in parts]).cast("array<bigint>"))  # parts that lie above the value throughout
    part = F.get(F.array(*[F.lit(p).cast("array<bigint>") for p in parts]), whole)
    return F.least(whole * step + F.coalesce(many(value, part), F.lit(0)), F.lit(len(splits))).cast("int")


def compare_neighbours(docs: DataFrame, chain: int = CHAIN, distance: int = DISTANCE, buckets: int | None = None) -> DataFrame:
    """For each row of docs: n_chars (code points), the digest of its edited text, both fingerprints,
    and the likeness of its fingerprint to the edited text's and to the next document's.

    The next document is the next in descending doc_id; after the last comes the first. The edited
    text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next.

    Edge cases: a null text is empty; the only document is its own next; rows with equal doc_ids
    go by text; a row with a null doc_id has no place in the order, so nothing follows it (the cut
    end is replaced by nothing, near_next compares with the empty text). Texts without anchors have one
    signature, of all their words. Empty table: empty result. Other columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if not buckets:
        total = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
        buckets = min(MAX_BUCKETS, max(1, -(-total // BUCKET_CHARS)))
    found = rows.select(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("p")).first().p if buckets > 1 else []
    # bucket k holds the ids up to split k - 1 and above split k
    bucket = F.when(F.col("doc_id").isNotNull(), splits_from(sorted(set(found or []), reverse=True), F.col("doc_id")))
    rows = rows.withColumn("bucket", bucket)
    firsts = rows.where("bucket is not null").groupBy("bucket").agg(F.max("doc_id").alias("first")).orderBy("bucket").collect()  # at most `buckets` rows
    after = [(r.bucket, firsts[(i + 1) % len(firsts)].first) for i, r in enumerate(firsts)]
    rows = rows.withColumn("extra", F.lit(False))
    if after:
        after = spark.createDataFrame(after, "b int, id long")
        copies = rows.join(F.broadcast(after), F.col("doc_id") == F.col("id")).groupBy("b").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
        rows = rows.unionByName(copies.select("doc_id", "text", F.col("b").alias("bucket"), F.lit(True).alias("extra")))
    dealt = rows.repartitionById(buckets, F.coalesce("bucket", F.pmod(F.xxhash64("text"), F.lit(buckets)).cast("int"))).sortWithinPartitions("bucket", "extra", F.desc("doc_id"), "text")
    return dealt.mapInArrow(_walker(chain, distance), SCHEMA)


def _spotter(chain: int, distance: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                spots = [spot_set(t or "", chain, distance) for t in part.column("text").to_pylist()]
                columns = [pa.array([len(x) for x in spots], pa.int32()), pa.array([x.tobytes() for x in spots], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), *columns], names=["key", "doc_id", "n_spots", "spots"])

    return run


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many signatures of a task's sets fall into each slot."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for spots in batch.column("spots"):
            counts += np.bincount(np.frombuffer(spots.as_py(), np.uint32) % SLOTS, minlength=SLOTS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["slot", "n"])


def _lister(counts: np.ndarray, least: float) -> Callable:
    """The first n - ceil(least n) + 1 signatures of each set in the order of (count of the slot, signature), each with the number of those from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for c, spots in zip(batch.column("class").to_pylist(), batch.column("spots"), strict=True):
                spots = np.frombuffer(spots.as_py(), np.uint32)
                n = len(spots)
                k = n - math.ceil(n * least - 1e-9) + 1
                order = np.lexsort((spots, counts[spots % SLOTS]))[:k]
                parts.append((np.full(k, c), np.full(k, n, np.int32), (n - np.arange(k)).astype(np.int32), spots[order].view(np.int32)))
                if sum(len(p[0]) for p in parts[-1:]) > 100_000 or len(parts) >= 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["class", "n", "rest", "spot"])
                    parts = []
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["class", "n", "rest", "spot"])

    return run


def _alike(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("spots_a").to_pylist(), batch.column("spots_b").to_pylist(), strict=True)
            near = [likeness(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), least) >= least for a, b in sets]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, least: float = 0.5, chain: int = CHAIN, distance: int = DISTANCE) -> DataFrame:
    """(key, doc_id, n_spots, class, component) for each row, key as in keyed(): class is the least key of the rows
    with the same set of signatures, component the least key that a chain of likenesses of at least `least` leads to.

    No pair is lost: sets that are alike enough have lengths in one or in neighbouring ranges (of the ratio
    `least`), and share one of their first n - ceil(least n) + 1 signatures, in an order that puts common ones last. A pair is dropped unread if
    what follows the shared signature in both is too short. Rows and edge cases as in compare_neighbours()."""
    return _near(docs, least, chain, distance)[0]


def _near(docs: DataFrame, least: float, chain: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The rows of near_duplicates(), and the pairs (a, b) of classes that are alike."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    rows = stage(keyed(docs).mapInArrow(_spotter(chain, distance), "key long, doc_id long, n_spots int, spots binary").withColumn("digest", F.sha2("spots", 256)), "spots")
    firsts = rows.groupBy("digest").agg(F.min("key").alias("class"))
    members = stage(rows.select("key", "doc_id", "n_spots", "digest").join(firsts, "digest").drop("digest"), "classes")
    sets = stage(rows.join(members.where("key = class").select("key"), "key").select(F.col("key").alias("class"), F.col("n_spots").alias("n"), "spots"), "sets")
    if least == 1:
        none = docs.sparkSession.createDataFrame([], "a long, b long")
        return members.select("key", "doc_id", "n_spots", "class", F.col("class").alias("component")), none
    # any one order of signatures loses no pair; this one puts those of often hit slots last
    counts = np.zeros(SLOTS, np.int64)
    found = sets.select("spots").mapInArrow(_counter, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    listed = sets.select("class", "spots").mapInArrow(_lister(counts, least), "class long, n int, rest int, spot int")
    length_range = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(least)) + 1e-9).cast("int")
    listed = stage(listed.withColumn("band", length_range), "lists")
    a = listed.select(*[F.col(c).alias(f"{c}_a") for c in listed.columns])
    b = listed.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).select(*[F.col(c).alias(f"{c}_b") for c in listed.columns], "up", (F.col("band") - F.col("up")).alias("band_a"), F.col("spot").alias("spot_a"))
    needed = F.ceil((F.col("n_a") + F.col("n_b")) * F.lit(least / (1 + least)) - 1e-6)
    fits = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least) - 1e-6) & (F.least("rest_a", "rest_b") >= needed)
    met = a.join(b, ["spot_a", "band_a"]).where((F.col("up") == 1) | (F.col("class_a") < F.col("class_b"))).where(fits)
    pairs = met.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("spots").alias("spots_a")), "a").join(sets.select(F.col("class").alias("b"), F.col("spots").alias("spots_b")), "b")
    edges = stage(both.select("a", "b", "spots_a", "spots_b").mapInArrow(_alike(least), "a long, b long"), "alike")
    found = members
    if not edges.isEmpty():
        roots = components(edges)
        found = members.join(roots.toDF("node", "root"), F.col("class") == F.col("node"), "left")
    else:
        found = members.withColumn("root", F.lit(None).cast("long"))
    return found.select("key", "doc_id", "n_spots", "class", F.coalesce("root", "class").alias("component")), edges


def linked_documents(docs: DataFrame, least: float = 0.8, chain: int = CHAIN, distance: int = DISTANCE) -> DataFrame:
    """near_duplicates() by document: (doc_id, n_spots, class_id, component_id, links), ids as in keyed(), where links is the number of other
    classes that the row's class is alike with."""
    found, edges = _near(docs, least, chain, distance)
    both = edges.select(F.explode(F.array("a", "b")).alias("node"))
    links = both.groupBy("node").agg(F.count("*").alias("links"))
    rows = found.join(links, F.col("class") == F.col("node"), "left")
    return rows.select("doc_id", "n_spots", F.col("class").alias("class_id"), F.col("component").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))

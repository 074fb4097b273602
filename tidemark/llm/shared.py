"""Helpers that several of these operators use: staged tables, text scans, words, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The text of a record batch is worked through in slices of about this many bytes.
SLICE_BYTES = 2_000_000
#: A list of ids is broadcast only after a count shows at most this many (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Words are runs of characters other than these ASCII ones, as bytes.split() has it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a session on this machine alone (tests) gets a
    temporary one; on a cluster, where executors don't see each other's disks, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    made = getattr(spark.sparkContext, "_tidemark_folder", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext._tidemark_folder = made
    return made


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost
    executor costs a re-read instead of a recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): keys are distinct and in the order of doc_id. They are the doc_ids where these
    are distinct and not null; else rows are put in order (nulls first, then by text) and numbered."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text")
    rows = rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    return stage(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "keyed")


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Within it, what runs sends rows to Python in batches of about size bytes, so that long rows don't add up to
    large buffers on either side. The session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, values as UTF-8 bytes) of a batch, in slices of about limit bytes, one row at least."""
    values, start, held, size = batch.column(column).cast(pa.binary()), 0, [], 0
    for value in values:
        value = value.as_py()
        held.append(value)
        size += len(value or b"")
        if size >= limit:
            yield start, held
            start, held, size = start + len(held), [], 0
    if held:
        yield start, held


class WordHashes(dict):
    """word -> 64-bit hash, kept between calls; emptied when it is full, so memory stays bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def restricted(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """docs whose key is among ids (one column of longs, distinct). The ids are broadcast if a count
    shows that they are few; otherwise both sides shuffle."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, docs[key] == ids[ids.columns[0]], "left_semi")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b): root is the component's smallest node.

    Contraction: each node takes as its label that of itself and its neighbours whose hash is least, and edges go
    on between labels, until none is left; by hashes, chains shrink by a share each round. A hub with any
    number of neighbours is a grouped minimum and a skewed join, never one group in memory."""
    links = edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = links.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min_by("v", F.xxhash64("v")).alias("v"), F.min(F.xxhash64("v")).alias("h"))
        least = stage(least.select("u", F.when(F.col("h") < F.xxhash64("u"), F.col("v")).otherwise(F.col("u")).alias("m")), "least")
        found = found.join(least.toDF("w", "m"), F.col("label") == F.col("w"), "left").select("node", F.coalesce("m", "label").alias("label"))
        links = links.join(least.toDF("u", "mu"), "u").join(least.toDF("v", "mv"), "v").where("mu <> mv").select(F.col("mu").alias("u"), F.col("mv").alias("v")).distinct()
        links = stage(links, "edges")
        if links.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = stage(found, "labels")
    roots = found.groupBy("label").agg(F.min("node").alias("root"))
    return found.join(roots, "label").select("node", "root")


def session_python(path: str) -> str:
    """A path as the pyarrow file systems take it: Hadoop writes file:/a, they want file:///a."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def dealt_by_place(index: DataFrame, file: str, most: int = 16_000_000) -> DataFrame:
    """Index rows (file, offset, length) dealt by file and stretch of about most bytes, in order of offset. The
    number of partitions follows the bytes that they point at: rows are so short that by their own size
    they would all go to one task."""
    total = index.agg(F.sum("length").alias("n")).first().n or 0
    rows = index.repartition(max(1, -(-total // most)), file, F.floor(F.col("offset") / F.lit(most)))
    return rows.sortWithinPartitions(file, "offset")


def read_ranges(uri: str, ranges: list[tuple[int, int]], gap: int = 65_536, most: int = 8_000_000) -> Iterator[bytes]:
    """The bytes of each (offset, length) of a file, in the order given, which must be by offset.

    Ranges that are at most gap bytes apart are read at once, up to most bytes in a read."""
    from pyarrow import fs

    uri = session_python(uri)
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))
    with system.open_input_file(path) as file:
        i = 0
        while i < len(ranges):
            start, end, j = ranges[i][0], ranges[i][0] + ranges[i][1], i + 1
            while j < len(ranges) and ranges[j][0] - end <= gap and ranges[j][0] + ranges[j][1] - start <= most:
                end, j = max(end, ranges[j][0] + ranges[j][1]), j + 1
            block = file.read_at(end - start, start)
            for offset, length in ranges[i:j]:
                yield block[offset - start : offset - start + length]
            i = j

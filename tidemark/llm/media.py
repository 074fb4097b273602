"""Media columns: content-addressed payloads in tar shards, metadata by range reads of headers.

A payload (bytes, padded to whole rows) becomes an 8-bit grey PNG, which is lossless. Each task
writes one tar shard, through Spark's text writer: a row is a member (header, image, padding), the line
separator is the member's last padding byte. A member's name is its content's digest, and a shard has
each once. The metadata job then walks the shards' headers with short reads, and rows refer to a
payload by (shard, offset, length).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dealt_by_place, new_folder, read_ranges, session_python, stage, text_slices

#: A row of the image has so many samples; payloads are padded with PAD to whole rows, one at least.
ROW = 576
PAD = 255
BLOCK = 512
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a PNG up to the end of its first chunk (the header).
PNG_HEADER = 33


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit grey PNG, ROW samples wide. A private chunk, so that the tar member never ends on a
    block's end, is added where it would."""
    height = len(payload) // ROW
    samples = np.zeros((height, ROW + 1), np.uint8)  # filter type 0 in front of each row
    samples[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    parts = [_SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)), _chunk(b"IDAT", zlib.compress(samples.tobytes(), level))]
    end = _chunk(b"IEND", b"")
    if sum(map(len, parts)) % BLOCK == BLOCK - len(end):
        parts.append(_chunk(b"paDd", b"\0"))
    return b"".join(parts) + end


def image_size(header: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from a PNG's first PNG_HEADER bytes."""
    if header[:8] != _SIGNATURE or header[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", header[16:25])


def decode_image(data: bytes) -> bytes:
    width, height, _ = image_size(data[:PNG_HEADER])
    at, parts = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter is in use")
    return rows[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    head = bytearray(BLOCK)
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"%011o\0" % 0), (148, b" " * 8), (156, b"0"), (257, b"ustar\0" + b"00")):
        head[at : at + len(value)] = value
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def tar_size(header: bytes) -> tuple[str, int]:
    return header[:100].rstrip(b"\0").decode(), int(header[124:136].rstrip(b"\0 ") or b"0", 8)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        for _, texts in text_slices(batch, "text"):
            out = []
            for text in texts:
                text = text or b""
                digest = hashlib.sha256(text).digest()
                if digest[:12] in seen:
                    continue
                if len(seen) >= 1_000_000:  # a later copy in the shard is harmless
                    seen.clear()
                seen.add(digest[:12])
                image = encode_image(padded(text))
                # the separator that the writer adds is the last byte of the padding
                out.append(tar_header(f"{digest.hex()}.png", len(image)) + image + b"\0" * (-len(image) % BLOCK - 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write_shards(docs: DataFrame, folder: str) -> None:
    """The texts of docs (null: empty) as images in tar shards, a shard for each task."""
    members = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 0).text(folder)


def _walker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for path, total in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            system, name = fs.FileSystem.from_uri(session_python(path))
            rows: list[tuple] = []
            with system.open_input_file(name) as file:
                at = 0
                while at + BLOCK < total:
                    head = file.read_at(BLOCK + PNG_HEADER, at)
                    member, size = tar_size(head[:BLOCK])
                    if not member:
                        break
                    width, height, bits = image_size(head[BLOCK:])
                    rows.append((member.removesuffix(".png"), path, at + BLOCK, size, width, height, bits))
                    at += BLOCK + size + -size % BLOCK
                    if len(rows) == 10_000:
                        yield _index_batch(rows)
                        rows = []
            if rows:
                yield _index_batch(rows)


_INDEX = pa.schema([("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32())])
INDEX_SCHEMA = "digest string, shard string, offset long, length long, width int, height int, bits int"


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)


def shard_index(spark, folder: str) -> DataFrame:
    """(digest, shard, offset, length, width, height, bits): one row for each digest, from the shards'
    headers alone: of each member, its tar header and the image's first bytes are read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    found = files.repartition(max(1, files.count())).mapInArrow(_walker, INDEX_SCHEMA)
    place = F.min(F.struct("shard", "offset", "length", "width", "height", "bits")).alias("p")
    return found.groupBy("digest").agg(place).select("digest", "p.*")


def feature_of(payload: bytes, width: int, height: int, bits: int) -> str:
    """Size from the header, and from the samples mean, deviation and a 64-bit difference hash of their
    means over 65 equal parts."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    edges = np.linspace(0, len(x), 66).astype(np.int64)
    sums = np.r_[0.0, np.cumsum(x)]
    means = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(1, np.diff(edges))
    code = int("".join("1" if b > a else "0" for a, b in zip(means[:-1], means[1:], strict=True)), 2)
    return f"{width}x{height}x{bits};mean={x.mean():.4f};std={x.std():.4f};dhash={code:016x}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j]["shard"] == rows[i]["shard"] and j - i < 512:
                j += 1
            out = []
            for r, image in zip(rows[i:j], read_ranges(rows[i]["shard"], [(r["offset"], r["length"]) for r in rows[i:j]]), strict=True):
                payload = decode_image(image)
                out.append((r["digest"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(payload, r["width"], r["height"], r["bits"]), r["shard"], r["offset"], r["length"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FEATURES, strict=True)], schema=_FEATURES)
            i = j


_FEATURES = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
FEATURES_SCHEMA = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long, length long"


def payload_features(index: DataFrame) -> DataFrame:
    """What each indexed image decodes to: its rows are dealt by shard and read in order of offset."""
    rows = dealt_by_place(index, "shard")
    return rows.mapInArrow(_features, FEATURES_SCHEMA)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores every text of docs and returns (doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, digest, shard, offset, length) for each row.

    Edge cases: a null or empty text is a payload of one row of padding; equal texts share a stored
    image; very long texts are one image each; null doc_ids and repeated rows are kept; an empty table
    gives an empty table; other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "media")
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    write_shards(docs, folder)
    index = stage(shard_index(spark, folder), "media-index")
    found = stage(payload_features(index), "media-features")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest"))
    # both sides are plain shuffles of short rows, so that Spark can split the partition of a digest that many rows have
    return rows.join(found, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length")

"""WARC archives of compressed records, an index of them, and coalesced range reads of selected records.

Record types follow from sizes and digests alone. Payloads move once, to their archive, where they meet
short marks that say which records are revisits. A record is a gzip member (a very long one: several in a
row) whose header says how long the member is, compressed and not, in the extra field "sl". The archives are
written by Spark's text writer: a row is a record without its last byte, which is zero and serves as
line separator, so task retries and commits are Spark's own. The index (offset, length, URL and digest of each
record) then comes from the members' headers and first bytes; bodies are passed over. Reading starts
from index rows, sorts them by archive and offset, and reads neighbouring ranges at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import batches_of, dealt_by_place, new_folder, read_ranges, session_python, stage, text_slices

#: A gzip member holds at most so many bytes, so that its last byte (of the length, which is below 2 ** 24) is zero.
MEMBER_BYTES = 8_000_000
LEVEL = 6
#: Bytes of payload that an archive is meant to hold.
ARCHIVE_BYTES = 32_000_000
#: Bytes of rows that go to Python at once.
BATCH_BYTES = 8_000_000
#: Payloads below this are always stored.
LEAST_DUPLICATE = 100
END = "\r\n\r\n"
#: Fixed so that reruns write the same bytes.
DATE = "2000-01-01T00:00:00Z"


def _utf8(text: Column) -> Column:
    return F.coalesce(F.encode(text.cast("string"), "UTF-8"), F.lit(b""))


#: What names a record, and the order of records in an archive. Equal keys have equal payloads and types.
KEY = ["page_id", "payload_digest", "url"]


def described(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest) for each page."""
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), _utf8(F.col(html_column)).alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})


def planned(rows: DataFrame, least: int = LEAST_DUPLICATE) -> DataFrame:
    """rows of described() (the payload isn't needed) with record_type and refers_to."""
    # only digests that occur twice need a first page: a short list next to the pages
    again = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(again.withColumnRenamed("payload_digest", "d"), F.col("payload_digest") == F.col("d"), "left").drop("d")
    other = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull() & F.col("page_id").isNull())
    return rows.withColumns({"record_type": F.when(other, "revisit").otherwise("response"), "refers_to": F.when(other, F.col("first"))}).drop("first")


def _head() -> Column:
    """What stands in a record before its payload; a revisit has no payload."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "%20")
    lines = [
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), http)


#: A member's header: gzip with an extra field of id "sl" that holds two lengths, of the member and of its content.
_HEAD = struct.Struct("<4BI2BH2sHII")


def _member(data: bytes) -> bytes:
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    size = _HEAD.size + len(body) + 8
    return _HEAD.pack(0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data))


def compressed(record: bytes) -> bytes:
    return b"".join(_member(record[i : i + MEMBER_BYTES]) for i in range(0, len(record), MEMBER_BYTES))


def member_lengths(header: bytes) -> tuple[int, int]:
    """(length of the member, length of its content) from a member's first bytes."""
    if len(header) < _HEAD.size:
        raise ValueError("an archive ends within a record")
    fields = _HEAD.unpack(header[: _HEAD.size])
    if fields[:4] != (0x1F, 0x8B, 8, 4) or fields[8] != b"sl":
        raise ValueError("not a member of these archives")
    return fields[10], fields[11]


def decompressed(data: bytes) -> bytes:
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        if not member.eof:
            raise ValueError("a record is cut off")
        data = member.unused_data
    return b"".join(out)


def _compressor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    end, keys = END.encode(), ["archive", *KEY]
    for batch in batches:
        for start, payloads in text_slices(batch, "payload"):
            rows = batch.slice(start, len(payloads))
            records = [compressed(h.as_py() + p + end)[:-1] for h, p in zip(rows.column("head"), payloads, strict=True)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keys), pa.array(records, pa.binary())], names=[*keys, "value"])


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, least: int = LEAST_DUPLICATE, **columns) -> DataFrame:
    """Writes the archives folder/records/archive=N/part-*.txt, then folder/index (Parquet: page_id, url,
    payload_digest, path, file_length, offset, length), and returns the index. Records are dealt by hash and
    in order of KEY in their archive."""
    rows = described(pages, **columns)
    plan = planned(rows.drop("payload"), least)
    plan = stage(plan.select(*KEY, "payload_bytes", "record_type", "refers_to"), "warc-plan")
    total = plan.agg(F.sum("payload_bytes").alias("n")).first().n or 0
    archives = max(1, -(-total // archive_bytes))
    archive = F.pmod(F.xxhash64(*KEY), F.lit(archives)).cast("int").alias("archive")
    marks = plan.where("record_type = 'revisit'").select(*KEY, "refers_to").distinct().select(*KEY, archive, "refers_to")
    dealt = rows.select(*KEY, archive, "payload", "payload_bytes").unionByName(marks, allowMissingColumns=True).repartitionById(archives, F.col("archive"))
    same = F.max("refers_to").over(Window.partitionBy("archive", *KEY))
    dealt = dealt.withColumn("refers_to", same).where("payload is not null").withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"))
    payload = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    dealt = dealt.select("archive", *KEY, _head().cast("binary").alias("head"), payload.alias("payload"))
    members = dealt.mapInArrow(_compressor, "archive int, page_id long, payload_digest string, url string, value binary").sortWithinPartitions("archive", *KEY)
    with batches_of(pages.sparkSession, BATCH_BYTES):
        members.select(F.col("value").cast("string").alias("value"), "archive").write.partitionBy("archive").option("lineSep", "\0").text(f"{folder}/records")

    files = pages.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/records").select("path", "length")
    number = F.regexp_extract("path", r"/archive=(\d+)/", 1).cast("int")
    files.repartitionById(archives, number).mapInArrow(_indexer, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return read_index(pages.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def _fields(head: bytes) -> dict[bytes, bytes]:
    return dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])


def archive_records(file, total: int, block: int = 4_000_000, step: int = 2_048) -> Iterator[tuple[int, int, dict[bytes, bytes]]]:
    """(offset, length, header fields) of each record of an archive of total bytes, which is read in blocks; of a
    member, as much is decompressed as holds the record's header, and a long one's body isn't read."""
    held, begin = b"", 0  # what was read last, and where it begins in the file

    def piece(at: int, size: int) -> bytes:
        nonlocal held, begin
        size = min(size, total - at)
        if at < begin or at + size > begin + len(held):
            held, begin = file.read_at(min(max(block, size), total - at), at), at
        return held[at - begin : at - begin + size]

    at = 0
    while at < total:
        offset, head, end, content, size, seen = at, b"", -1, 0, 0, 0
        while end < 0 or content < need:
            if seen >= size:  # the next member
                at += size
                (size, more), seen = member_lengths(piece(at, _HEAD.size)), 0
                content, open_ = content + more, zlib.decompressobj(31)
            if end < 0:
                head += open_.decompress(piece(at + seen, min(step, size - seen)))
                seen += step
                if (end := head.find(b"\r\n\r\n")) >= 0:
                    fields = _fields(head[:end])
                    need = end + 2 * len(END) + int(fields[b"Content-Length"])
            else:
                seen = size
        at += size
        if at > total:
            raise ValueError("an archive ends within a record")
        yield offset, at - offset, fields


INDEX_SCHEMA = "page_id long, url string, payload_digest string, path string, file_length long, offset long, length long"


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["page_id", "url", "payload_digest", "path", "file_length", "offset", "length"]
    for batch in batches:
        for path, total in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            system, name = fs.FileSystem.from_uri(session_python(path))
            rows: list[tuple] = []
            with system.open_input_file(name) as file:
                for offset, length, fields in archive_records(file, total):
                    page = fields[b"WARC-Record-ID"].decode()[len("<urn:page:") : -1]
                    digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
                    rows.append((None if page == "none" else int(page), fields[b"WARC-Target-URI"].decode(), digest, path, total, offset, length))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


#: Compressed bytes of records that are read and decompressed together.
READ_BYTES = 500_000


def _read_groups(batch: pa.RecordBatch) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(first row, records) of a batch, in runs of one archive and about READ_BYTES, one record at least."""
    paths, offsets, lengths = (batch.column(c).to_pylist() for c in ("path", "offset", "length"))
    i = 0
    while i < len(paths):
        j, size = i, 0
        while j < len(paths) and paths[j] == paths[i] and (j == i or size + lengths[j] <= READ_BYTES):
            size, j = size + lengths[j], j + 1
        yield i, map(decompressed, read_ranges(paths[i], list(zip(offsets[i:j], lengths[i:j], strict=True))))
        i = j


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, records in _read_groups(batch):
            found = pa.array(list(records), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(i, len(found)), found], names=["page_id", "record"])


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, record) of the index rows: sorted by archive and offset within a task, one read for
    ranges that are near each other."""
    rows = dealt_by_place(index.select("page_id", "path", "offset", "length"), "path")
    return rows.mapInArrow(_reader, "page_id long, record binary")


def parse(record: bytes) -> tuple[int, str, str, int | None, bytes]:
    """(payload bytes, payload digest, type, page that it refers to, payload) of a record: for a response from the
    payload itself, for a revisit from what the record says of the full payload (its own is empty)."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = block[: int(fields[b"Content-Length"])].partition(b"\r\n\r\n")
    kind = fields[b"WARC-Type"].decode()
    if kind == "revisit":
        return int(_fields(http)[b"Content-Length"]), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:"), kind, int(fields[b"WARC-Refers-To"].decode()[len("<urn:page:") : -1]), b""
    return len(payload), hashlib.sha256(payload).hexdigest(), kind, None, payload


PARSED_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _parsing(payloads: bool) -> Callable:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 5 if payloads else 4]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(types) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, records in _read_groups(batch):
                found = [parse(x)[: len(types)] for x in records]  # one record at a time; without payloads only short fields stay
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(i, len(found)), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True))], names=names)

    return run


def parsed_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, and on request payload) of the index rows'
    records: read as read_records() does and parsed in the same task."""
    rows = dealt_by_place(index.select("page_id", "path", "offset", "length"), "path")
    return rows.mapInArrow(_parsing(payloads), PARSED_SCHEMA if payloads else PARSED_SCHEMA.removesuffix(", payload binary"))


def archive_round_trip(pages: DataFrame, folder: str | None = None, payloads: bool = False, **options) -> DataFrame:
    """Writes all pages to archives and reads every record back: one row for each page, with its payload on request.

    Of records with equal payloads of at least 100 bytes that with the smallest page_id is the
    response, others are revisits of it. Edge cases: null html is an empty payload, a null URL an
    empty target; a null page_id loses to any other and is a response if all of its group are null; repeated
    rows are records each, and equal rows are all responses; control characters and spaces in a
    URL are written as %20; an empty table gives an empty
    table; other columns are ignored, whatever their names."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    index = write_archives(pages, folder, **options)
    return parsed_records(index, payloads)

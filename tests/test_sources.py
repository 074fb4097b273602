import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import structures as T
from tidemark.sources import files


def test_lines_by_number(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\r\n')
    assert [r.a for r in files.jsonl_strict(spark, str(path), "a long").collect()] == [1, 2]
    for bad in ("nonsense", "[1]", '{"a": "x"', "3"):
        path.write_text('{"a": 1}\n\n' + bad + "\n")
        with pytest.raises(Exception, match=r"rows.jsonl:3"):
            files.jsonl_strict(spark, str(path), "a long").collect()
    path.write_text('{"a": 1}\nnonsense\n\n{"a": 2}\n{"a": 3}\n')
    assert [r.a for r in files.jsonl_lenient(spark, str(path), "a long", limit=4).collect()] == [1, 2]
    assert [r.a for r in files.jsonl_lenient(spark, str(path), "a long").where("a is not null").collect()] == [1, 2, 3]


def test_split_rows(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "id string, split string, target string")
    assert files.split_rows(make(("a", "val", "x"), ("b", "val", "y")), "val").count() == 2
    for rows in ([("a", "val", "x"), ("a", "val", "y")], [("a", "test", "x")], [("a", "val", None)], [("a", None, "x")], [(None, "val", "x")], []):
        with pytest.raises(ValueError, match="rows"):
            files.split_rows(make(*rows), "val")


def test_replay(spark):
    rows = [("r", 0, ("w1", 5.0, 6.0)), ("r", 1, ("w2", 4.0, 5.0)), ("s", 0, ("w1", 1.0, 2.0)), ("s", 1, ("w3", 1.0, 3.0))]
    df = spark.createDataFrame(rows, "recording string, pos int, window struct<window_id: string, started_at: double, ended_at: double>").withColumn("target", F.lit("label"))
    got = files.replayed(df, "recording", "pos")
    assert "target" not in got.columns
    assert {(r.recording, r.pos): r.violations for r in got.collect()} == {("r", 0): ["repeated"], ("r", 1): ["goes_back"], ("s", 0): ["repeated"], ("s", 1): []}


def test_suites_documents_and_digests(spark, tmp_path):
    for run in ("one", "two"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "predictions.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert {(r.run, r.id) for r in files.suite(spark, f"{tmp_path}/*/predictions.jsonl", "id long").collect()} == {(x, i) for x in ("one", "two") for i in (1, 2)}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{\n "id": 7\n}')
    (tmp_path / "docs" / "b.json").write_text("{ broken")
    assert [r.id for r in files.documents_json(spark, str(tmp_path / "docs"), "id long").collect()] == [7]
    digest = hashlib.sha256((tmp_path / "docs" / "a.json").read_bytes()).hexdigest()
    expected = spark.createDataFrame([("a.json", digest), ("c.json", "x")], "name string, sha256 string")
    assert {r["name"]: r.verdict for r in files.verified_files(spark, str(tmp_path / "docs"), expected).collect()} == {"a.json": "ok", "b.json": "unexpected", "c.json": "missing"}


def test_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("1", '{"id": 1}'), ("2", "no"), ("3", '{"id": 3, "x": "' + "y" * 100 + '"}')):
        (tmp_path / "in" / name).write_text(text)
    q = files.inbox(spark, str(tmp_path / "in"), "id long", per_batch=2, most_bytes=50).writeStream.format("memory").queryName("inbox").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.file: (r.row and r.row.id, r.problem) for r in spark.table("inbox").collect()} == {"1": (1, None), "2": (None, "not_json"), "3": (None, "too_large")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id long, name string")
    files.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, files.csv_text(spark, f"{tmp_path}/csv", ["id", "name"]).collect())) == [("1", "a,b"), ("2", None)]
    for _ in range(2):  # a repeated delivery replaces itself and no other
        files.write_outbox(df, f"{tmp_path}/outbox")
    files.write_outbox(df.where("id = 2"), f"{tmp_path}/outbox")
    got = {r.delivery: json.loads(r.value) for r in spark.read.text(f"{tmp_path}/outbox").collect()}
    assert got == {1: {"id": 1, "name": "a,b"}, 2: {"id": 2, "name": None}}
    files.write_new(df, f"{tmp_path}/new")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_new(df, f"{tmp_path}/new")
    files.append(df, f"{tmp_path}/journal")
    files.append(df, f"{tmp_path}/journal")
    assert files.journal(spark, f"{tmp_path}/journal", "id long, name string").count() == 4
    assert [r.id for r in files.ordered_parquet(spark, f"{tmp_path}/new", "id").collect()] == [1, 2]


def test_media_packs(spark):
    refs = spark.createDataFrame([("a",), ("a",), ("b",), ("gone",), ("z",)], "path string")
    media = spark.createDataFrame([("a", b"one"), ("b", b"\0\1"), ("more", b"x"), ("z", b"y" * 90)], "path string, content binary")
    rows = files.packed_media(refs, media, 50)
    assert {r.path: r.verdict for r in rows.collect()} == {"a": "packed", "b": "packed", "gone": "missing", "more": "unasked", "z": "over"}
    assert {r.path: base64.b64decode(r.payload) for r in rows.where("payload is not null").collect()} == {"a": b"one", "b": b"\0\1"}
    assert {r.path: bytes(r.content) for r in files.unpacked(rows).collect()} == {"a": b"one", "b": b"\0\1"}


def test_bounds():
    assert files.bounded("limit", 7) == 7
    for wrong in (0, 1001, True, 2.5):
        with pytest.raises(ValueError, match="limit"):
            files.bounded("limit", wrong)


def test_json_and_references(spark):
    df = spark.createDataFrame([('{"b": 1e-05, "a": "é"}',), ("[NaN]",), ("no",), (None,)], "t string")
    assert [r.x for r in df.select(T.canonical_json(F.col("t")).alias("x")).collect()] == ['{"a":"\\u00e9","b":1e-05}', None, None, None]
    assert df.select(T.canonical_json(F.col("t"), ascii_only=False).alias("x")).first().x == '{"a":"é","b":1e-05}'
    ref = df.select(T.keyed_reference(b"key", "subject", F.lit("42"), 16).alias("x")).first().x
    assert ref == hmac.new(b"key", b"subject\x0042", hashlib.sha256).hexdigest()[:16]
    prose = spark.createDataFrame([("a {b {\"x\": 1} {\"y\": 2}",), ("```json\n{\"z\": [1,]}\n```",), ("none",)], "t string")
    assert [r.x for r in prose.select(T.json_in_prose(F.col("t")).alias("x")).collect()] == ['{"x":1}', None, None]
    assert [r.x for r in prose.select(T.json_in_prose(F.col("t"), repair=True).alias("x")).collect()] == ['{"x":1}', '{"z":[1]}', None]


def test_media_are_packed_by_length_alone(spark):
    refs = spark.createDataFrame([("b",), ("a",), ("a",), ("x",), ("c",), ("n",)], "path string")
    media = spark.createDataFrame([("a", b"12345"), ("b", b"123"), ("c", b"1"), ("d", b"zz"), ("n", b"")], "path string, content binary").withColumn("length", F.length("content").cast("long"))
    for columns in (["path", "content"], ["path", "content", "length"]):
        got = {r.path: (r.payload, r.length, r.verdict) for r in files.packed_media(refs, media.select(*columns), 8).collect()}
        assert got == {"a": (base64.b64encode(b"12345").decode(), 5, "packed"), "b": (base64.b64encode(b"123").decode(), 3, "packed"), "c": (None, 1, "over"), "d": (None, 2, "unasked"), "n": (None, 0, "over"), "x": (None, 0, "missing")}
    whole = files.packed_media(refs, media, 100)
    assert {r.path: bytes(r.content) for r in files.unpacked(whole).collect()} == {"a": b"12345", "b": b"123", "c": b"1", "n": b""}


def test_an_inbox_tick_by_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("c", '{"id": 3}'), ("a", '{"id": 1}'), ("b", "no"), ("aa", '{"id": 2, "x": "' + "y" * 100 + '"}'), ("d", '{"id": 4}')):
        (tmp_path / "in" / name).write_text(text)
    got = files.drained(spark, str(tmp_path / "in"), "id long", str(tmp_path / "bad"), limit=4, most_bytes=50)
    assert [(r.file, r.row.id) for r in got.collect()] == [("a", 1), ("c", 3)]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "bad")).collect())) == [("aa", (tmp_path / "in" / "aa").stat().st_size, "too_large"), ("b", 2, "not_json")]
    with pytest.raises(ValueError):
        files.drained(spark, str(tmp_path / "in"), "id long", str(tmp_path / "bad"), limit=1001)


def test_hashes_over_defaults(spark):
    fields = {"b": ("string", None), "a": ("double", 0.5), "c": ("array<string>", None)}
    rows = [(1, '{"b": "x"}'), (2, '{"a": 0.5, "b": "x", "z": 1}'), (3, '{"c": null, "a": null, "b": "x"}'), (4, '{"a": 0.25, "b": "x"}'), (5, "no"), (6, None), (7, "[1]")]
    df = spark.createDataFrame(rows, "i int, raw string")
    got = {r.i: r.h for r in df.select("i", T.export_hash("v", F.lit("e"), F.lit("t"), T.with_defaults(F.col("raw"), fields)).alias("h")).collect()}
    want = hashlib.sha256(json.dumps({"export_id": "e", "message": {"a": 0.5, "b": "x", "c": None}, "schema_version": "v", "topic": "t"}, separators=(",", ":")).encode()).hexdigest()
    assert got[1] == got[2] == got[3] == want and got[4] != want and got[5] is got[6] is got[7] is None

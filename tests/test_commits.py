"""Ingestion into several tables and an outbox with several workers: cut off, repeated, raced."""

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.sources import claims, committed


def a_batch(spark, shift=0, payload="p"):
    windows = [("w1", 0.0, 10.0), ("w2", 10.0, 20.0), ("w3", 20.0, 30.0), ("w4", 30.0, 40.0)]
    objects = [("w1", "d1", None, 1.0, payload), ("w1", "d2", None, 2.0, "q"), ("w2", "d1", "known", 12.0, "q"), ("w3", "d1", "nobody", 21.0, "q"), ("w4", "d1", "young", 31.0, "q")]
    observations = [("w1", "o1", "d1", 3.0, "x"), ("w2", "o1", None, 13.0, "y"), ("w4", "o1", "d1", 32.0, "z")]
    events = [("w1", "e1", ["d1", "d2", "known"], 4.0, "m"), ("w2", "e1", [], 14.0, "n")]
    name = lambda rows: [(r[0] + f"-{shift}" if shift else r[0], *r[1:]) for r in rows]
    return {
        "windows": spark.createDataFrame(name(windows), "window_id string, started double, ended double"),
        "objects": spark.createDataFrame(name(objects), "window_id string, detection_id string, track_id string, at double, payload string"),
        "observations": spark.createDataFrame(name(observations), "window_id string, observation_id string, subject_id string, at double, payload string"),
        "events": spark.createDataFrame(name(events), "window_id string, event_id string, subjects array<string>, ended double, payload string"),
    }


def known_tracks(spark, folder):
    """A committed batch from which the tracks `known` and `young` are."""
    rows = {n: spark.createDataFrame([], df.schema) for n, df in a_batch(spark).items()}
    rows["windows"] = spark.createDataFrame([("w0", -5.0, 0.0)], rows["windows"].schema)
    committed.ingest(spark, folder, "0", rows)
    tracks = spark.createDataFrame([("known", -1.0, "w0"), ("young", 99.0, "w0")], committed.TABLES["tracks"])
    attempt = committed.commits(spark, folder).first().attempt
    tracks.write.mode("overwrite").parquet(f"{folder}/tracks/attempt={attempt}")


def everything(spark, folder):
    return {n: sorted(map(str, committed.committed(spark, folder, n).collect())) for n in committed.TABLES}


def test_a_batch_that_is_cut_off_is_not_seen(spark, tmp_path):
    folder = str(tmp_path)
    known_tracks(spark, folder)
    before = everything(spark, folder)
    wrote = []

    def breaks(df, path):
        if len(wrote) == 2:
            raise OSError("lost")
        wrote.append(path)
        df.write.parquet(path)

    with pytest.raises(OSError):
        committed.ingest(spark, folder, "1", a_batch(spark), breaks)
    assert len(wrote) == 2 and everything(spark, folder) == before
    verdicts = {r.window_id: r.verdict for r in committed.ingest(spark, folder, "1", a_batch(spark)).collect()}
    assert verdicts == {"w1": "new", "w2": "new", "w3": "unknown_track", "w4": "future_track"}
    after = everything(spark, folder)
    assert len(after["windows"]) == 3 and len(after["objects"]) == 3 and len(after["observations"]) == 2 and len(after["events"]) == 2
    committed.ingest(spark, folder, "1", a_batch(spark))
    assert everything(spark, folder) == after
    with pytest.raises(ValueError, match="other content"):
        committed.ingest(spark, folder, "1", a_batch(spark, payload="r"))
    again = {r.window_id: r.verdict for r in committed.ingest(spark, folder, "2", a_batch(spark)).collect()}  # the same windows, in another batch
    assert again == {"w1": "repeated", "w2": "repeated", "w3": "unknown_track", "w4": "future_track"}
    other = {r.window_id: r.verdict for r in committed.ingest(spark, folder, "3", a_batch(spark, payload="r")).collect()}
    assert other["w1"] == "conflict" and other["w2"] == "repeated"
    assert {n: v for n, v in everything(spark, folder).items() if n != "verdicts"} == {n: v for n, v in after.items() if n != "verdicts"}


def test_identifiers_follow_from_where_they_come_from(spark, tmp_path):
    folders = [str(tmp_path / x) for x in "ab"]
    for folder in folders:
        known_tracks(spark, folder)
        committed.ingest(spark, folder, "1", a_batch(spark))
    assert everything(spark, folders[0]) == everything(spark, folders[1])
    tracks = {(r.window_id, r.detection_id): r.track_id for r in committed.mapping(spark, folders[0]).collect()}
    assert tracks["w2", "d1"] == "known" and tracks["w1", "d1"].startswith("phys_") and len(set(tracks.values())) == 3
    event = committed.committed(spark, folders[0], "events").where("window_id = 'w1'").first()
    assert event.subjects == [tracks["w1", "d1"], tracks["w1", "d2"], "known"] and event.event_id.startswith("pevt_")
    assert committed.committed(spark, folders[0], "observations").where("window_id = 'w1'").first().subject_id == tracks["w1", "d1"]
    first = {r.track_id: (r.first_seen, r.window_id) for r in committed.committed(spark, folders[0], "tracks").collect()}
    assert first[tracks["w1", "d2"]] == (2.0, "w1") and first["known"] == (-1.0, "w0")


def test_a_window_with_two_contents_is_a_conflict(spark, tmp_path):
    batch = {n: df.limit(0) for n, df in a_batch(spark).items()}
    batch["windows"] = spark.createDataFrame([("w", 0.0, 1.0), ("w", 0.0, 2.0), ("v", 0.0, 1.0), ("v", 0.0, 1.0)], batch["windows"].schema)
    got = {r.window_id: r.verdict for r in committed.ingest(spark, str(tmp_path), "1", batch).collect()}
    assert got == {"w": "conflict", "v": "new"}


def test_verdicts_meet_in_one_aggregation(spark, tmp_path):
    """References, known windows and contents by the definition, with repeated rows: a task sorts for two joins at most."""
    batch = {n: df.unionByName(df) for n, df in a_batch(spark).items()}
    odd = spark.createDataFrame([(None, 0.0, 1.0), ("z", None, None), ("-", -0.0, float("nan")), ("-", 0.0, float("nan"))], batch["windows"].schema)
    lost = spark.createDataFrame([("nowhere", "d1", "nobody", 1.0, "q"), ("z", "d1", "young", 1.0, "q"), ("-", "d1", "young", 1.0, "q")], batch["objects"].schema)
    batch |= {"windows": batch["windows"].unionByName(odd), "objects": batch["objects"].unionByName(lost)}
    tracks = spark.createDataFrame([("known", -1.0), ("young", 99.0)], "track_id string, first_seen double")
    digests = {r.window_id: r.digest for r in committed.contents(batch).collect()}
    plan = committed.planned(batch, spark.createDataFrame([("w2", digests["w2"]), ("z", "other"), ("elsewhere", "x")], "window_id string, digest string"), tracks)
    assert {r.window_id: r.verdict for r in plan["verdicts"].collect()} == {"w1": "new", "w2": "repeated", "w3": "unknown_track", "w4": "future_track", "z": "conflict", "-": "new"}
    assert {r.window_id: r.digest for r in plan["windows"].collect()} == {k: digests[k] for k in ("w1", "-")}
    text = plan["verdicts"]._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") <= 2


# the outbox

SECOND = 1_000_000


def an_outbox(spark, folder, n=10):
    box = claims.Outbox(spark, str(folder))
    box.put(spark.createDataFrame([(i, i, f"row {i}") for i in range(n)], "id long, created long, payload string"))
    return box


def statuses(box, now):
    return {r.id: (r.status, r.attempts) for r in box.state(now).collect()}


def test_leases_and_back_off(spark, tmp_path):
    box = an_outbox(spark, tmp_path, 3)
    box.put(spark.createDataFrame([(1, 9, "again")], "id long, created long, payload string"))  # counts once
    token, rows = box.claim(100, limit=2, lease=30)
    assert sorted(tuple(r)[:2] for r in rows.collect()) == [(0, "row 0"), (1, "row 1")]
    assert statuses(box, 110) == {0: ("leased", 1), 1: ("leased", 1), 2: ("due", 0)}
    box.result(token, 120, spark.createDataFrame([(0, True), (1, False)], "id long, ok boolean"))
    assert statuses(box, 121) == {0: ("delivered", 1), 1: ("waiting", 1), 2: ("due", 0)}
    assert {r.id: r.due for r in box.state(121).collect()}[1] == 120 + 2 * SECOND
    late, rows = box.claim(130, lease=30)
    assert [r.id for r in rows.collect()] == [2]
    # the lease ends, another worker claims it; the first one's answer is stale then
    second, rows = box.claim(161, lease=30)
    assert [r.id for r in rows.collect()] == [2]
    box.result(late, 165, spark.createDataFrame([(2, True)], "id long, ok boolean"))
    assert statuses(box, 166)[2] == ("leased", 2)
    box.result("no such token", 166, spark.createDataFrame([(2, True)], "id long, ok boolean"))
    assert statuses(box, 167)[2] == ("leased", 2)
    box.result(second, 170, spark.createDataFrame([(2, False)], "id long, ok boolean"))
    box.result(second, 171, spark.createDataFrame([(2, True)], "id long, ok boolean"))  # a token answers once
    assert statuses(box, 172)[2] == ("waiting", 2)
    third, rows = box.claim(10 * SECOND)
    assert sorted(r.id for r in rows.collect()) == [1, 2]


def test_a_claim_that_is_overtaken_reads_again(spark, tmp_path):
    box, taken = an_outbox(spark, tmp_path, 6), []

    def other():
        if not taken:
            taken.append(sorted(r.id for r in claims.Outbox(spark, str(tmp_path)).claim(100, limit=4)[1].collect()))

    _, rows = box.claim(100, limit=4, raced=other)
    assert taken == [[0, 1, 2, 3]] and sorted(r.id for r in rows.collect()) == [4, 5]


def test_two_sessions_deliver_each_row_once(spark, tmp_path):
    an_outbox(spark, tmp_path, 12)
    delivered, lock = Counter(), threading.Lock()

    def work():
        box = claims.Outbox(spark.newSession(), str(tmp_path))
        while True:
            token, rows = box.claim(100, limit=3)
            mine = [r.id for r in rows.collect()]
            if not mine:
                return
            with lock:
                delivered.update(mine)
            box.result(token, 101, box.spark.createDataFrame([(i, True) for i in mine], "id long, ok boolean"))

    workers = [threading.Thread(target=work) for _ in range(2)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    assert delivered == Counter(range(12))
    assert set(statuses(claims.Outbox(spark, str(tmp_path)), 200).values()) == {("delivered", 1)}


def test_export_sends_or_blocks_each_row(spark, tmp_path):
    box = claims.Outbox(spark, f"{tmp_path}/box")
    box.put(spark.createDataFrame([(1, 1, "fine"), (2, 2, "secret"), (3, 3, None), (4, 4, "fine too")], "id long, created long, payload string"))
    build = lambda rows: rows.where("payload is not null").select("id", F.upper("payload").alias("value"))
    scan = lambda rows: rows.withColumn("violations", F.when(F.col("value").contains("SECRET"), F.array(F.lit("leak"))).otherwise(F.array().cast("array<string>")))
    first = claims.exported(box, 10, build, scan, str(tmp_path), limit=3)
    assert sorted((r.id, r.status, r.violations) for r in first.collect()) == [(1, "sent", None), (2, "blocked", ["leak"]), (3, "blocked", ["not_built"])]
    assert [(r.id, r.status) for r in claims.exported(box, 11, build, scan, str(tmp_path)).collect()] == [(4, "sent")]
    assert claims.exported(box, 12, build, scan, str(tmp_path)).count() == 0
    assert "SECRET" not in str(spark.read.parquet(f"{tmp_path}/sent").collect()) and "value" not in spark.read.parquet(f"{tmp_path}/blocked").columns


def test_a_file_is_created_once(spark, tmp_path):
    path = f"file://{tmp_path}/log/1.json"
    assert [claims.create_once(spark, path, t) for t in ("a", "b")] == [True, False]
    assert (tmp_path / "log/1.json").read_text() == "a" and [p.name for p in (tmp_path / "log").iterdir()] == ["1.json"]

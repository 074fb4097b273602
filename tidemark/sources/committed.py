"""Atomic, idempotent ingestion of windows into several tables: what is read is what a commit names.

Each attempt at a batch writes its rows of each table to a folder of its own and then, last, its commit: one row of JSON with the
attempt and the batch's digest. Readers join with the commits, so an attempt that was cut off between two tables is nowhere to be seen,
and the next one is another. A batch that is already committed changes nothing if its digest
is the same, and is an error otherwise. Identifiers are digests of where they come from, so a repeated batch makes the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of an ingested batch.
TABLES = {
    "windows": "window_id string, started double, ended double, digest string",
    "objects": "window_id string, detection_id string, track_id string, at double, payload string",
    "observations": "window_id string, observation_id string, subject_id string, at double, payload string",
    "events": "window_id string, event_id string, subjects array<string>, ended double, payload string",
    "tracks": "track_id string, first_seen double, window_id string",
    "verdicts": "window_id string, verdict string",
}


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.schema("batch string").option("recursiveFileLookup", "true").json(path).head(1))
    except Exception as e:  # a folder that isn't there yet
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, attempt, digest) of the batches that are committed; such a row is written whole or not at all."""
    path, schema = f"{folder}/commits", "batch string, attempt string, digest string"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's rows of all committed batches."""
    done = commits(spark, folder)
    if done.isEmpty():
        return spark.createDataFrame([], TABLES[name])
    rows = spark.read.schema(f"{TABLES[name]}, attempt string").option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    return rows.join(done.select("attempt"), "attempt", "left_semi").drop("attempt")


def digest_of(df: DataFrame) -> str:
    """A digest of a table's rows in any order: their number and two sums of hashes of each row."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    big = lambda h: F.sum(h.cast("decimal(38,0)"))
    r = df.select(F.xxhash64(text).alias("a"), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("b")).agg(F.count("*").alias("n"), big(F.col("a")).alias("a"), big(F.col("b")).alias("b")).first()
    return f"{r.n}:{r.a}:{r.b}"


def persistent(prefix: str, *parts: Column | str) -> Column:
    """An identifier that follows from where it comes from."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256), 1, 32))


def _windows(batch: dict[str, DataFrame]) -> DataFrame:
    return batch["windows"].select("window_id", F.col("started").cast("double").alias("started"), F.col("ended").cast("double").alias("ended")).distinct()


def _parts(batch: dict[str, DataFrame]) -> DataFrame:
    """(window_id, x): what a window's digest is made of, a text for each row of each table."""
    text = lambda name, df, columns: df.select("window_id", F.to_json(F.struct(F.lit(name).alias("t"), *columns), {"ignoreNullFields": "false"}).alias("x"))
    parts = text("windows", _windows(batch), ["started", "ended"])
    for name in ("objects", "observations", "events"):
        parts = parts.unionByName(text(name, batch[name], sorted(batch[name].columns)))
    return parts


def _digest() -> Column:
    return F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("x"))).cast("binary"), 256)  # one window's rows


def contents(batch: dict[str, DataFrame]) -> DataFrame:
    """(window_id, digest) over a window's own fields and its rows of every table, in a fixed order."""
    return _parts(batch).groupBy("window_id").agg(_digest().alias("digest"))


def planned(batch: dict[str, DataFrame], known_windows: DataFrame, known_tracks: DataFrame) -> dict[str, DataFrame]:
    """What a batch adds to each table, and a verdict for each window: new, repeated (the same content is there), conflict (another
    content is there, or the batch itself has two), unknown_track or future_track (a reference to a track that isn't known, or wasn't by the end
    of the window). Only new windows add rows, each with all of its own.

    batch: windows (window_id, started, ended), objects (window_id, detection_id, track_id: null for a new one, at, payload), observations
    (window_id, observation_id, subject_id, at, payload), events (window_id, event_id, subjects, ended, payload). Subjects are detections of
    the window or known tracks."""
    local = batch["objects"].select("window_id", F.col("detection_id").alias("name"), F.lit(1).alias("local"))
    named = batch["objects"].select("window_id", F.col("track_id").alias("name"))
    named = named.unionByName(batch["observations"].select("window_id", F.col("subject_id").alias("name"))).unionByName(batch["events"].select("window_id", F.explode("subjects").alias("name")))
    # grouped, not joined: an anti-join would be one for each of the tables. A number of partitions that is given isn't coalesced, so tasks stay small
    names = named.withColumn("local", F.lit(0)).unionByName(local).where("name is not null")
    foreign = names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "window_id", "name").groupBy("window_id", "name").agg(F.max("local").alias("local")).where("local = 0")
    placed = foreign.join(known_tracks.select(F.col("track_id").alias("name"), "first_seen"), "name", "left")
    # all that a verdict rests on meets in one aggregation: joins would each sort both sides in one stage
    facts = _parts(batch)
    for more in (_windows(batch).withColumn("own", F.lit(True)), known_windows.select("window_id", F.col("digest").alias("known")), placed.select("window_id", "first_seen", F.lit(True).alias("foreign"))):
        facts = facts.unionByName(more, allowMissingColumns=True)
    rows = facts.where("window_id is not null").groupBy("window_id").agg(
        F.count("own").alias("_n"), F.max("started").alias("started"), F.max("ended").alias("ended"), _digest().alias("digest"), F.min("known").alias("_known"), F.max("known").alias("_known_too"),
        F.count_if(F.col("foreign") & F.col("first_seen").isNull()).alias("_unknown"), F.max("first_seen").alias("_seen")
    ).where("_n > 0")
    other = (F.col("_known") != F.col("digest")) | (F.col("_known_too") != F.col("digest")) | (F.col("_n") > 1)
    verdict = F.when(other, "conflict").when(F.col("_known").isNotNull(), "repeated").when(F.col("_unknown") > 0, "unknown_track").when(F.col("_seen") > F.col("ended"), "future_track").otherwise("new")
    rows = rows.withColumn("verdict", verdict)
    new = rows.where("verdict = 'new'")
    own = lambda df: df.join(new.select("window_id"), "window_id", "left_semi")
    track = F.coalesce("track_id", persistent("phys_", "window_id", "detection_id"))
    objects = own(batch["objects"]).withColumn("track_id", track)
    mapping = objects.select("window_id", F.col("detection_id").alias("name"), F.col("track_id").alias("_track"))
    subject = own(batch["observations"]).join(mapping.withColumnRenamed("name", "subject_id"), ["window_id", "subject_id"], "left")
    observations = subject.select("window_id", persistent("pobs_", "window_id", "observation_id").alias("observation_id"), F.coalesce("_track", "subject_id").alias("subject_id"), "at", "payload")
    parts = own(batch["events"]).select("window_id", "event_id", "ended", "payload", F.posexplode_outer("subjects").alias("i", "name")).join(mapping, ["window_id", "name"], "left")
    subjects = F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("_track", "name").alias("t")))), lambda x: x["t"])
    events = parts.groupBy("window_id", "event_id", "ended", "payload").agg(F.filter(subjects, lambda x: x.isNotNull()).alias("subjects"))
    events = events.withColumn("event_id", persistent("pevt_", "window_id", "event_id"))
    tracks = objects.groupBy("track_id").agg(F.min(F.struct(F.col("at").cast("double").alias("at"), "window_id")).alias("f")).select("track_id", F.col("f.at").alias("first_seen"), "f.window_id")
    tracks = tracks.join(known_tracks.select("track_id"), "track_id", "left_anti")
    out = {"windows": new, "objects": objects, "observations": observations, "events": events, "tracks": tracks, "verdicts": rows}
    return {name: out[name].select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in TABLES[name].split(", "))) for name in TABLES}


def ingest(spark: SparkSession, folder: str, batch_id: str, batch: dict[str, DataFrame], write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """Ingests a batch and gives its verdicts. Batches are ingested one after the other (a stream's foreachBatch does so, with its batch
    number as batch_id)."""
    write = write or (lambda df, path: df.write.parquet(path))
    digest = "|".join(digest_of(batch[name]) for name in sorted(batch))
    done = commits(spark, folder).where(F.col("batch") == batch_id).first()
    if done is not None and done.digest != digest:
        raise ValueError(f"batch {batch_id} is committed with other content")
    attempt = done.attempt if done else f"{batch_id}-{uuid.uuid4().hex}"
    if done is None:
        for name, rows in planned(batch, committed(spark, folder, "windows"), committed(spark, folder, "tracks")).items():
            write(rows, f"{folder}/{name}/attempt={attempt}")
        spark.createDataFrame([(batch_id, attempt, digest)], "batch string, attempt string, digest string").coalesce(1).write.mode("overwrite").json(f"{folder}/commits/{batch_id}")
    return spark.read.schema(TABLES["verdicts"]).parquet(f"{folder}/verdicts/attempt={attempt}")


def mapping(spark: SparkSession, folder: str) -> DataFrame:
    """(window_id, detection_id, track_id): what the detections of committed windows became."""
    return committed(spark, folder, "objects").select("window_id", "detection_id", "track_id")

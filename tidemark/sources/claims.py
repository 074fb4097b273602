"""An outbox that several workers empty: claims and results are entries of a numbered log.

An entry is a folder of rows and then, last, a file named by its number, which only one worker can create. A worker reads the
log up to an entry, computes what it claims, and creates the next file; where another was faster it reads again. So every
claim saw all claims before it, and no row is ever held by two. A row that is claimed and not answered is free again when its lease
ends; a result counts only under the row's last claim. State is a fold over the log, nothing is updated in place.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import backoff
from tidemark.sources.files import bounded

_ENTRY = "n long, kind string, token string, at long, until long, rows string"


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file that must not exist; False where it does. A file system decides it in one step: by O_EXCL on this machine, by
    create without overwriting elsewhere (which HDFS and object stores with conditional writes do)."""
    if path.startswith(("file:", "/")):
        local = path.removeprefix("file://").removeprefix("file:")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        whole = f"{local}.{uuid.uuid4().hex}.part"
        with open(whole, "w") as f:
            f.write(text)
        try:
            os.link(whole, local)  # fails where the name is taken, and shows the whole text or nothing
        except FileExistsError:
            return False
        finally:
            os.remove(whole)
        return True
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = target.getFileSystem(conf).create(target, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


class Outbox:
    """Rows (id, created, payload, hash) under folder, claimed and answered by any number of sessions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def put(self, rows: DataFrame) -> None:
        """Adds rows; an id counts once, as it was first."""
        rows.select("id", "created", "payload", F.sha2(F.col("payload").cast("binary"), 256).alias("hash")).write.mode("append").parquet(f"{self.folder}/rows")

    def rows(self) -> DataFrame:
        rows = self.spark.read.schema("id long, created long, payload string, hash string").parquet(f"{self.folder}/rows")
        return rows.groupBy("id").agg(F.min_by(F.struct("created", "payload", "hash"), F.struct("created", "payload")).alias("r")).select("id", "r.*")

    def log(self) -> DataFrame:
        """The log's entries; one for each claim or result, not for each row."""
        os_path = f"{self.folder}/log"
        try:
            return self.spark.read.schema(_ENTRY).option("pathGlobFilter", "*.json").json(os_path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], _ENTRY)
            raise

    def _entries(self, upto: int, kind: str, schema: str) -> DataFrame:
        """The rows of all entries of a kind below a number, each with its entry's number, token and times."""
        entries = self.log().where((F.col("n") < upto) & (F.col("kind") == kind))
        folder = {"claim": "claimed", "result": "results"}[kind]
        try:
            rows = self.spark.read.schema(f"{schema}, entry string").option("basePath", f"{self.folder}/{folder}").parquet(f"{self.folder}/{folder}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], f"{schema}, entry string")
        return rows.join(F.broadcast(entries) if upto <= 10_000 else entries, F.col("entry") == F.col("rows"))  # a row an entry

    def state(self, now: int, upto: int | None = None) -> DataFrame:
        """(id, created, attempts, delivered_at, due, token, status): delivered, leased, due or waiting, for each row."""
        upto = self.next() if upto is None else upto
        claims = self._entries(upto, "claim", "id long").select("id", F.col("n").alias("claim"), "token", "until")
        answers = self._entries(upto, "result", "id long, ok boolean").select("id", F.col("n").alias("answer"), F.col("token").alias("_token"), "at", "ok")
        # an answer counts under the row's last claim before it, and the first one under a claim
        held = answers.join(claims, "id").where("claim < answer").groupBy("id", "answer", "_token", "at", "ok").agg(F.max_by(F.struct("claim", "token"), "claim").alias("c"))
        good = held.where("c.token = _token").groupBy("id", F.col("c.claim").alias("claim")).agg(F.min_by(F.struct("at", "ok"), "answer").alias("a"))
        each = claims.join(good, ["id", "claim"], "left")
        per = each.groupBy("id").agg(F.count("*").alias("attempts"), F.min(F.when(F.col("a.ok"), F.col("a.at"))).alias("delivered_at"), F.max_by(F.struct("token", "until", "a"), "claim").alias("last"))
        rows = self.rows().join(per, "id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
        due = F.when(F.col("delivered_at").isNull(), F.coalesce(F.col("last.a.at") + (backoff(F.col("attempts")) * 1_000_000).cast("long"), F.col("last.until"), F.col("created")))
        open_ = F.col("last").isNotNull() & F.col("last.a").isNull()
        status = F.when(F.col("delivered_at").isNotNull(), "delivered").when(open_ & (F.col("last.until") > now), "leased").when(F.col("due") <= now, "due").otherwise("waiting")
        rows = rows.withColumn("due", due)
        return rows.select("id", "created", "payload", "hash", "attempts", "delivered_at", "due", F.when(open_, F.col("last.token")).alias("token"), status.alias("status"))

    def next(self) -> int:
        return self.log().agg(F.coalesce(F.max("n") + 1, F.lit(0))).first()[0]

    def _append(self, n: int, **entry: object) -> bool:
        return create_once(self.spark, f"{self.folder}/log/{n:012d}.json", json.dumps({"n": n, **entry}))

    def claim(self, now: int, limit: int = 32, lease: int = 30_000_000, raced: Callable[[], None] = lambda: None) -> tuple[str, DataFrame]:
        """(token, rows claimed): the rows that are due, oldest first. raced: called between the choice and its commit (tests)."""
        bounded("limit", limit)
        while True:
            n, token = self.next(), uuid.uuid4().hex
            due = self.state(now, n).where("status = 'due'").orderBy("created", "id").limit(limit)
            name = f"{n:012d}-{token}"
            due.select("id").coalesce(1).write.parquet(f"{self.folder}/claimed/entry={name}")
            raced()
            if self._append(n, kind="claim", token=token, at=now, until=now + lease, rows=name):
                mine = self.spark.read.schema("id long").parquet(f"{self.folder}/claimed/entry={name}")
                return token, self.state(now, n + 1).join(mine, "id", "left_semi").select("id", "payload", "hash", "attempts", F.lit(token).alias("token"))

    def result(self, token: str, now: int, answers: DataFrame) -> None:
        """Answers (id, ok) to rows claimed under a token. Those of a token that isn't the row's last, or that was answered, change nothing."""
        while True:
            n = self.next()
            name = f"{n:012d}-{uuid.uuid4().hex}"
            answers.select(F.col("id").cast("long").alias("id"), "ok").coalesce(1).write.parquet(f"{self.folder}/results/entry={name}")
            if self._append(n, kind="result", token=token, at=now, until=None, rows=name):
                return


def exported(outbox: Outbox, now: int, build: Callable[[DataFrame], DataFrame], scan: Callable[[DataFrame], DataFrame], folder: str, limit: int = 32) -> DataFrame:
    """One round of an export: claims what is due, builds each row's export, scans it, and writes it to `sent`, or to `blocked` with its
    violations. Both go under the claim's token before they are recorded, so a round that is cut off is repeated under another, and a reader
    takes those of recorded claims only. Returns (id, status, violations).

    build: rows to (id, value), without rows that it can't build; scan: (id, value) to (id, value, violations)."""
    token, rows = outbox.claim(now, limit)
    made = scan(build(rows)).select("id", "value", "violations")
    both = rows.select("id").join(made, "id", "left").withColumn("violations", F.coalesce("violations", F.array(F.lit("not_built"))))
    both = both.withColumn("status", F.when(F.size("violations") == 0, "sent").otherwise("blocked"))
    for status in ("sent", "blocked"):
        kept = both.where(F.col("status") == status)
        (kept.select("id", "value") if status == "sent" else kept.select("id", "violations")).write.parquet(f"{folder}/{status}/token={token}")  # what is blocked isn't written
    outbox.result(token, now, both.select("id", F.lit(True).alias("ok")))
    parts = [outbox.spark.read.parquet(f"{folder}/{s}/token={token}") for s in ("sent", "blocked")]
    return parts[0].select("id", F.lit("sent").alias("status"), F.lit(None).cast("array<string>").alias("violations")).unionByName(parts[1].select("id", F.lit("blocked").alias("status"), "violations"))

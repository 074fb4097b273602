"""File sources and sinks: JSON lines, strict or lenient, whole documents, CSV, drop folders, idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Rows of splits (about 100 bytes each) that are broadcast at most.
MOST_SPLITS = 1_000_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): each line of text files with its number, from 1 on. A file is read in as many splits as it is cut into:
    lines are counted by split, splits add up along the file, and a line's place within its split follows from its row number, as a split's rows
    follow each other in one task. So the files are read twice and no file is in one task. Lines come in order, unless there are
    more than MOST_SPLITS splits."""
    lines = spark.read.option("lineSep", "\n").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"), F.regexp_replace("value", "\r$", "").alias("value"))
    splits = rows.groupBy("file", "_at").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "_at", "_first", before.alias("_before"))  # a row a split
    few = len(lines.inputFiles()) + lines.rdd.getNumPartitions() <= MOST_SPLITS  # there are no more splits than files and partitions
    return rows.join(F.broadcast(splits) if few else splits, ["file", "_at"]).select("file", (F.col("_before") + F.col("_row") - F.col("_first") + 1).cast("int").alias("line"), "value")


def jsonl_strict(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, and one that isn't an object of the schema fails the read, by file and line."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    row = F.from_json("value", f"{ddl}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("row", row)
    wrong = F.col("row").isNull() | F.col("row._bad").isNotNull() | ~F.ltrim("value").startswith("{")
    message = F.concat(F.lit("not a JSON object: "), F.col("file"), F.lit(":"), F.col("line").cast("string"))
    return rows.select(F.when(wrong, F.raise_error(message)).otherwise(F.col("row")).alias("row")).select("row.*").drop("_bad")


def jsonl_lenient(spark: SparkSession, path: str, schema: str | StructType, limit: int | None = None) -> DataFrame:
    """JSON lines; malformed ones are dropped. limit: only so many lines of each file are looked at, malformed ones and
    blank ones counted."""
    if limit is None:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    rows = numbered_lines(spark, path).where(F.col("line") <= limit).select(F.from_json("value", f"{ddl}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("row"))
    return rows.where("row is not null and row._bad is null").select("row.*").drop("_bad")


def jsonl_with_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """(line, row, file): each line as it is next to what it holds; row is null where it is malformed."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.col("value").alias("line"), F.from_json("value", ddl, {"mode": "PERMISSIVE"}).alias("row"), F.col("_metadata.file_path").alias("file"))


def split_rows(rows: DataFrame, split: str, key: str = "id") -> DataFrame:
    """rows, which must all be of the split, with a target and a key that none other has; else, or if there are none, the
    read fails."""
    first = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("split").eqNullSafe(F.lit(split))).alias("foreign"), F.count_if(F.col("target").isNull()).alias("bare"), (F.count("*") - F.count_distinct(key)).alias("repeated")).first()
    if not first.n or first.foreign or first.bare or first.repeated:
        raise ValueError(f"{first.n} rows, {first.foreign} not of split {split}, {first.bare} without target, {first.repeated} with a repeated or missing {key}")
    return rows


def replayed(rows: DataFrame, recording: str, position: str) -> DataFrame:
    """(recording, window.*) of rows, nothing else of them, with violations: a recording's windows must end in order, and
    a window_id be there once."""
    before = F.lag("window.ended_at").over(Window.partitionBy(recording).orderBy(position))
    marked = rows.select(recording, position, "window", before.alias("_before"))
    again = rows.groupBy("window.window_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("window_id").alias("_again"))
    marked = marked.join(again, F.col("window.window_id") == F.col("_again"), "left")
    wrong = F.array_compact(F.array(F.when(F.col("window.ended_at") < F.col("_before"), "goes_back"), F.when(F.col("_again").isNotNull(), "repeated")))
    return marked.select(recording, position, "window.*", wrong.alias("violations"))


def ordered_parquet(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(key)


def suite(spark: SparkSession, pattern: str, schema: str | StructType) -> DataFrame:
    """JSON lines of many files, with the folder that each came from as `run`."""
    rows = spark.read.schema(schema).json(pattern)
    return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def documents_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One row for each JSON file that is one document; files that aren't are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def verified_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(name, sha256, verdict) of files against expected (name, sha256): ok, changed, missing or unexpected."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    both = files.join(expected.select("name", F.col("sha256").alias("wanted")), "name", "full")
    verdict = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("found") == F.col("wanted"), "ok").otherwise("changed")
    return both.select("name", F.coalesce("found", "wanted").alias("sha256"), verdict.alias("verdict"))


def inbox(spark: SparkSession, path: str, schema: str, per_batch: int = 32, most_bytes: int = 65_536) -> DataFrame:
    """A stream of (file, row, problem) of a drop folder, at most so many files a micro-batch: row is the file's JSON object,
    or problem says why it goes to quarantine (too_large, not_json)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).load(path)
    row = F.from_json(F.decode("content", "UTF-8"), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", row.alias("row"))
    problem = F.when(F.col("length") > most_bytes, "too_large").when(F.col("row").isNull() | F.col("row._bad").isNotNull(), "not_json")
    return rows.select("file", F.when(problem.isNull(), F.col("row").dropFields("_bad")).alias("row"), problem.alias("problem"))


def drained(spark: SparkSession, path: str, schema: str, quarantine: str, limit: int = 32, most_bytes: int = 65_536) -> DataFrame:
    """(file, row) of the first `limit` files of a drop folder by name: one tick of an inbox. Files that are too large, by their length alone, or hold
    no JSON object are written to the quarantine as (file, length, problem), and contents of large ones are never read. The caller removes
    the files of a tick when it is done with them."""
    names = spark.read.format("binaryFile").load(path).select("path", "length", F.element_at(F.split("path", "/"), -1).alias("file"))
    first = names.orderBy("file").limit(bounded("limit", limit)).collect()  # at most 1000 names
    small = [r.path for r in first if r.length <= most_bytes]
    kinds = "file string, length long, row struct<" + ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in schema.split(", ")) + ">"
    rows = spark.createDataFrame([], kinds + ", ok boolean")
    if small:
        parsed = F.from_json(F.decode("content", "UTF-8"), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
        read = spark.read.format("binaryFile").load(small).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", parsed.alias("row"))
        rows = read.select("file", "length", F.col("row").dropFields("_bad").alias("row"), (F.col("row").isNotNull() & F.col("row._bad").isNull()).alias("ok"))
    large = spark.createDataFrame([(r.file, r.length, "too_large") for r in first if r.length > most_bytes], "file string, length long, problem string")
    bad = rows.where("not ok").select("file", "length", F.lit("not_json").alias("problem")).unionByName(large)
    bad.write.mode("append").parquet(quarantine)
    return rows.where("ok").select("file", "row").orderBy("file")


def journal(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All that has been appended to a journal, in whatever files; empty before the first entry."""
    return spark.read.schema(schema).option("ignoreMissingFiles", True).parquet(folder)


def append(df: DataFrame, folder: str) -> None:
    df.write.mode("append").parquet(folder)


def dead_letters(rows: DataFrame, violations: str = "violations") -> tuple[DataFrame, DataFrame]:
    """Rows without violations, and those with some."""
    return rows.where(F.size(violations) == 0).drop(violations), rows.where(F.size(violations) > 0)


def csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, every column as text."""
    return spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def json_sorted(df: DataFrame) -> DataFrame:
    """One column `value`: each row as JSON with its keys in order, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_new(df: DataFrame, path: str) -> None:
    """Parquet to a path that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def write_outbox(df: DataFrame, folder: str, key: str = "id") -> None:
    """One folder for each delivery, named by its id, so that a repeated delivery finds its own again."""
    json_sorted_rows = df.select(F.col(key).alias("delivery"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    json_sorted_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("delivery").text(folder)


def packed_media(refs: DataFrame, media: DataFrame, most_bytes: int) -> DataFrame:
    """(path, payload, length, verdict): each path that refs name once with its content in base 64. Names and files must cover
    each other exactly (missing, unasked), and the contents come in order of path until most_bytes are used (over).

    media: (path, content) and, if there, length, as files have it without being read. Lengths alone decide; contents are joined to the rows
    that are packed, so no more than most_bytes of them move."""
    asked = refs.select("path").distinct().withColumn("_asked", F.lit(True))
    length = F.col("length") if "length" in media.columns else F.length("content")
    both = asked.join(media.select("path", length.cast("long").alias("length")), "path", "full")
    ranges = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)  # short rows: a name and a length
    rows = both.withColumn("_used", F.sum(F.coalesce("length", F.lit(0))).over(ranges))
    verdict = F.when(F.col("_asked").isNull(), "unasked").when(F.col("length").isNull(), "missing").when(F.col("_used") > most_bytes, "over").otherwise("packed")
    rows = rows.select("path", F.coalesce("length", F.lit(0)).alias("length"), verdict.alias("verdict"))
    packed = media.select("path", "content").join(rows.where("verdict = 'packed'").select("path"), "path", "left_semi").select("path", F.base64("content").alias("payload"))
    return rows.join(packed, "path", "left").select("path", "payload", "length", "verdict")


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.where("verdict = 'packed'").select("path", F.unbase64("payload").alias("content"))


def bounded(name: str, value: int, low: int = 1, high: int = 1000) -> int:
    """A parameter that must lie in its bounds."""
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be an integer from {low} to {high}")
    return value

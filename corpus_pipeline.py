"""A training corpus from the table documents: five stages, each by one operator of tidemark.llm.

quality (10) -> near-duplicates (6) -> secrets (8) -> mixing (2) -> packing (1). Every stage works on all
that the one before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, mixing, packing, quality, secrets
from tidemark.llm.queries import tokenizer_file
from tidemark.llm.shared import new_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null or empty text is judged by the scorer's constant alone, long
    texts whole, repeated rows alike; rows without a doc_id are judged like others; columns other than those of documents
    go; an empty table stays empty."""
    return quality.scored(docs, list(COLUMNS)).where("kept").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity of 0.8) the smallest doc_id stays; equal
    rows stay once. Texts of one doc_id are compared one by one. Documents without words, and rows without a doc_id
    (which can't name a group), stay; columns other than those of documents go; an empty table stays empty."""
    return minhash.one_of_each(docs, width=5, percent=80).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows the text. A null text stays null with its n_chars, an empty one
    empty; every row stays, repeated ones and those without a doc_id among them; other columns go; an empty table stays empty."""
    clean = secrets.redact(docs.select(*COLUMNS), secrets.train(secrets.labelled_sample(spark)))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole; those that it doesn't take go. Texts without words (null ones too) have no size
    and are never taken; a null source is a source of its own; repeated rows are rows of their own, rows without a
    doc_id go by their text; other columns go; an empty table stays empty."""
    mixed = mixing.mix(docs, weights=(5, 2, 1), max_repeats=3, part=False, keep=COLUMNS)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return mixed.withColumn("n", F.explode(F.sequence(F.lit(0), times))).where("n > 0").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places in sequences of at most 2048 tokens. A null or empty text is the end id alone; rows without a doc_id and repeated rows are
    packed as rows of their own; an empty table stays empty."""
    return packing.pack_documents(docs, tokenizer_file(), size=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack)]

#: SQL can't express the trained models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over the table documents; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

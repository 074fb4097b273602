"""The queries of these operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, exact, media, minhash, mixing, negatives, packing, quality, secrets, spotsigs, suffixes, urls, warc

def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file(), size=2048, end_id=0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), max_repeats=3)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(pages(spark, sf_dir))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_neighbours(documents(spark, sf_dir))


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.linked_documents(documents(spark, sf_dir), least=0.8)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir), length=100)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.maximal_repeats(documents(spark, sf_dir), length=100)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_groups(documents(spark, sf_dir), width=3, percent=85)


#: The rules of the URL query.
URL_RULES = (urls.Rule.of("block", "net/"), urls.Rule.of("allow", "example.net/en/"), urls.Rule.of("block", "example.com/de/"), urls.Rule.of("allow", "org/fr/"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(pages(spark, sf_dir), URL_RULES, urls.train(urls.labelled_sample(spark)))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"), secrets.train(secrets.labelled_sample(spark)))
    counts = [F.size(f"secret_{k}").cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    base = F.sha2(secrets.described("assign", "access", "hex").cast("binary"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), secrets.described(*secrets.KINDS).alias("spans"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), ["doc_id", "text"]).drop("text")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repaired(conversations.damaged(rows), rows.select("conv_id"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir), keep="largest")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")))
    return negatives.hard_negatives(rows.select("vec_id", label.alias("label"), whole.alias("v")), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_spotsigs": op4_spotsigs,
    "op4_near": op4_near,
    "op5_suffixes": op5_suffixes,
    "op5_repeats": op5_repeats,
    "op6_minhash": op6_minhash,
    "op7_urls": op7_urls,
    "op8_secrets": op8_secrets,
    "op9_media": op9_media,
    "op10_quality": op10_quality,
    "op11_conversations": op11_conversations,
    "op12_exact": op12_exact,
    "op13_negatives": op13_negatives,
    "pipeline": pipeline,
}

#: SQL for DuckDB of the queries that SQL can express. Sets of words and shingles are compared as text.
ORACLE_SQL: dict[str, str] = {
    "op2_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE k WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
t AS (
  SELECT source, source_size, weight, false AS fixed, 0::DOUBLE AS target, 0 AS turn FROM w
  UNION ALL
  SELECT source, source_size, weight, fixed OR share > 3 * source_size, CASE WHEN fixed THEN target ELSE least(share, 3.0 * source_size) END, turn + 1
  FROM (SELECT *, weight * (sum(source_size) OVER () - sum(CASE WHEN fixed THEN target ELSE 0 END) OVER ())
               / nullif(sum(CASE WHEN fixed THEN 0 ELSE weight END) OVER (), 0) AS share FROM t) x WHERE turn < 40),
q AS (SELECT source, source_size, target, round_even(target, 0)::BIGINT AS due FROM t WHERE turn = 40),
c AS (
  SELECT d.*, q.source_size, q.target, q.due,
         sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE size * (due // source_size) + greatest(0, least(size, due % source_size - before)) END::BIGINT AS taken
FROM c""",
    "op3_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f""",
    "op6_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles, shingles FROM g),
e AS (SELECT doc_id, n_shingles, unnest(shingles) AS s FROM n),
f AS (SELECT s FROM e GROUP BY s HAVING count(*) > 1),
m AS (SELECT e.* FROM e JOIN f USING (s)),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM m a JOIN m b ON a.s = b.s AND a.doc_id < b.doc_id
    AND 100 * least(a.n_shingles, b.n_shingles) >= 85 * greatest(a.n_shingles, b.n_shingles)
  GROUP BY a.doc_id, b.doc_id, a.n_shingles, b.n_shingles HAVING 100 * count(*) >= 85 * (a.n_shingles + b.n_shingles - count(*))),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON r.seen = x.a),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT doc_id, n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM n LEFT JOIN c ON doc_id = node""",
    "op12_exact": r"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op13_negatives": r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}

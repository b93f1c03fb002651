"""The queries opN_<name> of this subpackage and the SQL they are held against.

Each takes (spark, folder) and applies its operator, with production parameters, to a whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chroma, html_text, near_vectors, ngram_join, packing, pii, quality, toxicity, warc
from .common import held_out, spread, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(spread(docs.select("doc_id", "text")), model)
    return decided(scored, quality.THRESHOLD)


def decided(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digests(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer("word_bpe_49k.json"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds audio, so each vector is rendered as a tune; those whose id 50 divides are searched in all."""
    media = chroma.render(table(spark, sf_dir, "embeddings"))
    return chroma.search(media, F.col("id") % 50 == 0, "vec_id", "audio")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spread(table(spark, sf_dir, "pages")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(spread(docs.select("doc_id", "text")), model)
    return decided(scored, toxicity.THRESHOLD)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_near_vectors, op3_warc, op4_bpe, op5_ngram_join, op6_chroma, op7_html_text, op8_pii, op9_packing, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3}


OP3 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS winner FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN winner END AS refers_to
FROM w
"""

"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, folder) and works on all rows of ``docs``; all but the last return the columns of
``documents``. Classifiers learn from a bounded sample of labelled rows that are still there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ngram_join, packing, pii, quality, toxicity
from tidemark.llm.common import settle, table
from tidemark.llm.queries import tokenizer

#: Near copies of whole documents: five-word shingles, a similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def free(docs: DataFrame, name: str) -> str:
    """A name that no column has, whatever the letters' case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier accepts.

    Null and empty texts score as texts without any toxic window; repeated rows all stay or all go; without toxic labels
    all rows stay; an empty table gives an empty one; further columns are kept as they are.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free(docs, "score")
    scored = toxicity.score_documents(docs, model, score_col=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts.

    Null and empty texts score as one chunk of padding; repeated rows all stay or all go; without labels all rows stay;
    an empty table gives an empty one; further columns are kept as they are.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = free(docs, "score")
    scored = quality.score_documents(docs, model, score_col=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least (id, hash of text) stays; texts without words all stay.

    A null id is the least. Of rows with equal id and text the one whose columns, written as JSON, are least stays.
    """
    key = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("hash"))
    classes = settle(ngram_join.near_copies(docs.select(key.alias("key"), "text"), WORDS, PERCENT, "key", "text"))
    copies = classes.where("n_shingles > 0").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("component"))
    gone = settle(copies.where(~F.col("key").eqNullSafe(F.col("component")) | (F.col("n") > 1)))
    flat = lambda df: df.select(F.col("key.doc_id").alias("_id"), F.col("key.hash").alias("_hash"))
    same = lambda k: docs["doc_id"].eqNullSafe(k["_id"]) & (F.xxhash64(docs["text"]) == k["_hash"])
    others = flat(gone)
    repeated = flat(gone.where(F.col("key").eqNullSafe(F.col("component"))))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = docs.join(repeated, same(repeated), "left_semi").groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")
    return docs.join(others, same(others), "left_anti").unionByName(once)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, spans of personal data replaced by their kind, n_chars counted anew where there is one; a null text stays null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their sequences and places; a null or empty text is one piece of the end token."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: Learnt models and component search have no SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs

"""Corpus cleaning pipeline over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and reread
as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import exact, langid, ngram_join, packing, secrets
from gaugeworks.llm.common import documents, materialize, vocabulary_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that have no language: no letter, or no label with half of the posterior."""
    model = langid.train(docs, "text", "lang")
    return langid.keep_rows(docs, model, "text")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.keep_rows(docs, "doc_id", "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return ngram_join.keep_rows(docs, "doc_id", "text", ngram_join.Rule(words=5, num=80, den=100))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found are masked in the text, and n_chars follows it; no document goes."""
    found = materialize(secrets.scan(docs, "doc_id", "text").where(F.size("found") > 0), "secrets")
    masked = secrets.redact(docs, "doc_id", "text", found)
    changed = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", changed).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; the columns of the packing query."""
    return packing.pack_documents(docs, "doc_id", "text", vocabulary_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mask_secrets", mask_secrets),
    ("pack", pack),
]

#: Tokenising has no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

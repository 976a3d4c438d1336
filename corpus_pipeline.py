"""Corpus pipeline over documents: each stage's rows are written as Parquet and read again.

Toxic documents go, one document of each near-duplicate group stays, documents with
benchmark text go, secrets are masked in the texts (``n_chars`` follows), and what is left
is encoded into SentencePiece ids with merge-dropout. All stages but the last keep the
columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontaminate, merge_dropout, ngram_join, secret_scan, toxicity
from larder.llm.common import documents, free_name, saved
from larder.session import ship_package

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    ship_package(spark)
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "toxicity")
    return docs.withColumn(name, toxicity.toxicity_score(F.col("text"), net)).filter(F.col(name) < 0.5).drop(name)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates."""
    ship_package(spark)
    return ngram_join.first_of_each_group(docs)


def without_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    name = free_name(docs, "leak")
    hit = decontaminate.has_benchmark_text(F.col("text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.withColumn(name, hit).filter(~F.col(name)).drop(name)


def with_masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are masked."""
    ship_package(spark)
    name = free_name(docs, "masked")
    out = docs.withColumn(name, secret_scan.redacted(F.col("text"), WORDS))
    cols = {"text": F.col(name)}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col(name) != F.col("text"), F.char_length(name)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(cols).drop(name)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (seeded merge-dropout) and whether they decode to the text."""
    ship_package(spark)
    return merge_dropout.dropout_ids(docs, PIECES, key=1, dropout=0.1)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_copies),
    ("decontaminate", without_benchmark_text),
    ("secret_scan", with_masked_secrets),
    ("merge_dropout", encoded),
]

# Network scores, edit distances and merge-dropout are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs

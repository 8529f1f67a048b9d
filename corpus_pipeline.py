"""The corpus pipeline: from raw documents to token ids.

Every stage takes all documents its predecessor kept and returns the columns of documents; the last
one adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stmtwatch.llm.bpe import encode
from stmtwatch.llm.exact_dedup import drop_exact_duplicates
from stmtwatch.llm.importance import sampled_documents
from stmtwatch.llm.mixing import mixed_documents
from stmtwatch.llm.queries import tokenizer
from stmtwatch.llm.simhash import drop_near_duplicates

# What travels to Python at once. Whole rows do, and a worker holds a few batches of them.
BATCH_BYTES = 4 << 20

# Trained weights and fingerprints are not expressible in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, as texts differ in length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample rejects go."""
    small_batches(spark)
    return sampled_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the document with the smallest doc_id stays."""
    small_batches(spark)
    return drop_near_duplicates(docs, shingle=4, distance=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks for."""
    return mixed_documents(docs, length="n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their tokens."""
    small_batches(spark)
    return encode(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near),
    ("source mixing", mix), ("bpe encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

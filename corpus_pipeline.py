"""The corpus pipeline: stages over ``documents``, each written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import exact_dedup, minhash, mixing, pieces, quality_rules
from hearthline.llm.queries import trusted_ids
from hearthline.session import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the plain rules and the log-likelihood ratio keep."""
    judged = quality_rules.assess(docs, trusted_ids(spark, sf_dir))
    return judged.where("kept").select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    dropped = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("dropped"))
    return docs.join(dropped, F.col("doc_id") == F.col("dropped"), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row per copy, in training order."""
    return mixing.mix(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, with the next best segmentations."""
    return pieces.encode(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact_duplicates),
    ("minhash_dedup", near_duplicates),
    ("source_mix", source_mix),
    ("sentence_pieces", encoded),
]

# Hashed models and lattices are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline: language ID, exact dedup, near dedup, source mixing, tokenization.

Every stage takes what the one before it kept; ``run`` writes each stage as Parquet in the shared
folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gondola.llm import bpe, exact, langid, mixing, simhash
from gondola.llm.common import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know; those without letters go."""
    return langid.accepted(spark, docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.deduplicated(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHashes of three-word shingles at two bits or fewer."""
    return simhash.representatives(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(spark, docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes, one row per document of the mix."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.tokenized(spark, F.col("text"), path, public_tokenizers.PATTERN)
    return docs.select("doc_id", "lang", "source", found.alias("found")).select(
        "doc_id", "lang", "source", "found.*")


STAGES = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("tokenize", tokenize),
]

#: SQL cannot express the stages; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(name, stage(spark, docs, sf_dir))
        scratch.release()
    return docs

"""A training corpus from raw documents: language, near-duplicates, benchmark leaks, mix of sources, token ids.

Each stage takes and returns documents, the last one the digest of its token files. ``run`` writes each result as Parquet and reads it
again before the next stage, so a stage starts from a table and not from the lineage of those before it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from workpulse.llm import decontamination, language, mixing, neardup, tokenids
from workpulse.llm.storage import discard, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of some language; those without a letter go, and longer ones that no family of languages claims.

    If no row has a language to learn from, only those without a letter go.
    """
    return language.identified(docs, language.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return neardup.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, count and checksum of each document's ids, read back from the files."""
    return tokenids.digest(docs, public_tokenizers.path(tokenids.VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

# Trained machines, minima and a tokenizer have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)  # the next stage's table holds all that is left of it
        before = docs
    return docs

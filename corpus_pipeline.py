"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it and reads it again for the next. All but the
last return the columns of documents. Clean documents are never dropped: only texts without a language, copies and near
copies go, and secrets are replaced inside their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, langid, minhash, packing, secrets
from factloom.llm.common import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that language identification rejects (null, or without a letter) go."""
    return langid.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the longest stays, then the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at similarity 0.8 on shingles of five words the smallest doc_id stays."""
    return minhash.keep_one(docs, words=5)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; every document stays."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, a row a piece."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("secret", secret), ("packed", packed)]

#: Language filters and packing are not SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

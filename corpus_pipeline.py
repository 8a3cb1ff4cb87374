"""Corpus preparation in four stages: quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; the result is written as Parquet and read
again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import jaccard, packing, pii, quality
from palaver.llm.shared import written

KEEP_SCORE = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(written(quality.document_statistics(docs), "statistics"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model).filter(F.col("score") >= KEEP_SCORE).drop("score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, and words that disclose it, replaced."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: one row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), digest=True)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

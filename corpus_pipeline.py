"""The corpus pipeline: language, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return
the columns of documents.  ``ORACLE_SQL`` is None: fitted models, cube sampling and tokenizers are
not SQL.  The stages' operators are tested against brute-force versions instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clearframe.llm import language, mixing, neardup, packing, pii
from clearframe.llm.common import checkpointed


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs

"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
documents, but for the last, which returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontaminate, language_id, near_dedup, packing, pii
from tidelog.llm.scratch import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents whose text no known language is near to, or that have no letter, go."""
    return language_id.drop_rejected(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of documents linked by five-word shingles at 0.8 the one with the smallest id stays."""
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents with passages of two or more test items go; a single item's passages are cut out."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: spans of personal data are replaced by their kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents become ids in sequences of at most 2048."""
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", remove_benchmarks),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the language model nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir/documents.parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

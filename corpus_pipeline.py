"""From raw documents to packed training sequences.

Defined cases: documents with null texts fail the quality rules; null ids, sources and other columns are carried;
repeated rows are near-duplicates of each other, so one stays; columns beside doc_id, text and n_chars pass through
whatever their names; an empty table gives an empty one.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from coomat.llm import decontaminate, ngram_join, packing, pii, weak_rules
from coomat.llm.tables import ensure_checkpoints, removed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    return weak_rules.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike one stays."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are generalised in the text."""
    return pii.sanitise(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of the permitted lengths."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packed_sequences", packed_sequences),
]

#: Similarity components, spaced hashing and packing are not expressible in SQL; tests/llm/test_pipeline.py has a
#: brute-force version of the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what a stage returns is written to the shared checkpoint folder and read again.

    The tables of earlier stages go as soon as the next one is in place; the last one is the result and stays.
    """
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{k}-{name}")
        removed(spark, *before)
        docs, before = spark.read.schema(made.schema).parquet(f"{folder}/{k}-{name}"), [f"{folder}/{k}-{name}"]
    return docs

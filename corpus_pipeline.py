"""Corpus pipeline: documents to packed training sequences.

``STAGES`` in order: toxic documents go, of equal texts one stays, of near-copies one stays,
personal data is replaced, and what is left is packed into sequences.  ``run`` writes each
stage's result as Parquet to the shared checkpoint folder and reads it again as the next one's
input, so a stage's lineage starts at files that all executors see.

Every stage but the last returns the columns it was given.  Defined cases are those of the operators;
an empty table passes through all stages as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from edusignal.llm import exactdedup, packing, pii, simhash, toxicity
from edusignal.llm.common import table
from edusignal.llm.queries import vocabulary
from edusignal.session import ensure_checkpoint_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those whose expected severity says toxic."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the largest doc_id, of each group of equal texts."""
    return exactdedup.drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each SimHash component."""
    return simhash.drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs, pii.train(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup_stage),
          ("pii", pii_stage), ("packing", packing_stage)]

#: Models and tokenizers can't be expressed in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences of the documents in ``sf_dir``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

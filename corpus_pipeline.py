"""A training-data pipeline over `documents`: STAGES in order, each fed with what the one before it wrote.

All stages but the last return the columns of documents; the last returns the packed pieces.

What every stage does with odd rows: a null text stays null until the last stage (the first rejects it, as it has no words); rows with equal or null
doc_ids are rows of their own, in the order of doc_id, nulls last, then text; of repeated rows the second stage leaves one; very long texts are
taken whole; an empty table gives an empty one; extra columns, also of names that the operators use, are handed on.

A stage's result can be fed to the next one before it is written. What a stage keeps in scratch tables for its result lasts until the result is
written: `run` deletes it then, and only then; stages that are called by themselves leave it to the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import near, packing, quality, repeats, secrets
from paperloom.llm.shared import drop_scratch, recorded_scratch, scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that fail the rules go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2, and beside its links those of texts of 0.8 similarity or more over shingles of five words: of each group the smallest id stays."""
    return near.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: passages of 100 bytes or more that stand earlier in the corpus are cut out."""
    return repeats.without_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: secrets are masked."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the texts as token pieces, with their ids, in sequences of up to 1024."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenization and fingerprints are beyond SQL; tests/llm compares the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with recorded_scratch() as made:
            stage(spark, docs, sf_dir).write.parquet(path)
        drop_scratch(spark, made)
        docs = spark.read.parquet(path)
    return docs

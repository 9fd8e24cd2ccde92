"""A corpus pipeline over `documents`, in stages that each call one training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, decontaminate, quality, simhash, toxicity
from tessella.llm.common import materialize, remove, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or leave their language's perplexity band."""
    return quality.filter_documents(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are scored as toxic."""
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each near-duplicate component, or one without an id where no other is there."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item."""
    return decontaminate.filter_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests that show that decoding gives the text back."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encode),
]

#: The stages hold trained models, which SQL cannot express; tests check them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written; then what it has read and written on the way is deleted."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with written() as paths:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove(spark, [*before, *paths[:-1]])
        before = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)

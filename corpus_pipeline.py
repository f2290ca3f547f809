"""Training-data pipeline over ``documents``: filter, deduplicate, mix, tokenize.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; what it returns is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
Stages keep null, empty, repeated and very long texts within the rules of their operators; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featspark.llm import bpe_split, exact_dedup, line_crf, mix_sources, prob_minhash
from featspark.llm.common import stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly content; rejected ones go."""
    return line_crf.keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return prob_minhash.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mix_sources.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return bpe_split.tokenized(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("source_mix", source_mix), ("bpe_tokens", tokens)]
#: The line labelling cannot be said in SQL; the stages are tested one by one and together in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

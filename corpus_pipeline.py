"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

Each stage calls one operator of ``cohortpulse.llm`` on all that its predecessor kept; all but the last return the columns
of their input.

Cases: texts without a letter, null or empty ones among them, go in the first stage; of repeated rows and equal texts one
row stays, also where the rows are equal in every column; a null ``doc_id`` is kept and comes after all others; very long
texts are treated whole and packed into several sequences; columns of any other name pass through unread; an empty table
gives empty results in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortpulse.llm import exact_dedup, language_id, mixing, near_dedup, packing
from cohortpulse.llm.common import documents
from cohortpulse.sources.scratch import written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    return language_id.identified(docs, language_id.fitted(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest ``doc_id``, of each group of near copies."""
    return near_dedup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources take them; a repeated document is a repeated row."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids."""
    return packing.sequences(docs)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("source_mix", mixed),
    ("packing", packed),
]

#: Models and token ids are not SQL; ``tests/llm/test_pipeline.py`` holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

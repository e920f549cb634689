"""A training corpus from raw documents: quality, language, exact and near duplicates, packing.

Each stage takes the documents that the one before it left and returns those it
keeps, with the columns of documents; the last one returns packed token pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendloom.llm import exact_dedup, language, near_dedup, packing, quality
from spendloom.llm.common import store, table
from spendloom.llm.queries import tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rated best, by a model fitted on the labelled ones among them."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus has a profile of."""
    return language.drop_unknown(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return near_dedup.drop_near(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, placed in sequences."""
    return packing.pack_documents(docs, tokenizer())


STAGES = [
    ("quality classifier", good_quality),
    ("language id", known_language),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("best-fit packing", packed_sequences),
]

#: No SQL: the classifier, the profiles, the tokenizer and the packing have none. Tests hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""From documents to packed training sequences: quality, exact copies, near copies, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
The columns of documents may hold nulls, empty and very long texts and repeated rows; see the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wharfline.llm import exact_dedup, ngram_join, packing, quality_kn
from wharfline.llm.common import settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is not beyond their language's threshold."""
    return quality_kn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity of 0.8 or more."""
    return ngram_join.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("packing", pack)]

#: Language models, shingle sets and packings are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

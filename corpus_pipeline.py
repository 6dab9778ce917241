"""Documents cleaned stage by stage: quality, boilerplate lines, near copies, benchmark passages, token ids.

Every stage reads what its predecessor kept. ``run`` writes each result as a table in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import decontaminate, line_dedup, quality, sentencepiece, simhash
from sightline.llm.common import read, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; rejected ones go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that occur on many sites (the first occurrence stays); n_chars follows the text."""
    return line_dedup.remove_boilerplate(docs, length_col="n_chars")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text's pieces, their number, and whether they decode to the same text."""
    return sentencepiece.round_trip(docs)


STAGES = [("quality classifier", good_quality), ("line dedup", without_boilerplate),
          ("near duplicates", one_of_near_copies), ("benchmark decontamination", without_benchmark),
          ("token ids", token_ids)]

# neither the fitted classifier nor the fingerprints' XXH64 can be had in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is that of the last stage."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: documents to token blocks through the operators of webloom.llm.

``STAGES`` are (name, function) pairs; each function takes (spark, docs,
sf_dir) and returns the documents it keeps, with their columns, the last one
the written token blocks as read back.  ``run`` writes each stage's rows as
Parquet in the shared folder and reads them for the next stage.

Defined results: rows with null columns, empty texts, repeated rows and further
columns follow the operators' own docstrings; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import decontaminate, jaccard, mixing, quality, tokens
from webloom.llm.tables import materialise, read_table
from webloom.session import ship_package

#: Shares of the mixture's expected tokens: near those of clean input, so that
#: the rates of clean documents stay at about 1 or more.
TARGET = {"clean": 0.92, "toxic": 0.08}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship_package(spark)
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    ship_package(spark)
    return jaccard.one_of_each(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaked."""
    ship_package(spark)
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture's rates say."""
    ship_package(spark)
    return mixing.mixed(docs, read_table(spark, sf_dir, "labels"), TARGET)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of the token files."""
    ship_package(spark)
    return tokens.token_output(docs)


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("mixing to target weights", mixture),
          ("token output", token_blocks)]

ORACLE_SQL = None   # trained scores and token ids are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

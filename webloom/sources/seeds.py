"""Seed URL lists: JSON arrays of strings, keeping list position.

Position matters (crawl batches are slices of the list), so it is kept as
``seq`` from ``posexplode``; seeds are not de-duplicated (a listed URL is
always fetched).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_seed_lists(spark: SparkSession, path: str) -> DataFrame:
    """``(list_file, seq, url)`` for every element of every JSON-array file."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("list_file"),
        F.from_json("value", "array<string>").alias("urls"))
    return raw.select("list_file", F.posexplode("urls").alias("seq", "url"))


def seeds_from_values(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Inline seed list ``(seq, url)`` (literal lists in a job definition)."""
    return spark.createDataFrame(list(enumerate(urls)), "seq int, url string")

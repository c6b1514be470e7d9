"""Append-only tables: the answer store and the passage index."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, path_exists

INDEX_KEY = ("doc_id", "source", "chunk_index", "chunk_md5")
BUCKET = "bucket"
BUCKETS = 64


def append_answers(rows: DataFrame, path: str) -> None:
    """Append answer rows (see ``operators.answers.answer_rows``); never updates."""
    rows.write.mode("append").parquet(path)


def bucket_of(buckets: int = BUCKETS) -> Column:
    """The folder of a document's passages."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def read_index(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The index's passages, of some buckets' folders only where they are named."""
    df = spark.read.parquet(path)
    if buckets is not None:
        df = df.where(F.col(BUCKET).isin(buckets))
    return df.drop(BUCKET)


def missing_from_index(chunks: DataFrame, path: str, buckets: int = BUCKETS, docs: DataFrame | None = None) -> DataFrame:
    """Passages (with ``chunk_md5`` and ``bucket``) that the index does not hold yet, each
    once.  Only the buckets that ``chunks`` touches are read: their numbers, ``buckets`` at
    most, are a literal filter on the folders.  ``docs``, the documents the passages come
    from, tells the buckets without splitting them a second time."""
    spark = chunks.sparkSession
    keyed = chunks.withColumn("chunk_md5", F.md5("chunk")).withColumn(BUCKET, bucket_of(buckets))
    if not path_exists(spark, path):
        return keyed.dropDuplicates(list(INDEX_KEY))
    touched = sorted(r[0] for r in (chunks if docs is None else docs).select(bucket_of(buckets)).distinct().collect())
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).select(BUCKET, *INDEX_KEY).alias("o")
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (BUCKET, *INDEX_KEY)]
    return keyed.dropDuplicates(list(INDEX_KEY)).alias("n").join(old, same, "left_anti")


def append_index(chunks: DataFrame, path: str, buckets: int = BUCKETS, docs: DataFrame | None = None) -> None:
    """Idempotent append of passages keyed by document, source, chunk number
    and md5(chunk), in folders by a hash bucket of the document.

    Passages already present (or repeated in the input) are not added again,
    so loading the same documents twice leaves the index unchanged; equal
    passages of different documents are all kept.  An index that exists but
    cannot be read is an error, not an empty index.  ``buckets`` belongs to the
    index: every append to one uses the same number.
    """
    rows = missing_from_index(chunks, path, buckets, docs)
    # one file a bucket and batch, of as many tasks as a large batch needs
    rows.repartition(BUCKET, F.pmod(F.xxhash64("doc_id", "chunk_index"), F.lit(4))).write.mode("append").partitionBy(BUCKET).parquet(path)


def small_buckets(spark: SparkSession, path: str, max_files: int = 8) -> list[int]:
    """Buckets of more than ``max_files`` files, from the files' metadata (no passage is read)."""
    files = spark.read.parquet(path).select(BUCKET, F.col("_metadata.file_path").alias("f")).distinct()
    return sorted(r[0] for r in files.groupBy(BUCKET).count().where(F.col("count") > max_files).select(BUCKET).collect())


def compact_index(spark: SparkSession, path: str, max_files: int = 8) -> list[int]:
    """Rewrite each bucket of more than ``max_files`` files as few files; the numbers of these
    buckets.  Their rows are checkpointed, then replace the old folders at the job's commit.
    Run it while no append is running."""
    buckets = small_buckets(spark, path, max_files)
    if buckets:
        rows = cut_lineage(spark.read.parquet(path).where(F.col(BUCKET).isin(buckets)))
        (rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET).parquet(path))
    return buckets

"""Reading host chunk files back, with malformed chunks kept as rejects.

A chunk file line is one JSON array of records.  Lines are read as text and
parsed with ``from_json``: a line that does not parse becomes a reject row
(skipped, never fatal), every element of a good line becomes a record.  The
``host=`` directory is a partition column, so a scan for given hosts prunes.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.chunkfiles import EMPTY_HOST

RECORD_DDL = "url string, content string, timestamp double"
_ARRAY = f"array<struct<{RECORD_DDL.replace(' string', ': string').replace(' double', ': double')}>>"


def _lines(spark: SparkSession, path: str, hosts: list[str] | None, keys: tuple[str, ...] = (),
           fields: tuple[str, ...] = (), form: str = "text") -> DataFrame:
    df = spark.read.format(form).schema(", ".join(["value string, host string", *[f"{k} long" for k in keys]])).load(path)
    if hosts is not None:    # partition pruning on host=
        df = df.where(F.col("host").isin([h or EMPTY_HOST for h in hosts]))
    df = df.withColumn("host", F.when(F.col("host") == EMPTY_HOST, "").otherwise(F.col("host")))
    kind = _ARRAY.replace(">>", "".join(f", {f}: bigint" for f in fields) + ">>")
    return df.withColumn("records", F.from_json("value", kind, {"mode": "PERMISSIVE"}))


def scan_chunks(spark: SparkSession, path: str, hosts: list[str] | None = None,
                keys: tuple[str, ...] = (), fields: tuple[str, ...] = (), form: str = "text") -> DataFrame:
    """``(host, *keys, url, content, timestamp, *fields, ts)``: every record of every readable chunk;
    ``keys`` are the further folder names of the files' layout (``batch_id``, ``chunk_no``),
    ``fields`` the numbers that records carry themselves, ``form`` what the files were written as."""
    df = _lines(spark, path, hosts, keys, fields, form).where(F.col("records").isNotNull())
    return (df.select("host", *keys, F.inline("records"))
            .withColumn("ts", F.timestamp_micros((F.col("timestamp") * 1e6).cast("bigint"))))


def chunk_rejects(spark: SparkSession, path: str, hosts: list[str] | None = None) -> DataFrame:
    """``(host, file, raw)`` for chunk lines that do not parse."""
    df = _lines(spark, path, hosts)
    return df.where(F.col("records").isNull()).select(
        "host", F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))


def legacy_content(spark: SparkSession, path: str) -> DataFrame:
    """``content`` of every element of the JSON-array files (``.[].content``)."""
    return scan_chunks(spark, path).select("content")


def load_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``(url, content, timestamp, reject)``: records of files that are each one
    JSON array, on however many lines.  A file that does not parse is one row
    whose ``reject`` holds its text."""
    return (spark.read.schema(f"{RECORD_DDL}, reject string").option("multiLine", "true")
            .option("columnNameOfCorruptRecord", "reject").json(path))


def require_rows(df: DataFrame, what: str = "documents") -> DataFrame:
    """Fail like the legacy loader when nothing was loaded."""
    if df.isEmpty():
        raise ValueError(f"No {what} were loaded.")
    return df

"""The listing of stored chunk files, from the file system's metadata."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.chunkfiles import EMPTY_HOST


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """``(host, ts, bytes)``: one row for each file below ``host=`` folders, ``ts`` the time it
    was last written.  The plan reads no content: the column is pruned, rows come from the
    file index.  A folder without files gives no rows."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
             .load(path).select("path", "modificationTime", "length"))
    folder = F.regexp_extract("path", "/host=([^/]*)/", 1)
    # folder names are escaped as in URLs, where a plus sign stands for itself
    host = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    return files.select(F.when(host == EMPTY_HOST, "").otherwise(host).alias("host"),
                        F.col("modificationTime").alias("ts"), F.col("length").alias("bytes"))

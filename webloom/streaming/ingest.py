"""Incremental passage ingest: new chunk files -> split -> idempotent index append."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.chunks import split_documents
from ..sinks.store import append_index
from ..sources.chunkfiles import _ARRAY

_WITH_DOC = _ARRAY.replace(">>", ", doc_id: bigint>>")


def ingest_chunk_files(spark: SparkSession, chunk_dir: str, index_path: str, checkpoint: str,
                       chunk_size: int = C.CHUNK_SIZE, chunk_overlap: int = C.CHUNK_OVERLAP,
                       files_per_batch: int = 1, available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``.

    Each micro-batch parses its chunk lines (unparseable lines are skipped),
    reshapes well-formed records to documents, splits them and appends the
    passages not yet in the index, so replaying a batch is harmless.  A record's
    ``doc_id`` is its document's key; records without one are the same document
    if their URL and content are equal.
    """
    lines = (spark.readStream.format("text").schema("value string, host string")
             .option("maxFilesPerTrigger", files_per_batch).load(chunk_dir))
    records = (lines.select(F.from_json("value", _WITH_DOC).alias("r"))
               .where(F.col("r").isNotNull()).select(F.inline("r"))
               .where(F.col("content").isNotNull() & F.col("url").isNotNull()))

    def batch(df: DataFrame, epoch_id: int) -> None:
        docs = df.select(F.coalesce("doc_id", F.xxhash64("url", "content")).alias("doc_id"),
                         F.col("url").alias("source"), F.col("content").alias("text"))
        append_index(split_documents(docs, chunk_size, chunk_overlap), index_path, docs=docs.select("doc_id"))

    w = records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()

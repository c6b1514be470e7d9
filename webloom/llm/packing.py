"""Packing by power-of-two decomposition (operator 12).

A document of n ids is cut into pieces whose lengths are the powers of two that
n is the sum of, the largest as often as needed: 10,000 ids at most 4,096 each
are 4096 + 4096 + 1024 + 512 + 256 + 16.  Each piece is a sequence of its own, in
the bucket of its length.  No sequence holds ids of two documents, none is
padded, and a training step takes sequences of one bucket, all equally long.

Documents are tokenised where they are read and their pieces written from there,
under one folder for each length: nothing is exchanged, and a reader of one
bucket prunes the others' folders.  Spark's commit protocol covers lost executors.

Defined results: a null or empty text has the end id alone (one piece); rows
that repeat a doc_id, or have none, are documents of their own; an empty table
gives no rows; other columns are ignored, whatever their names.  A task holds one
slice of texts (or the longest document).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import small_batches
from ..session import scratch_path
from .tokens import END_ID, default_tokenizer, unit_table

_SEQUENCES = "doc_id long, start long, doc_tokens long, sequence_id long, offset long, ids binary"


def decompose(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of n ids each, longest pieces first."""
    sizes = most >> np.arange(most.bit_length())
    count = np.empty((len(n), len(sizes)), np.int64)
    count[:, 0] = n // most
    count[:, 1:] = (n[:, None] & sizes[1:]) != 0
    length = np.repeat(np.tile(sizes, len(n)), count.ravel())
    doc = np.repeat(np.arange(len(n)), count.sum(1))
    before = np.cumsum(n) - n
    return doc, np.cumsum(length) - length - before[doc], length


def _packer(path: str | None, most: int):
    def job(batches):
        table = unit_table(path or default_tokenizer())
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo, hi, raw, off in W.slices(b["text"]):
                ids, n = table.ids(raw, off, END_ID)
                doc, start, length = decompose(n, most)
                # the pieces, one after the other, are exactly the slice's ids
                ends = np.zeros(len(length) + 1, np.int32)
                np.cumsum(4 * length, out=ends[1:])
                data = pa.Array.from_buffers(pa.binary(), len(length), [
                    None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
                names = b["doc_id"].slice(lo, hi - lo).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(start), pa.array(n[doc]), pa.array(number + np.arange(len(doc))),
                     pa.array(np.zeros(len(doc), np.int64)), data, pa.array(length)],
                    ["doc_id", "start", "doc_tokens", "sequence_id", "offset", "ids", "length"])
                number += len(doc)
    return job


def pack(docs: DataFrame, most: int = 4096, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write the sequences of all documents under ``length=<n>/`` folders and return them as read back:
    ``(doc_id, start, doc_tokens, sequence_id, offset, ids, length)``, one row a piece.

    ``ids`` holds little-endian unsigned 32-bit integers; ``start`` counts the document's ids before the
    piece, ``offset`` the sequence's (always 0).  ``sequence_id`` numbers the sequences of a task without gaps."""
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    spark = docs.sparkSession
    path = path or scratch_path(spark, "sequences")
    pieces = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .mapInArrow(_packer(tokenizer, most), f"{_SEQUENCES}, length long"))
    with small_batches(spark):
        pieces.write.partitionBy("length").option("compression", "zstd").parquet(path)
    return spark.read.schema(f"{_SEQUENCES}, length long").parquet(path)


def bucket_table(sequences: DataFrame) -> DataFrame:
    """``(length, n_sequences, n_tokens)``: what a schedule over the buckets has to know."""
    n = F.count(F.lit(1))
    return sequences.groupBy("length").agg(n.alias("n_sequences"), (n * F.col("length")).alias("n_tokens"))

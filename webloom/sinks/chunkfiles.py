"""Host-keyed chunk files.

A chunk (the records one host buffer flushed together, see
``operators.chunks.assign_chunks``) is encoded as one JSON array on one line;
lines are written as text under ``host=<host>/`` directories, so a scan for
some hosts prunes partitions, and every chunk stays about the flush size.
Chunk numbers are deterministic (no wall clock), so re-writing a host
cannot make two chunks collide.

A crawl writes a page again for every batch that reaches it.  Its files may be
``form="parquet"``: the same lines as rows of a column ``value``, by zstd in
pages of 32 MB, where a page of the web that comes again is found again (text
files know gzip at best, which looks back 32 KB).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder name of the host of empty name (a page whose URL has no authority):
#: a partition folder cannot tell an empty value from NULL.
EMPTY_HOST = "(empty)"
#: Consecutive chunks of a host that one task writes into one file.
CHUNKS_A_FILE = 64
#: Lines as Parquet.  A row group is one page: readers take whole batches of rows, but none beyond a row group.
PARQUET = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.enable.dictionary": "false",
           "parquet.page.size": str(32 << 20), "parquet.block.size": str(32 << 20),
           "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def chunk_payloads(records: DataFrame, *, host: str = "host", chunk: str = "chunk_no",
                   batch: str | None = None, order: str = "page_id", doc: str | None = None,
                   carry: tuple[str, ...] = (), dealt: str | None = None) -> DataFrame:
    """``(host, [batch_id,] chunk_no, payload)``: one JSON array per chunk,
    records in buffer order, with the ids of column ``doc`` as their
    ``doc_id`` where one is named and the columns of ``carry`` as further fields.  A chunk is bounded by the flush size plus one
    record, so collecting it is bounded by construction."""
    keys = [host] + ([dealt] if dealt else []) + ([batch] if batch else []) + [chunk]
    rec = F.struct(F.col(order).alias("_o"),
                   F.struct("url", "content", "timestamp", *([F.col(doc).alias("doc_id")] if doc else []), *carry).alias("r"))
    return (records.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(rec)).alias("_rs"))
            .select(*keys, F.to_json(F.transform("_rs", lambda x: x["r"])).alias("payload")))


def write_chunk_files(records: DataFrame, path: str, *, host: str = "host",
                      chunk: str = "chunk_no", batch: str | None = None,
                      order: str = "page_id", doc: str | None = None, mode: str = "overwrite",
                      layout: tuple[str, ...] = ("host",), carry: tuple[str, ...] = (),
                      dealt: str | None = None, form: str = "text") -> None:
    """``layout`` names the folders: by host (many chunks a file, one a line), or by host, batch
    and chunk number (one chunk a file, its number in the path).  ``carry`` names columns, such as
    batch and chunk number, that each record of a chunk holds.  ``dealt`` names a column, the same for
    all records of a chunk, by which with the host they have been dealt out already: no exchange here.
    ``form`` is text or parquet."""
    payloads = chunk_payloads(records, host=host, chunk=chunk, batch=batch, order=order, doc=doc, carry=carry, dealt=dealt)
    # spread by (host, chunk): a host with a large share of the records is
    # written by many tasks, each file holding whole chunks in chunk order
    keys = {"host": F.when(F.col(host) == "", EMPTY_HOST).otherwise(F.col(host)), "chunk_no": F.col(chunk),
            "batch_id": F.col(batch) if batch else None}
    # (with the chunk's number in the path), or by (host, run of chunks): files of many chunks, not of a few
    runs = [F.col(chunk)] if "chunk_no" in layout else [F.floor(F.col(chunk) / F.lit(CHUNKS_A_FILE))]
    if dealt:   # lines in the order of their text: like lines come together
        lines = payloads.select(*[keys[k].alias(k) for k in layout], F.col("payload").alias("value")).sortWithinPartitions(*layout, "value")
    else:
        lines = (payloads.repartition(host, *([batch] if batch else []), *runs).sortWithinPartitions(host, chunk)
                 .select(*[keys[k].alias(k) for k in layout], F.col("payload").alias("value")))
    out = lines.write.mode(mode).partitionBy(*layout)
    if form == "parquet":
        out.options(**PARQUET).parquet(path)
    else:
        out.text(path)

"""Splitting documents into passages, JSON record sizes, and host chunk files.

``assign_chunks`` reproduces a per-host buffer that appends records in order
and flushes once its JSON size reaches a limit (the flushed chunk may exceed
the limit; the reset depends on earlier resets, so it is not a running sum).
It runs in three Spark steps so that no host is ever processed whole:

1. per (host, block) of consecutive ``ord`` values: the block's transfer
   function, entry fill -> (exit fill, flushes).  Sizes are positive, so the
   first flush depends on the entry fill only through the block prefix that
   stays under the limit: the summary has at most ``limit / min size + 1``
   entries whatever the block length;
2. per host: fold the small block summaries in order to get each block's
   entry fill and chunk offset;
3. per (host, block): replay the block from its entry state.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.metrics import observed
from ..functions.splitter import split_text
from ..functions.text import json_string_length

CHUNK_SCHEMA = "doc_id long, source string, chunk_index int, chunk string"


def split_documents(docs: DataFrame, chunk_size: int = C.CHUNK_SIZE,
                    chunk_overlap: int = C.CHUNK_OVERLAP, *, id_col: str = "doc_id",
                    text_col: str = "text", source_col: str = "source",
                    observation=None) -> DataFrame:
    """``(doc_id, source, chunk_index, chunk)``: each whole text split, 1 -> n rows.

    Pass a ``pyspark.sql.Observation`` to collect the number of splits
    generated while the job runs (``{"splits": n}``)."""
    def job(batches):
        for pdf in batches:
            ids, srcs, idx, chunks = [], [], [], []
            for did, src, text in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
                for i, piece in enumerate(split_text(text, chunk_size, chunk_overlap)):
                    ids.append(did)
                    srcs.append(src)
                    idx.append(i)
                    chunks.append(piece)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"),
                                "source": pd.Series(srcs, dtype=object),
                                "chunk_index": pd.Series(idx, dtype="int32"),
                                "chunk": pd.Series(chunks, dtype=object)})
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                      F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return observed(src.mapInPandas(job, CHUNK_SCHEMA), observation, "splits")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def record_size(url, content, timestamp: float):
    """Length of ``json.dumps({"url": url, "content": content, "timestamp": ts})``."""
    fixed = 41 + len(repr(float(timestamp)))
    return (F.lit(fixed) + json_string_length(url) + json_string_length(content)).cast("bigint")


# ------------------------------------------------------------ chunk assignment
# A block summary is the block's transfer function (entry fill -> exit fill,
# flushes) in a bounded form:
#   total     sum of the block's sizes,
#   prefix    running sums of its first records, up to the first one reaching
#             the limit: the only places where the first flush can happen,
#   exit_fill, flushes  the exit fill and flush count when the first flush
#             happens at that record.
# Every summary, also of a concatenation of blocks, has at most
# ``limit / min size + 1`` entries.
SUMMARY_SCHEMA = ("host string, node long, total long, prefix array<long>, "
                  "exit_fill array<long>, flushes array<long>")
ENTRY_SCHEMA = "host string, node long, entry_fill long, entry_chunk long"
ASSIGN_SCHEMA = "host string, ord long, chunk_no long"


def _tails(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start p (0..n): exit fill and flush count of replaying
    sizes[p:] from an empty buffer."""
    n = len(sizes)
    cum = np.concatenate([[0], np.cumsum(sizes)])
    # first q >= p with cum[q+1] - cum[p] >= limit  (record q triggers the flush)
    nxt = np.searchsorted(cum, cum[:n] + limit, side="left") - 1
    exit_fill = np.zeros(n + 1, dtype=np.int64)
    flushes = np.zeros(n + 1, dtype=np.int64)
    for p in range(n - 1, -1, -1):
        q = nxt[p]
        if q >= n:
            exit_fill[p] = cum[n] - cum[p]
            flushes[p] = 0
        else:
            exit_fill[p] = exit_fill[q + 1]
            flushes[p] = 1 + flushes[q + 1]
    return exit_fill, flushes


def _apply(summary, fill: int, limit: int) -> tuple[int, int]:
    """(exit fill, flushes) of a summarised run entered with ``fill``."""
    total, prefix, ex, fl = summary
    i = int(np.searchsorted(prefix, limit - fill, side="left"))
    if i >= len(prefix):
        return fill + int(total), 0
    return int(ex[i]), int(fl[i])


def _compose(a, b, limit: int):
    """Summary of run ``a`` followed by run ``b``."""
    ta, pa, xa, ka = a
    tb, pb, xb, kb = b
    xs, ks = [], []
    for x, k in zip(xa, ka):
        e, f = _apply(b, int(x), limit)
        xs.append(e)
        ks.append(int(k) + f)
    prefix = list(pa)
    if len(pa) == 0 or pa[-1] < limit:   # no flush inside a for an empty entry: b's heads count
        for p, x, k in zip(pb, xb, kb):
            prefix.append(int(ta) + int(p))
            xs.append(int(x))
            ks.append(int(k))
            if int(ta) + int(p) >= limit:
                break
    return int(ta) + int(tb), np.asarray(prefix, dtype=np.int64), xs, ks


#: Blocks go to Python in bins, several to a shuffle partition: a call for each would cost more
#: than the work where buffers are many and small.
BINS = 16


def _binned(rows: DataFrame) -> DataFrame:
    bins = BINS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("_bin", F.pmod(F.xxhash64("host", "node"), F.lit(bins))).groupBy("_bin")


def _blocks(pdf):
    """(host, node, rows in order) of each block of a bin."""
    for (host, node), rows in pdf.sort_values("ord", kind="stable").groupby(["host", "node"], dropna=False, sort=False):
        yield (None if pd.isna(host) else host), node, rows


def _block_summary_fn(limit: int):
    def fn(pdf):
        out = []
        for host, node, rows in _blocks(pdf):
            s = rows["size"].to_numpy(dtype=np.int64)
            cum = np.cumsum(s)
            ex, fl = _tails(s, limit)
            c = min(int(np.searchsorted(cum, limit, side="left")) + 1, len(s))
            out.append((host, node, int(cum[-1]), cum[:c].tolist(), ex[1:c + 1].tolist(), (1 + fl[1:c + 1]).tolist()))
        return pd.DataFrame(out, columns=["host", "node", "total", "prefix", "exit_fill", "flushes"])
    return fn


def _rows(pdf):
    pdf = pdf.sort_values("node")
    return [(int(t), np.asarray(p, dtype=np.int64), list(x), list(k)) for t, p, x, k in
            zip(pdf["total"], pdf["prefix"], pdf["exit_fill"], pdf["flushes"])], pdf["node"].to_numpy()


def _merge_fn(limit: int):
    """Up-sweep: the summary of a parent node from its children, in order."""
    def fn(key, pdf):
        runs, _ = _rows(pdf)
        acc = runs[0]
        for r in runs[1:]:
            acc = _compose(acc, r, limit)
        return pd.DataFrame({"host": [key[0]], "node": [key[1]], "total": [acc[0]],
                             "prefix": [list(map(int, acc[1]))],
                             "exit_fill": [list(map(int, acc[2]))],
                             "flushes": [list(map(int, acc[3]))]})
    return fn


def _spread_fn(limit: int):
    """Down-sweep: entry state of each child from its parent's entry state."""
    def fn(key, pdf):
        runs, nodes = _rows(pdf)
        fill = int(pdf["entry_fill"].iloc[0])
        chunk = int(pdf["entry_chunk"].iloc[0])
        fills, chunks = [], []
        for r in runs:
            fills.append(fill)
            chunks.append(chunk)
            fill, f = _apply(r, fill, limit)
            chunk += f
        return pd.DataFrame({"host": key[0], "node": nodes, "entry_fill": fills,
                             "entry_chunk": chunks})
    return fn


def _replay_fn(limit: int):
    def fn(pdf):
        hosts, ords, numbers = [], [], []
        for host, _, rows in _blocks(pdf):
            fill, chunk = int(rows["entry_fill"].iloc[0]), int(rows["entry_chunk"].iloc[0])
            for size in rows["size"].tolist():
                numbers.append(chunk)
                fill += size
                if fill >= limit:
                    fill, chunk = 0, chunk + 1
            hosts += [host] * len(rows)
            ords.append(rows["ord"].to_numpy())
        return pd.DataFrame({"host": pd.Series(hosts, dtype=object), "ord": np.concatenate(ords), "chunk_no": numbers})
    return fn


def assign_chunks(records: DataFrame, limit: int = C.FLUSH_CHARS, *, host: str = "host",
                  ord_col: str = "page_id", size_col: str = "record_size",
                  block_width: int = 1_000_000, fan_out: int = 64) -> DataFrame:
    """``(host, ord, chunk_no)``: chunk number of every record of a host's
    ordered buffer that flushes after the record that brings it to ``limit``.

    Blocks are ``ord div block_width`` (``ord`` integral), so they are
    contiguous in order and hold at most ``block_width`` records.  Block
    summaries are combined up a tree of fan-out ``fan_out`` and entry states
    come back down it: every group holds at most ``fan_out`` bounded summaries
    or one block, whatever the size of the host.  Levels are cut with reliable
    checkpoints.
    """
    from ..session import cut_lineage
    slim = records.select(F.col(host).cast("string").alias("host"),
                          F.col(ord_col).cast("bigint").alias("ord"),
                          F.col(size_col).cast("bigint").alias("size"),
                          F.floor(F.col(ord_col) / F.lit(block_width)).cast("bigint").alias("node"))
    levels = [cut_lineage(_binned(slim).applyInPandas(_block_summary_fn(limit), SUMMARY_SCHEMA))]
    while True:   # up-sweep until every host has at most fan_out nodes
        top = levels[-1]
        widest = top.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if widest is None or widest <= fan_out:
            break
        parent = F.floor(F.col("node") / F.lit(fan_out)).cast("bigint")
        levels.append(cut_lineage(
            top.withColumn("child", F.col("node")).withColumn("node", parent)
            .groupBy("host", "node").applyInPandas(
                _merge_fn_ordered(limit), SUMMARY_SCHEMA)))
    # down-sweep: hosts start empty; children get entries from their parent
    zero = F.lit(0).cast("bigint")
    held = levels[-1].groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    lone = held.where("n = 1").select("host", "node", zero.alias("entry_fill"), zero.alias("entry_chunk"))
    more = held.where("n > 1").select(F.col("host").alias("_h"))
    many = (levels[-1].join(more, F.col("host").eqNullSafe(F.col("_h")), "left_semi")
            .withColumn("entry_fill", zero).withColumn("entry_chunk", zero).withColumn("parent", zero))
    entries = cut_lineage(many.groupBy("host", "parent").applyInPandas(_spread_fn(limit), ENTRY_SCHEMA)
                          .unionByName(lone))
    for lower in reversed(levels[:-1]):
        parent = F.floor(F.col("node") / F.lit(fan_out)).cast("bigint")
        kids = lower.withColumn("parent", parent)
        start = entries.select("host", F.col("node").alias("parent"), "entry_fill", "entry_chunk")
        entries = cut_lineage(_same(kids, start, "host", "parent")
                              .groupBy("host", "parent").applyInPandas(_spread_fn(limit),
                                                                       ENTRY_SCHEMA))
    return _binned(_same(slim, entries, "host", "node")).applyInPandas(_replay_fn(limit), ASSIGN_SCHEMA)


def _same(left: DataFrame, right: DataFrame, host: str, node: str) -> DataFrame:
    """Join on host (records without one, NULL, are a host of their own) and node."""
    renamed = right.withColumnsRenamed({host: "_h", node: "_n"})
    return left.join(renamed, left[host].eqNullSafe(F.col("_h")) & (left[node] == F.col("_n"))).drop("_h", "_n")


def _merge_fn_ordered(limit: int):
    """Up-sweep over children ordered by their own node id (``child``)."""
    inner = _merge_fn(limit)

    def fn(key, pdf):
        kids = pdf.drop(columns=["node"]).rename(columns={"child": "node"})
        return inner(key, kids)
    return fn


def chunk_assign_reference(sizes: list[int], limit: int) -> list[int]:
    """Plain sequential fold (for tests)."""
    out, fill, chunk = [], 0, 0
    for s in sizes:
        out.append(chunk)
        fill += s
        if fill >= limit:
            fill, chunk = 0, chunk + 1
    return out

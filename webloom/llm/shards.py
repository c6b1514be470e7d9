"""Uniform shuffle into shards of exact size (operator 7).

A uniform permutation of N rows cut into shards sends from source block i to
shard j a number of rows that is hypergeometric; all of them together form a
matrix with the blocks' row counts and the shards' sizes as margins.

1. Rows are staged in the shared folder with a coordinate (writing task, row),
   and counted in blocks of ``block_rows``.
2. The matrix is drawn by halving the blocks: at each node of that tree the
   shards' remaining rows are split between the halves by one multivariate
   hypergeometric draw, seeded by the node.  A task that needs block i draws
   only the nodes above it, so no one holds the matrix, and a task that is run
   again draws the same.
3. Each block permutes its rows and deals them out by its matrix row.
4. Rows are exchanged, and permuted again inside each shard, which gives slots.

The matrix has a column for each shard, so a block's draw does not grow with the
data.  The second permutation orders a shard by a random key.  Ranges of that key
are a shard's parts, each sorted by a task of its own and of about ``part_rows``
rows; the rows of earlier parts, from a table of counts, are added to its slots.

Defined results: shard sizes are at most one row apart; any rows, also equal
ones and nulls, are dealt one by one; an empty table gives no rows; all columns
are kept, but columns named ``shard`` or ``slot`` are replaced by the new ones.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from .tables import materialise

_LIMIT = 10 ** 9      # numpy's generator draws below this


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn without replacement."""
    if good + bad < _LIMIT:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    # inversion over 40 standard deviations, weights from the ratios of neighbours
    total = good + bad
    mean = n * (good / total)
    sd = math.sqrt(max(mean * (bad / total) * ((total - n) / (total - 1)), 1.0))
    lo, hi = max(lo, int(mean - 20 * sd) - 2), min(hi, int(mean + 20 * sd) + 2)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return lo + int(np.searchsorted(weights, rng.random() * weights[-1], "right"))


def split(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw of n from the colours."""
    if colours.sum() < _LIMIT:
        return rng.multivariate_hypergeometric(colours, n, method="marginals")
    out, rest = np.zeros_like(colours), int(colours.sum())
    for j, c in enumerate(colours.tolist()):
        rest -= c
        out[j] = hypergeometric(rng, c, rest, n)
        n -= int(out[j])
    return out


class CommunicationMatrix:
    """Rows that block i sends to column j, row by row on demand."""

    def __init__(self, blocks: np.ndarray, columns: np.ndarray, seed: int):
        self.before = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
        self.columns, self.seed = np.asarray(columns, np.int64), seed

    def row(self, i: int) -> np.ndarray:
        lo, hi, left = 0, len(self.before) - 1, self.columns
        while hi - lo > 1:
            mid = (lo + hi) // 2
            rng = np.random.Generator(np.random.PCG64([self.seed, 1, lo, hi]))
            first = split(rng, left, int(self.before[mid] - self.before[lo]))
            if i < mid:
                hi, left = mid, first
            else:
                lo, left = mid, left - first
        return left

    def deal(self, i: int) -> np.ndarray:
        """The column of each row of block i: a random arrangement of its matrix row."""
        rng = np.random.Generator(np.random.PCG64([self.seed, 2, i]))
        return rng.permutation(np.repeat(np.arange(len(self.columns), dtype=np.int32), self.row(i)))


def exact_sizes(total: int, parts: int) -> np.ndarray:
    return total // parts + (np.arange(parts) < total % parts)


def _new(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def shuffle(docs: DataFrame, shards: int = 40, seed: int = 7, block_rows: int = 1 << 16,
            part_rows: int = 1 << 17) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot`` (gapless from 0)."""
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    at, key, part = (_new(docs, name) for name in ("row_at", "row_key", "row_part"))
    staged = materialise(docs.withColumn(at, F.monotonically_increasing_id()), "staged")
    # a coordinate: writing task above bit 33, row below; a block's number is its task and its place there
    block = (F.shiftright(at, 33) * (1 << 33) + F.floor(F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) / block_rows)).cast("long")
    counts = staged.groupBy(block.alias("b")).count().orderBy("b").toArrow()      # one row for each block
    blocks, rows = counts["b"].to_numpy(), counts["count"].to_numpy()
    sizes = exact_sizes(int(rows.sum()), shards)
    parts = max(1, -(-int(sizes.max(initial=0)) // part_rows))
    shared = spark.sparkContext.broadcast((CommunicationMatrix(rows, sizes, seed), blocks))

    @F.pandas_udf("int")
    def shard_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, numbers = shared.value
        i, dealt = -1, None          # the block that the last row was of
        for places in batches:
            p = places.to_numpy()
            row = p & ((1 << 33) - 1)
            mine = np.searchsorted(numbers, (p >> 33 << 33) + row // block_rows)
            out = np.zeros(len(p), np.int32)
            for k in np.unique(mine).tolist():
                if k != i:
                    i, dealt = k, m.deal(k)
                here = mine == k
                out[here] = dealt[row[here] % block_rows]
            yield pd.Series(out)

    h = F.xxhash64(at, F.lit(seed))
    dealt = (staged.withColumn("shard", shard_of(at)).withColumn(key, h)
             .withColumn(part, F.floor(F.shiftrightunsigned(h, 11) / float(1 << 53) * parts).cast("int")))
    slot = F.row_number().over(SparkWindow.partitionBy("shard", part).orderBy(key, at)).cast("long") - 1
    placed = dealt.withColumn("slot", slot)
    if parts > 1:
        first, before = _new(docs, "part_first"), SparkWindow.partitionBy("shard").orderBy(part).rowsBetween(SparkWindow.unboundedPreceding, -1)
        # a row for each part: counted from coordinates alone, without the other columns
        held = (dealt.select("shard", part).groupBy("shard", part).count()
                .select("shard", part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(first)))
        placed = (placed.join(held, ["shard", part]).withColumn("slot", F.col("slot") + F.col(first)))
    return placed.select(*docs.columns, "shard", "slot")

"""Shared-folder tables and fixed-size Bloom filters used between jobs."""
from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, release, scratch_path

__all__ = ["Bloom", "ensure_checkpoint_dir", "materialise", "release", "read_table"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Whole texts cross to Python in batches of ``rows`` (the default of 10,000
    holds several copies of some 30 MB in each task); restored afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: what
    follows re-reads files instead of recomputing when an executor is lost."""
    spark = df.sparkSession
    path, schema = scratch_path(spark, name), df.schema
    with small_batches(spark):
        df.write.parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def _prime_below(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n -= 1
    return n


class Bloom:
    """Two-probe Bloom filter over 64-bit keys, ``bits`` long at any input size.

    Built by Spark (one bit_or aggregate; at most bits / 64 rows reach the
    driver) and broadcast.  False positives only cost rows later: every use is
    followed by an exact join or count.
    """

    def __init__(self, bits: int = 1 << 26):
        self.bits = bits
        self.primes = (_prime_below(bits - 1), _prime_below(bits - bits // 16))
        self.words = np.zeros((bits + 63) // 64, np.int64)

    def build(self, keys: DataFrame, column: str) -> "Bloom":
        probes = F.explode(F.array(*[F.pmod(F.col(column), F.lit(p)) for p in self.primes]))
        with small_batches(keys.sparkSession):
            rows = (keys.select(probes.alias("p"))
                    .groupBy(F.shiftright("p", 6).cast("int").alias("w"))
                    .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("b")).toArrow())
        self.words[rows["w"].to_numpy()] = rows["b"].to_numpy()
        return self

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.int64)
        out = np.ones(len(keys), bool)
        for p in self.primes:
            at = np.mod(keys, p)
            out &= (self.words[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
        return out

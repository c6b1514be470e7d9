"""Connected components of a link table by alternating large-star and
small-star rounds (Kiveris et al., 2014): O(log^2 n) rounds, each a few joins
over the links; a hot vertex is a skewed join, not one group in memory.

Before the rounds and after each, every block of ``block`` vertices at most is
put in stars where it lies, by a union-find of that size; the rounds then only
have to join what lies in different blocks.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(m, "u").where("v != m")
            .select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    m = e.groupBy("b").agg(F.min("a").alias("m"))
    moved = e.join(m, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(m.select(F.col("m").alias("a"), "b")).distinct()


def _contracted(e: DataFrame, links: int, block: int) -> DataFrame:
    """Stars in place of each block's links: (smallest vertex, vertex)."""
    def job(batches):
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def stars(schema):
            rows = [(r, v) for v in list(root) if (r := find(v)) != v]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], schema.field(i).type) for i in (0, 1)], ["a", "b"])

        for b in batches:
            for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist()):
                if (x := find(x)) != (y := find(y)):
                    root[max(x, y)] = min(x, y)
            if len(root) >= block:
                yield stars(b.schema)
        if root:
            yield stars(b.schema)
    return e.coalesce(1 + 2 * links // block).mapInArrow(job, e.schema)


def _sum(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, block: int = 1 << 17) -> DataFrame:
    """(node, comp) of every vertex of links (a, b): comp is the smallest node."""
    e = materialise(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                    "links")
    n = e.count()
    e = materialise(_contracted(e, n, block), "links")
    state = _sum(e) if 2 * n >= block else (0, 0)     # fewer were one block
    while state[0]:
        e = materialise(_contracted(_small_star(_large_star(e)), state[0], block), "links")
        was, state = state, _sum(e)
        if was == state:
            break
    return e.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(
        e.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())

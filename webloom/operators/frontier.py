"""Depth-limited reachability: the crawl frontier as iterated joins.

Depth 0 is the seeds; each round joins the newest frontier to the edges,
drops nodes already visited (anti join), keeps one row per node (the smallest
seed among the arrivals of that round: a URL reached from two seeds at the
same depth is filed under the smaller one), and cuts the lineage with a
reliable checkpoint in the shared checkpoint folder, so a lost executor
recomputes one round, not the whole history.  ``max_depth=None`` runs to the
fixpoint.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..session import cut_lineage


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = C.CRAWL_DEPTH, *,
          src: str = "src", dst: str = "dst", node: str = "node",
          seed: str = "seed") -> DataFrame:
    """``(node, depth, seed)`` of every node within ``max_depth`` hops."""
    # every round joins the same edges: computed once, already dealt out by the join key
    e = cut_lineage(edges.select(F.col(src).alias("_src"), F.col(dst).alias("_dst")).distinct().repartition("_src"))
    frontier = cut_lineage(seeds.groupBy(F.col(node).alias("node"))
                           .agg(F.min(seed).alias("seed")).withColumn("depth", F.lit(0)))
    visited = frontier
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = (frontier.join(e, frontier["node"] == e["_src"])
               .groupBy(F.col("_dst").alias("node")).agg(F.min("seed").alias("seed"))
               .join(visited.select("node"), "node", "left_anti")
               .withColumn("depth", F.lit(depth)))
        nxt = cut_lineage(nxt)
        if nxt.isEmpty():
            break
        visited = visited.unionByName(nxt)
        frontier = nxt
    return visited.select(F.col("node").alias(node), "depth", F.col("seed").alias(seed))


def link_edges(links: DataFrame, src: str = "url", dst: str = "link") -> DataFrame:
    """Page -> followed link edges (e.g. from ``pages.internal_links``)."""
    return links.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()

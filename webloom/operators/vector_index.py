"""Inverted lists of vectors: exact threshold joins and approximate nearest rows.

``build`` fits list centres on a bounded sample, assigns every row to the list of
its nearest centre (largest cosine) and writes the lists as partition folders, so a
search reads only the lists it probes.  With each row are written its angles to
its own centre and to the first few centres (the pivots).

* ``within`` is exact.  If a row lies at angle a from a pivot and a query at angle
  b, their own angle is at least |a - b| (triangle inequality on the sphere).  For
  each list the least and greatest of its rows' angles to each pivot give a bound
  on what any row of it can reach; a query meets only lists whose bound allows the
  threshold.  On vectors without structure (independent directions in many
  dimensions) all angles are near a right one and little can be excluded.
* ``nearest`` is approximate: a query probes the ``probes`` lists with the nearest
  centres, and their rows are ranked exactly.  Probing all lists is the exact search.

Inside a list, rows and queries meet in blocks (``similarity``), however large the
list is.  The driver holds the sample, the centres and one row of bounds a list, all
bounded by parameters.  Rows without a direction (null, zero norm) are kept in list -1,
which ``nearest`` always probes; their similarity is 0.  Rows that repeat an id are
rows of their own; an empty table gives an index that finds nothing.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import similarity as V
from .retrieval import top_k

NOWHERE = -1
_LISTS = "id long, vec array<double>, own double, angles array<double>, list int"
_SLACK = 1e-6      # of rounding in angles


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray      # one unit vector a list
    pivots: int

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """``(id, vec, own, angles, list)``; of some lists only, the other folders are pruned."""
        df = self.spark.read.schema(_LISTS).parquet(f"{self.path}/lists")
        return df if lists is None else df.where(F.col("list").isin(lists))

    def bounds(self) -> pd.DataFrame:
        """One row a list: rows in it, least and greatest angle to its own centre and to each pivot."""
        angle = lambda i: F.col("angles")[i]
        ends = [f(c).alias(f"{n}{k}") for k, c in [("_own", F.col("own")), *[(str(i), angle(i)) for i in range(self.pivots)]]
                for n, f in (("lo", F.min), ("hi", F.max))]
        return self.rows().where(F.col("list") != NOWHERE).groupBy("list").agg(F.count(F.lit(1)).alias("n"), *ends).toPandas()


def _unit(vecs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of the rows that have a direction, which rows those are)."""
    norms = np.array([0.0 if v is None else np.linalg.norm(np.asarray(v, np.float64)) for v in vecs])
    has = norms > 0
    if not has.any():
        return np.zeros((0, 0)), has
    return V._matrix(vecs[has]) / norms[has][:, None], has


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if not len(centres):
        return np.zeros((len(x), 0))
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    if not len(sample):
        return np.zeros((0, 0))
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:lists]]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def _assigner(centres: np.ndarray, pivots: int):
    def job(batches):
        for pdf in batches:
            x, has = _unit(pdf["vec"])
            n = len(pdf)
            lists, own, angles = np.full(n, NOWHERE, np.int32), np.zeros(n), np.zeros((n, pivots))
            if has.any() and len(centres):
                a = _angles(x, centres)
                near = a.argmin(1)
                lists[has], own[has], angles[has] = near, a[np.arange(len(a)), near], a[:, :pivots]
            yield pd.DataFrame({"id": pdf["id"], "vec": pdf["vec"], "own": own, "angles": list(angles), "list": lists})
    return job


def _write(vectors: DataFrame, path: str, centres: np.ndarray, pivots: int, salts: int, id_col: str, vec_col: str,
           mode: str) -> None:
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    (rows.mapInPandas(_assigner(centres, pivots), _LISTS)
     .repartition("list", F.pmod(F.xxhash64("id"), F.lit(salts)))     # a large list is written by several tasks
     .write.mode(mode).partitionBy("list").parquet(f"{path}/lists"))


def build(vectors: DataFrame, path: str, *, id_col: str = "vec_id", vec_col: str = "embedding", lists: int = 64,
          pivots: int = 8, sample: int = 20_000, salts: int = 8) -> VectorIndex:
    """Index every row of ``vectors`` under ``path``.  Centres are fitted on at most ``sample`` rows,
    chosen by a hash of their id."""
    spark, n = vectors.sparkSession, vectors.count()
    chosen = vectors.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(max(1, n // sample))) == 0).limit(sample)
    x, _ = _unit(chosen.select(F.col(vec_col).cast("array<double>").alias("vec")).toPandas()["vec"])
    centres = fit_centres(x, lists)
    pivots = min(pivots, len(centres))
    spark.createDataFrame([(i, c.tolist(), pivots) for i, c in enumerate(centres)],
                          "list int, centre array<double>, pivots int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _write(vectors, path, centres, pivots, salts, id_col, vec_col, "overwrite")
    return VectorIndex(spark, path, centres, pivots)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()    # one a list
    return VectorIndex(spark, path, np.array([r.centre for r in rows]) if rows else np.zeros((0, 0)), rows[0].pivots if rows else 0)


def append(index: VectorIndex, vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", salts: int = 8) -> None:
    """Assign further rows to the lists there are."""
    _write(vectors, index.path, index.centres, index.pivots, salts, id_col, vec_col, "append")


def _probed(queries: DataFrame, choose, always: list[int], id_col: str, vec_col: str) -> DataFrame:
    """``(list, id, vec)``: each query once for each list it probes (``choose``: unit vectors to a
    row of flags for each), and for the lists in ``always``."""
    def job(batches):
        for pdf in batches:
            x, has = _unit(pdf["vec"])
            row, lists = np.nonzero(choose(x)) if has.any() else (np.zeros(0, int), np.zeros(0, int))
            row = np.concatenate([np.flatnonzero(has)[row], np.repeat(np.arange(len(pdf)), len(always))])
            lists = np.concatenate([lists, np.tile(np.array(always, int), len(pdf))]).astype(np.int32)
            yield pd.DataFrame({"list": lists, "id": pdf["id"].to_numpy()[row], "vec": pdf["vec"].to_numpy()[row]})
    rows = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInPandas(job, "list int, id long, vec array<double>")


def _meet(index: VectorIndex, probed: DataFrame) -> DataFrame:
    """The rows of the lists that any query probes (list numbers reach the driver)."""
    lists = sorted(r.list for r in probed.select("list").distinct().collect())
    return index.rows(lists).select("list", "id", "vec")


def reachable(index: VectorIndex, bounds: pd.DataFrame, threshold: float):
    """From unit vectors to flags: which lists may hold a row of cosine ``threshold`` or more."""
    if not threshold > 0:
        raise ValueError("a threshold above 0 is needed: rows without a direction have similarity 0")
    limit = float(np.arccos(min(threshold, 1.0))) + _SLACK
    centres, pivots, at = index.centres, index.pivots, bounds["list"].to_numpy(np.int64)
    lo = bounds[["lo_own", *[f"lo{i}" for i in range(pivots)]]].to_numpy(np.float64)
    hi = bounds[["hi_own", *[f"hi{i}" for i in range(pivots)]]].to_numpy(np.float64)

    def choose(x: np.ndarray) -> np.ndarray:
        a = _angles(x, centres)
        out = np.zeros((len(x), len(centres)), bool)
        ok = np.maximum(a[:, at] - hi[:, 0], lo[:, 0] - a[:, at]) <= limit
        for p in range(pivots):
            ok &= np.maximum(a[:, p:p + 1] - hi[:, p + 1], lo[:, p + 1] - a[:, p:p + 1]) <= limit
        out[:, at] = ok
        return out
    return choose


def within(queries: DataFrame, index: VectorIndex, threshold: float, *, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """``(i, j, sim)``: every pair of a query and an indexed row with cosine >= ``threshold``."""
    probed = _probed(queries, reachable(index, index.bounds(), threshold), [], id_col, vec_col)
    return V.matches(probed, _meet(index, probed), threshold, q_id="id", d_id="id", vec_col="vec", scope="list").drop("list")


def skipped_share(queries: DataFrame, index: VectorIndex, threshold: float, *, id_col: str = "vec_id",
                  vec_col: str = "embedding") -> float:
    """The share of (query, row) pairs that ``within`` never brings together."""
    bounds = index.bounds()
    met = (_probed(queries, reachable(index, bounds, threshold), [], id_col, vec_col).groupBy("list").count().toPandas()
           .merge(bounds[["list", "n"]], on="list"))
    pairs = queries.count() * int(bounds["n"].sum())
    return 1.0 - float((met["count"] * met["n"]).sum()) / pairs if pairs else 0.0


def nearest(queries: DataFrame, index: VectorIndex, k: int = 4, probes: int | None = None, *, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """``(qid, rank, did, sim)``: the k best rows of the ``probes`` lists nearest to each query (None: all)."""
    centres = index.centres
    n = len(centres) if probes is None else min(probes, len(centres))

    def choose(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(centres)), bool)
        if n:
            np.put_along_axis(out, np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n], True, axis=1)
        return out
    probed = _probed(queries, choose, [NOWHERE], id_col, vec_col)
    best = V.knn(probed, _meet(index, probed), k, q_id="id", d_id="id", vec_col="vec", scope="list")
    return top_k(best.drop("list", "rank"), k, by="qid").select("qid", "rank", "did", "sim")

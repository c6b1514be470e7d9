"""Exact cosine similarity over embedding tables, by blocks.

Rows are hashed into blocks of at most about ``block_rows`` rows per scope
(the scope is e.g. a question, or the whole table).  Every (left block, right
block) pair of a scope becomes one cogroup; inside it NumPy multiplies the two
blocks and emits only what the operator asks for: pairs above a threshold, or
the k best per left row.  No cross join is planned and no row per candidate
pair is ever materialised, and a scope holding a large share of the rows is
spread over many block pairs instead of one task.

The number of blocks per scope comes from a grouped count (a distributed
aggregate joined back on the scope key; for the whole table, a scalar count),
so block sizes stay bounded whatever the skew.  Self-similarity uses only blocks ``lb <= rb`` and mirrors the
result.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import top_k

DEFAULT_BLOCK_ROWS = 2048
_SCOPE = "_scope"


def cosine(a: Column, b: Column) -> Column:
    """JVM expression: cosine of two float arrays in double; zero norm -> 0."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
        F.lit(0.0), lambda s, v: s + v)
    den = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def _scope_type(df: DataFrame, scope: str | None) -> str:
    return df.schema[scope].dataType.simpleString() if scope else "int"


def _key_col(value, n: int) -> pd.Series:
    return pd.Series([value] * n)


def _nothing(*names: str) -> pd.DataFrame:
    """No rows; of a type that becomes the declared one, strings included."""
    return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})


def _prep(df: DataFrame, id_col: str, vec_col: str, scope: str | None) -> DataFrame:
    sc = F.col(scope) if scope else F.lit(0)
    return df.select(sc.alias(_SCOPE), F.col(id_col).cast("bigint").alias("id"),
                     F.col(vec_col).alias("vec"))


def _block_counts(df: DataFrame, block_rows: int, name: str) -> DataFrame:
    return (df.groupBy(_SCOPE).agg(F.count(F.lit(1)).alias(f"{name}_n"))
            .withColumn(f"{name}_nb",
                        F.greatest(F.lit(1), F.ceil(F.col(f"{name}_n") / F.lit(block_rows))).cast("int")))


def _counter(counts: list[tuple[DataFrame, str]], block_rows: int, scoped: bool):
    """A function attaching ``<name>_n`` / ``<name>_nb`` of every (table, name).

    Scoped: an equi-join with the per-scope counts.  Unscoped: each count is
    one scalar (a distributed count, taken once), attached as a literal, so
    no join on a constant key (a cross join) is ever planned.
    """
    if scoped:
        tables = [_block_counts(src, block_rows, name) for src, name in counts]

        def attach(df: DataFrame) -> DataFrame:
            for t in tables:
                df = df.join(t, _SCOPE)
            return df
        return attach
    sizes = [(name, src.count()) for src, name in counts]

    def attach_lit(df: DataFrame) -> DataFrame:
        for name, n in sizes:
            df = (df.withColumn(f"{name}_n", F.lit(n).cast("bigint"))
                  .withColumn(f"{name}_nb", F.lit(max(1, -(-n // block_rows))).cast("int")))
        return df
    return attach_lit


def _block_of(nb: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(nb)).cast("int")


def _matrix(vecs: pd.Series) -> np.ndarray:
    if len(vecs) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in vecs])


def _cosine_block(lp: pd.DataFrame, rp: pd.DataFrame) -> np.ndarray:
    L, R = _matrix(lp["vec"]), _matrix(rp["vec"])
    ln, rn = np.linalg.norm(L, axis=1), np.linalg.norm(R, axis=1)
    den = np.outer(ln, rn)
    with np.errstate(divide="ignore", invalid="ignore"):
        S = (L @ R.T) / den
    S[den == 0] = 0.0
    return S


PAIR_SCHEMA = "_scope {t}, i long, j long, sim double"


def _pairs_fn(threshold: float):
    def fn(key, lp, rp):
        if len(lp) == 0 or len(rp) == 0:
            return _nothing("_scope", "i", "j", "sim")
        S = _cosine_block(lp, rp)
        keep = S >= threshold
        lids, rids = lp["id"].to_numpy(), rp["id"].to_numpy()
        if key[1] == key[2] and int(lp["_n"].iloc[0]) == 1:
            keep[:, :] = True  # a lone answer is its own neighbourhood
        ii, jj = np.nonzero(keep)
        i, j, s = lids[ii], rids[jj], S[ii, jj]
        if key[1] != key[2]:  # off-diagonal block: mirror
            i, j, s = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([s, s])
        return pd.DataFrame({"_scope": _key_col(key[0], len(i)), "i": i, "j": j, "sim": s})
    return fn


def similarity_pairs(vectors: DataFrame, threshold: float, *, id_col: str = "vec_id",
                     vec_col: str = "embedding", scope: str | None = None,
                     block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """All ordered pairs ``(i, j)`` of one scope with cosine >= threshold,
    self pairs included (neighbourhoods, not transitive).  Returns
    ``(scope?, i, j, sim)`` with ``sim`` unrounded."""
    base = _prep(vectors, id_col, vec_col, scope)
    rows = _counter([(base, "l")], block_rows, scope is not None)(base) \
        .withColumn("_b", _block_of("l_nb"))
    left = (rows.withColumn("rb", F.explode(F.sequence(F.col("_b"), F.col("l_nb") - 1)))
            .select(_SCOPE, F.col("_b").alias("lb"), "rb", "id", "vec",
                    F.col("l_n").alias("_n")))
    # fresh aliases: both sides come from the same rows and must not share attributes
    right = (rows.withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("_b"))))
             .select(F.col(_SCOPE).alias(_SCOPE), F.col("lb").alias("lb"),
                     F.col("_b").alias("rb"), F.col("id").alias("id"),
                     F.col("vec").alias("vec")))
    out = (left.groupBy(_SCOPE, "lb", "rb")
           .cogroup(right.groupBy(_SCOPE, "lb", "rb"))
           .applyInPandas(_pairs_fn(threshold), PAIR_SCHEMA.format(t=_scope_type(vectors, scope))))
    if scope:
        return out.withColumnRenamed(_SCOPE, scope)
    return out.drop(_SCOPE)


def _meeting(queries: DataFrame, corpus: DataFrame, q_id: str, d_id: str, vec_col: str,
             scope: str | None, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Query and corpus rows, each once for every (query block, corpus block) it takes part in."""
    q = _prep(queries, q_id, vec_col, scope)
    c = _prep(corpus, d_id, vec_col, scope)
    attach = _counter([(q, "q"), (c, "c")], block_rows, scope is not None)
    qrows = (attach(q).withColumn("qb", _block_of("q_nb"))
             .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("c_nb") - 1)))
             .select(_SCOPE, "qb", "cb", "id", "vec"))
    crows = (attach(c).withColumn("cb", _block_of("c_nb"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_nb") - 1)))
             .select(_SCOPE, "qb", "cb", "id", "vec"))
    return qrows, crows


def matches(queries: DataFrame, corpus: DataFrame, threshold: float, *, q_id: str = "vec_id",
            d_id: str = "vec_id", vec_col: str = "embedding", scope: str,
            block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``(scope, i, j, sim)``: query ``i`` and corpus row ``j`` of one scope with
    cosine >= threshold, ``sim`` unrounded."""
    left, right = _meeting(queries, corpus, q_id, d_id, vec_col, scope, block_rows)

    def fn(key, qp, cp):
        if len(qp) == 0 or len(cp) == 0:
            return _nothing("_scope", "i", "j", "sim")
        S = _cosine_block(qp, cp)
        ii, jj = np.nonzero(S >= threshold)
        return pd.DataFrame({"_scope": _key_col(key[0], len(ii)), "i": qp["id"].to_numpy()[ii],
                             "j": cp["id"].to_numpy()[jj], "sim": S[ii, jj]})
    out = (left.groupBy(_SCOPE, "qb", "cb").cogroup(right.groupBy(_SCOPE, "qb", "cb"))
           .applyInPandas(fn, PAIR_SCHEMA.format(t=_scope_type(queries, scope))))
    return out.withColumnRenamed(_SCOPE, scope)


def knn_within(queries: DataFrame, corpus: DataFrame, k: int, within: str, *, q_id: str = "id", d_id: str = "id",
               vec_col: str = "embedding", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``(within, qid, rank, did, sim)``: for every query the k nearest rows of each value of
    the corpus column ``within`` (rows where it is null take no part).  Blocks are by id, so a
    value that holds most rows is spread; a block emits at most k rows a query and value."""
    q = _prep(queries, q_id, vec_col, None)
    c = corpus.where(F.col(within).isNotNull()).select(
        F.lit(0).alias(_SCOPE), F.col(d_id).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), F.col(within).alias("_in"))
    attach = _counter([(q, "q"), (c, "c")], block_rows, False)
    left = (attach(q).withColumn("qb", _block_of("q_nb"))
            .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("c_nb") - 1))).select("qb", "cb", "id", "vec"))
    right = (attach(c).withColumn("cb", _block_of("c_nb"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_nb") - 1))).select("qb", "cb", "id", "vec", "_in"))

    def fn(key, qp, cp):
        if len(qp) == 0 or len(cp) == 0:
            return _nothing("_in", "qid", "did", "sim")
        S = _cosine_block(qp, cp)
        values, code = np.unique(cp["_in"].to_numpy(dtype=object), return_inverse=True)
        dids = cp["id"].to_numpy()
        order = np.lexsort((np.broadcast_to(dids, S.shape), -np.round(S, 6), np.broadcast_to(code, S.shape)), axis=1)
        # a value's rows stand at the same places of every query's order
        by_value = np.sort(code)
        order = order[:, np.arange(len(code)) - np.searchsorted(by_value, by_value) < k]
        rows, cols = np.repeat(np.arange(S.shape[0]), order.shape[1]), order.ravel()
        return pd.DataFrame({"_in": pd.Series(values[code[cols]], dtype=object), "qid": qp["id"].to_numpy()[rows], "did": dids[cols], "sim": S[rows, cols]})
    out = (left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb"))
           .applyInPandas(fn, f"_in {_scope_type(corpus, within)}, qid long, did long, sim double")
           .withColumn("sim", F.round("sim", 6)))
    return top_k(out, k, by=["qid", "_in"]).select(F.col("_in").alias(within), "qid", "rank", "did", "sim")


KNN_SCHEMA = "_scope {t}, qid long, did long, sim double"


def _knn_fn(k: int):
    def fn(key, qp, cp):
        if len(qp) == 0 or len(cp) == 0:
            return _nothing("_scope", "qid", "did", "sim")
        S = _cosine_block(qp, cp)
        R6 = np.round(S, 6)
        dids = cp["id"].to_numpy()
        order = np.lexsort((np.broadcast_to(dids, S.shape), -R6), axis=1)[:, :k]
        rows = np.repeat(np.arange(S.shape[0]), order.shape[1])
        cols = order.ravel()
        return pd.DataFrame({"_scope": _key_col(key[0], len(rows)),
                             "qid": qp["id"].to_numpy()[rows], "did": dids[cols],
                             "sim": S[rows, cols]})
    return fn


def knn(queries: DataFrame, corpus: DataFrame, k: int = 4, *,
        q_id: str = "vec_id", d_id: str = "vec_id", vec_col: str = "embedding",
        scope: str | None = None, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Exact k nearest corpus rows (cosine; L2 order for unit vectors) per query,
    within the same scope when given.  ``(scope?, qid, rank, did, sim)``,
    ``sim`` rounded to 6 places and ranked (sim desc, did asc)."""
    qrows, crows = _meeting(queries, corpus, q_id, d_id, vec_col, scope, block_rows)
    cand = (qrows.groupBy(_SCOPE, "qb", "cb").cogroup(crows.groupBy(_SCOPE, "qb", "cb"))
            .applyInPandas(_knn_fn(k), KNN_SCHEMA.format(t=_scope_type(queries, scope)))
            .withColumn("sim", F.round("sim", 6)))
    best = top_k(cand, k, by=[_SCOPE, "qid"] if scope else "qid")
    cols = ([F.col(_SCOPE).alias(scope)] if scope else []) + ["qid", "rank", "did", "sim"]
    return best.select(*cols)

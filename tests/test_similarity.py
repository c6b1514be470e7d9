import math

from pyspark.sql import functions as F

from webloom.operators import reconcile as RC
from webloom.operators import similarity as V
from webloom.session import table

from conftest import SF01


def _vecs_with_sims():
    # unit vectors with sim(0,1)=0.9, sim(1,2)=0.9, sim(0,2)=0.7 (0.5 is not
    # realisable by vectors together with the other two; 0.7 is, and is below 0.85)
    v0 = [1.0, 0.0, 0.0]
    v1 = [0.9, math.sqrt(1 - 0.81), 0.0]
    c = (0.9 - 0.9 * 0.7) / math.sqrt(0.19)
    v2 = [0.7, c, math.sqrt(1 - 0.49 - c * c)]
    return [v0, v1, v2]


def test_neighbourhoods_not_transitive(spark):
    rows = [(0, i, v) for i, v in enumerate(_vecs_with_sims())]
    df = spark.createDataFrame(rows, "question long, answer_id long, embedding array<float>")
    pairs = RC.neighbourhoods(df, 0.85)
    got = {}
    for r in pairs.collect():
        got.setdefault(r.i, []).append(r.j)
    assert {k: sorted(v) for k, v in got.items()} == {0: [0, 1], 1: [0, 1, 2], 2: [1, 2]}
    assert RC.best_cluster(pairs).first().i == 1


def test_all_below_threshold_and_lone_answer(spark):
    rows = [(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (1, 5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "question long, answer_id long, embedding array<float>")
    best = {r.question: (r.i, r.size) for r in RC.best_cluster(RC.neighbourhoods(df, 0.85)).collect()}
    assert best == {0: (0, 1), 1: (5, 1)}


def test_vote_and_sources(spark):
    rows = [(0, 0, "x", 0.2, [1.0, 0.0], ["s1"]), (0, 1, "y", 0.4, [1.0, 0.0], ["s2"]),
            (0, 2, "x", 0.6, [1.0, 0.0], ["s1", "s3"]), (0, 3, "far", 0.9, [0.0, 1.0], ["s4"])]
    df = spark.createDataFrame(rows, "question long, answer_id long, answer string, confidence double, "
                                     "embedding array<float>, sources array<string>")
    qs = spark.createDataFrame([(0,), (7,)], "question long")
    out = {r.question: r for r in RC.reconcile(df, qs, 0.85).collect()}
    assert out[0].answer == "x" and abs(out[0].confidence - 0.4) < 1e-12
    assert out[0].sources == ["s1", "s2", "s3", "s4"]
    assert (out[7].answer, out[7].sources, out[7].confidence) == ("No valid answers found.", [], 0.0)


def test_vote_tie_smallest(spark):
    rows = [(0, 0, "y", 0.1, [1.0, 0.0]), (0, 1, "x", 0.1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "question long, answer_id long, answer string, confidence double, "
                                     "embedding array<float>")
    assert RC.best_answer(df, RC.neighbourhoods(df, 0.85)).first().answer == "x"


def test_blocked_pairs_equal_jvm_cosine(spark):
    e = table(spark, SF01, "embeddings").where(F.col("label") < 3)
    small = V.similarity_pairs(e, 0.3, block_rows=37).select("i", "j")
    a, b = e.alias("a"), e.alias("b")
    brute = (a.join(b, F.col("a.label") == F.col("b.label"))  # same-label pairs, then a global check below
             .select(F.col("a.vec_id").alias("i"), F.col("b.vec_id").alias("j"),
                     V.cosine(F.col("a.embedding"), F.col("b.embedding")).alias("s")))
    whole = V.similarity_pairs(e, 0.3).select("i", "j")
    assert small.exceptAll(whole).count() == 0 and whole.exceptAll(small).count() == 0
    same_label = brute.where("s >= 0.3").select("i", "j")
    scoped = V.similarity_pairs(e, 0.3, scope="label", block_rows=29).select("i", "j")
    assert scoped.exceptAll(same_label).count() == 0 and same_label.exceptAll(scoped).count() == 0


def test_knn_multi_block_equals_single_block(spark):
    e = table(spark, SF01, "embeddings")
    a = V.knn(e, e, 4, block_rows=64)
    b = V.knn(e, e, 4)
    assert a.count() == 2000
    assert a.exceptAll(b).count() == 0
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and "Join Cross" not in plan


def test_scoped_knn_ranks_each_scope(spark):
    from webloom.operators import similarity as V
    q = spark.createDataFrame([(1, "h1", [1.0, 0.0]), (1, "h2", [1.0, 0.0])], "vec_id long, host string, embedding array<double>")
    c = spark.createDataFrame([(i, f"h{i % 2 + 1}", [1.0, i / 10]) for i in range(12)], "vec_id long, host string, embedding array<double>")
    got = sorted((r.host, r["rank"], r.did) for r in V.knn(q, c, 2, scope="host").collect())
    assert got == [("h1", 1, 0), ("h1", 2, 2), ("h2", 1, 1), ("h2", 2, 3)]


def test_knn_of_every_hundredth_row(spark):
    import numpy as np
    import __spark_entry__ as E
    rows = table(spark, SF01, "embeddings").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    m = np.array([r.embedding for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    want = set()
    for q in np.flatnonzero(ids % 100 == 0):
        sim = np.round(m @ m[q], 6)
        best = np.lexsort((ids, -sim))[:4]
        want |= {(ids[q], k + 1, ids[i]) for k, i in enumerate(best)}
    got = {(r.qid, r.rank, r.did) for r in E.queries()["knn_top4_rows"](spark, SF01).collect()}
    assert got == want and len(got) == 4 * (ids % 100 == 0).sum() > 4

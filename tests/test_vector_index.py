"""Inverted lists: exact threshold join, approximate nearest rows."""
import numpy as np
import pytest

import __spark_entry__ as E
from conftest import SF001, SF01
from webloom.operators import vector_index as VI


def clustered(n=900, d=16, groups=12, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, d))
    return centres[r.integers(0, groups, n)] + 0.08 * r.normal(size=(n, d))


def frame(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v], i % 3) for i, v in enumerate(x)],
                                 "vec_id long, embedding array<double>, label int")


def cosines(x):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return u @ u.T


@pytest.mark.parametrize("threshold", [0.3, 0.85, 0.995])
def test_threshold_join_is_exact_and_prunes(spark, tmp_path, threshold):
    x = clustered()
    x[5] = 0.0
    df = frame(spark, x)
    index = VI.build(df, str(tmp_path / "ix"), lists=24, pivots=4)
    queries = df.where("vec_id % 10 = 0")
    got = {(r.i, r.j) for r in VI.within(queries, index, threshold).collect()}
    s = cosines(x)
    assert got == {(i, j) for i in range(0, len(x), 10) for j in range(len(x)) if s[i, j] >= threshold and abs(s[i, j]) > 0}
    share = VI.skipped_share(queries, index, threshold)
    assert share > (0.1 if threshold < 0.8 else 0.75)


def test_every_row_is_in_one_list_and_all_probes_are_exact(spark, tmp_path):
    x = clustered(seed=2)
    df = frame(spark, x)
    index = VI.build(df, str(tmp_path / "ix"), lists=20, sample=200)     # fitted on a fraction, holds all
    assert sorted(r.id for r in index.rows().select("id").collect()) == list(range(len(x)))
    again = VI.open_index(spark, index.path)
    assert np.array_equal(again.centres, index.centres) and again.pivots == index.pivots
    q = df.where("vec_id % 10 = 0")
    s = np.round(cosines(x), 6)
    want = {(i, r + 1, int(j)) for i in range(0, len(x), 10) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:4])}
    assert {(r.qid, r["rank"], r.did) for r in VI.nearest(q, again, 4).collect()} == want
    few = {(r.qid, r.did) for r in VI.nearest(q, again, 4, probes=3).collect()}
    assert len(few & {(i, j) for i, _, j in want}) >= 0.9 * len(want)


def test_searches_read_probed_lists_only(spark, tmp_path):
    df = frame(spark, clustered())
    index = VI.build(df, str(tmp_path / "ix"), lists=24)
    probed = VI._probed(df.where("vec_id = 3"), VI.reachable(index, index.bounds(), 0.99), [], "vec_id", "embedding")
    plan = VI._meet(index, probed)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    lists = {r.list for r in VI._meet(index, probed).collect()}
    assert 1 <= len(lists) < 12


def test_append_joins_the_lists_there_are(spark, tmp_path):
    x = clustered(seed=3)
    df = frame(spark, x)
    index = VI.build(df.where("vec_id < 700"), str(tmp_path / "ix"), lists=16)
    VI.append(index, df.where("vec_id >= 700"))
    s = cosines(x)
    got = {(r.i, r.j) for r in VI.within(df.where("vec_id % 50 = 0"), VI.open_index(spark, index.path), 0.9).collect()}
    assert got == {(i, j) for i in range(0, len(x), 50) for j in range(len(x)) if s[i, j] >= 0.9}


def test_rows_without_a_direction_repeats_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    some = df.where("embedding is not null")
    index = VI.build(some, str(tmp_path / "a"), lists=2)
    assert sorted((r.i, r.j) for r in VI.within(some, index, 0.5).collect()) == [(1, 1)] * 4 + [(4, 4)]
    assert {r.did for r in VI.nearest(some.where("vec_id = 4"), index, 9).collect()} == {1, 2, 4}
    withnull = VI.build(df, str(tmp_path / "b"), lists=2)
    assert withnull.rows().where("list = -1").count() == 2
    with pytest.raises(ValueError):
        VI.within(df, index, 0.0)
    empty = VI.build(df.limit(0), str(tmp_path / "c"))
    assert VI.within(some, empty, 0.5).count() == 0 and VI.nearest(some, empty).count() == 0


def test_recall_on_the_given_vectors(spark):
    q = E.queries()
    for sf in (SF001, SF01):
        exact = {(r.qid, r.did) for r in q["knn_top4_rows"](spark, sf).collect()}
        got = {(r.qid, r.did) for r in q["knn_index_top4"](spark, sf).collect()}
        assert len(got & exact) >= 0.9 * len(exact)

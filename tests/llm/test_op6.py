import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm.mixing import _numbers, domains, fit_rates, mixed, rates, train

from .tests_data import SF01, SF001


def nnls_residual(x, goal):
    """Least squares over r >= 0 by plain projected gradient from 1."""
    r = np.ones(len(x))
    step = 1 / np.linalg.norm(x.T @ x, 2)
    for _ in range(200_000):
        r = np.maximum(0, r - step * (x @ (r @ x - goal)))
    return np.linalg.norm(r @ x - goal)


@pytest.mark.parametrize("target", [[0.7, 0.2, 0.1], [0.05, 0.05, 0.9], [1.0, 0.0, 0.0]])
def test_rates_solve_the_least_squares(spark, target):
    g = np.random.default_rng(5)
    n, p = g.integers(1, 60, 80), g.dirichlet([0.4, 0.3, 0.3], 80)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "_n long, _p array<double>")
    steps = fit_rates(df, np.array(target))
    r = np.ones(80)
    for v in steps:
        r = np.maximum(0, r - n * (p @ v))
    x = n[:, None] * p
    goal = np.array(target) * n.sum()
    assert np.isclose(steps.residual, np.abs(r @ x - goal).max() / n.sum(), atol=1e-9)
    assert (r >= 0).all() and np.linalg.norm(r @ x - goal) <= nnls_residual(x, goal) + 0.02 * n.sum()


def test_numbers_round_trip(spark):
    v = np.array([0.1, -1e-17, 3e300, 7.0])
    assert spark.range(1).select(_numbers(v).alias("x")).first().x == v.tolist()


def test_totals_meet_targets(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    rows = rates(docs, labels, {"clean": 8, "toxic": 1, "low": 1}).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    p, n, r = np.array([x.posterior for x in rows]), np.array([x.n_tokens for x in rows]), np.array([x.rate for x in rows])
    assert np.allclose(p.sum(1), 1) and rows[0].domains == ["clean", "low", "toxic"]
    got = (r * n) @ p / n.sum()
    assert np.allclose(got, [0.8, 0.1, 0.1], atol=1e-4)
    assert np.isclose(rows[0].residual, np.abs(got - [0.8, 0.1, 0.1]).max(), atol=1e-9)
    truth = {x.doc_id: x.domain for x in domains(labels).collect()}
    right = [rows[i].domains[int(p[i].argmax())] == truth[rows[i].doc_id] for i in range(len(rows)) if rows[i].doc_id in truth]
    assert np.mean(right) > 0.85


def test_posteriors_match_plain_bayes(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "c c D!"), (3, "a c"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = train(docs, domains(labels), temper=3.0)
    where = {w: r.b for w, r in zip("abc", spark.createDataFrame([("a",), ("b",), ("c",)], "w string").select(
        F.xxhash64("w").bitwiseAND(F.lit(8191)).alias("b")).collect())}
    by = {r.doc_id: r.posterior for r in rates(docs, labels, {"clean": 1, "low": 1}).collect()}
    assert abs(model.words[0, where["b"]] - np.log(2.5 / (3 + 0.5 * 8192))) < 1e-9
    level = model.stats[:, np.arange(4), 0].sum(1)
    word = (model.words[:, where["a"]] + model.words[:, where["c"]]) / 2 * 40
    logit = model.prior + level + word
    want = np.exp(logit - logit.max())
    assert np.allclose(by[3], want / want.sum()) and np.isclose(sum(by[4]), 1)


def test_mixed_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "x"), (3, "", "y"), (3, "w " * 20000, "z")], "doc_id long, text string, lang string")
    both = docs.unionByName(odd, allowMissingColumns=True).withColumn("_n", F.lit(1)).withColumn("_row", F.lit("a"))
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    out = mixed(both, labels, {"clean": 0.9, "toxic": 0.05, "low": 0.05})
    assert out.columns == both.columns and out.dtypes == both.dtypes
    assert out.where("doc_id IS NULL OR text = ''").count() >= 2          # no tokens: rate 1
    assert out.exceptAll(both.union(both).union(both)).count() == 0
    assert mixed(both, labels.limit(0), {"clean": 1}).count() == both.count()
    assert mixed(both.limit(0), labels, {"clean": 1}).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    mixed(docs, labels, {"clean": 1, "toxic": 1}).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan

import zlib

import numpy as np
import pyarrow as pa

from .tests_data import SF01, SF001
from webloom.llm.quality import FEATURES, accepted, bradley_terry, features, scored


def test_features():
    x = dict(zip(FEATURES, features(pa.array(["The The  cat!\n| 1,"]))[0]))
    assert np.isclose(x["words"], np.log1p(5)) and np.isclose(x["same_as_before"], np.sqrt(1 / 5))
    assert np.isclose(x["distinct"], np.sqrt(4 / 5)) and np.isclose(x["upper"], np.sqrt(2 / 5))
    none = features(pa.array([None, "", " \n"], pa.string()))
    assert np.isfinite(none).all() and (none[0] == none[1]).all()
    assert features(pa.array([], pa.string())).shape == (0, len(FEATURES))


def test_bradley_terry_orders_pairs():
    r = np.random.default_rng(0)
    good, bad = r.normal(0.5, 1, (400, 3)), r.normal(-0.5, 1, (100, 3))
    w = bradley_terry(good, bad)
    wins = (good @ w)[:, None] > (bad @ w)[None, :]
    assert wins.mean() > 0.85
    # the gradient vanishes: a maximum of the penalised likelihood
    assert (w > 0).all()


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    rows = {r.doc_id: r for r in scored(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    hits = []
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if r.held_out and d in truth:
            hits.append(r.predicted == truth[d])
    assert np.mean(hits) >= 0.97


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "again a"), (7, "w " * 30000)], "doc_id long, text string")
    labels = spark.read.parquet(f"{SF001}/labels.parquet").unionByName(
        spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int"))
    both = docs.unionByName(odd).selectExpr("*", "1 AS x", "2 AS score", "3 AS held_out")
    assert scored(both, labels).where("score IS NULL OR held_out IS NULL").count() == 0
    kept = accepted(both, labels)
    assert kept.columns == both.columns and 0 < kept.count() < both.count()
    none = labels.limit(0)
    assert accepted(both, none).count() == both.count()
    assert scored(both.limit(0), labels).count() == 0

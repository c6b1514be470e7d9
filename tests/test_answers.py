import datetime as dt

from pyspark.sql import functions as F

from webloom.operators import answers as A
from webloom.operators import freshness as FR


def _store(spark, rows):
    return spark.createDataFrame(rows, "answer_id long, question string, answer string, ts timestamp, "
                                       "feedback_count long, feedback_sum double")


T0 = dt.datetime(2024, 1, 1)


def test_cache_lookup_exact_and_first(spark):
    store = _store(spark, [(1, "q", "early", T0, 0, 0.0), (2, "q", "late", T0 + dt.timedelta(1), 0, 0.0)])
    qs = spark.createDataFrame([("q",), ("Q",), ("q ",)], "question string")
    got = {r.question: r.answer for r in A.cache_lookup(qs, store).collect()}
    assert got == {"q": "early", "Q": None, "q ": None}


def test_feedback_updates_first_answer_only(spark):
    store = _store(spark, [(1, "q", "a", T0, 1, 4.0), (2, "q", "b", T0 + dt.timedelta(1), 0, 0.0),
                           (3, "other", "c", T0, 0, 0.0)])
    fb = spark.createDataFrame([("q", 5.0), ("nobody", 3.0)], "question string, rating double")
    got = {r.answer_id: (r.feedback_count, r.feedback_sum, r.average_feedback)
           for r in A.apply_feedback(store, fb).collect()}
    assert got == {1: (2, 9.0, 4.5), 2: (0, 0.0, 0.0), 3: (0, 0.0, 0.0)}


def test_feedback_confidence(spark):
    store = _store(spark, [(1, "q", "first", T0, 0, 0.0), (2, "q", "second", T0 + dt.timedelta(1), 2, 9.0),
                           (3, "none", "x", T0, 0, 0.0)])
    store = A.apply_feedback(store, spark.createDataFrame([], "question string, rating double"))
    got = {r.question: (r.answer, r.confidence) for r in A.feedback_confidence(store).collect()}
    assert got == {"q": ("second", 4.5), "none": (None, 0.0)}


def test_answer_rows_defaults(spark):
    res = spark.createDataFrame([("q", "a", ["s"])], "question string, answer string, sources array<string>")
    r = A.answer_rows(res, ts="2024-01-01 00:00:00", confidence=0.3).first()
    assert (r.confidence, r.feedback_count, r.feedback_sum, r.average_feedback) == (0.3, 0, 0.0, 0.0)
    assert r.sources == ["s"] and r.answer_id is not None


def test_freshness_boundaries(spark):
    now = dt.datetime(2024, 2, 1)
    rows = [("fresh", now - dt.timedelta(days=30, hours=23, minutes=59, seconds=59)),
            ("stale", now - dt.timedelta(days=31)),
            ("null", None),
            ("future", now + dt.timedelta(days=3))]
    listing = spark.createDataFrame(rows, "host string, ts timestamp")
    got = {r.host: r.fresh for r in FR.fresh_hosts(listing, now, 30).collect()}
    assert got == {"fresh": True, "stale": False, "future": True}


def test_split_partitions_input(spark):
    now = dt.datetime(2024, 2, 1)
    listing = spark.createDataFrame([("a", now), ("b", now - dt.timedelta(days=90))], "host string, ts timestamp")
    urls = spark.createDataFrame([("http://a/1", "a"), ("http://b/1", "b"), ("http://c/1", "c"),
                                  ("x", None)], "url string, host string")
    fresh, stale = FR.split_urls(urls, listing, now, 30)
    assert sorted(r.url for r in fresh.collect()) == ["http://a/1"]
    assert sorted(r.url for r in stale.collect()) == ["http://b/1", "http://c/1", "x"]
    plan = fresh._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_pushed_filter_on_scan(spark, tmp_path):
    p = str(tmp_path / "listing")
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1))], "host string, ts timestamp").write.parquet(p)
    fresh = FR.fresh_host_set(spark.read.parquet(p), dt.datetime(2024, 2, 1), 30)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in plan

"""Figures of the survey's probes, derived again by SQL of their own over sf0.01."""
import duckdb
import pytest

import __spark_entry__ as E

from conftest import SF01


@pytest.fixture(scope="module")
def rows():
    con = duckdb.connect()
    for t in ("events", "lineitem", "embeddings", "conversations", "benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return lambda sql: con.execute(sql).fetchall()


def fresh_counts(spark):
    return {(r.fresh, r["count"]) for r in E.queries()["fresh_hosts"](spark, SF01).groupBy("fresh").count().collect()}


#: Whole days between the clock and a host's latest event; five or fewer are fresh.
FRESH = """SELECT floor(epoch(TIMESTAMP '2024-02-05' - last) / 86400) <= 5 AS fresh, count(*)
           FROM (SELECT user_id, max(ts) AS last FROM events WHERE ts IS NOT NULL GROUP BY user_id) GROUP BY 1"""


def test_freshness_split_counts(spark, rows):
    got = fresh_counts(spark)
    assert got == set(rows(FRESH)) and len(got) == 2


def test_frontier_sizes_by_depth(spark, rows):
    got = {(r.depth, r["count"]) for r in E.queries()["reach_depth"](spark, SF01).groupBy("depth").count().collect()}
    want = rows("""
        WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL),
        r(kind, k, depth) AS (
          SELECT 's', 1::BIGINT, 0 UNION
          SELECT CASE kind WHEN 's' THEN 'p' ELSE 's' END, CASE kind WHEN 's' THEN e.p ELSE e.s END, depth + 1
          FROM r JOIN e ON (kind = 's' AND e.s = k) OR (kind = 'p' AND e.p = k) WHERE depth < 3)
        SELECT depth, count(*) FROM (SELECT kind, k, min(depth) AS depth FROM r GROUP BY 1, 2) GROUP BY 1""")
    assert got == set(want) and len(got) == 4


def test_neighbourhood_sizes_at_0_3(spark, rows):
    got = {(r.i, r.n) for r in E.queries()["neighbour_counts"](spark, SF01).collect()}
    want = rows("""SELECT x.vec_id, count(*) FROM embeddings x, embeddings y WHERE x.vec_id % 100 = 0
                   AND list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.3 GROUP BY 1""")
    assert got == set(want) and max(n for _, n in got) > 1


def test_question_answer_pairs_and_hits(spark, rows):
    q = E.queries()
    pairs = rows("""SELECT count(DISTINCT u.text) FROM conversations u JOIN conversations a
                    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")[0][0]
    assert q["first_answer"](spark, SF01).count() == pairs
    assert q["lexical_top4"](spark, SF01).count() == 4 * rows("SELECT count(*) FROM benchmark")[0][0]


def test_freshness_does_not_depend_on_session_time_zone(spark, rows):
    key = "spark.sql.session.timeZone"
    old = spark.conf.get(key)
    spark.conf.set(key, "America/New_York")
    try:
        assert fresh_counts(spark) == set(rows(FRESH))
    finally:
        spark.conf.set(key, old)

from collections import Counter

import numpy as np
import pytest

from webloom.llm import shards
from webloom.llm.shards import CommunicationMatrix, exact_sizes, hypergeometric, shuffle


def test_matrix_margins():
    r = np.random.default_rng(0)
    for p, c in ((1, 1), (7, 3), (33, 40), (5, 1)):
        blocks = r.integers(0, 50, p)
        sizes = exact_sizes(int(blocks.sum()), c)
        m = CommunicationMatrix(blocks, sizes, 3)
        rows = np.array([m.row(i) for i in range(p)])
        assert (rows.sum(1) == blocks).all() and (rows.sum(0) == sizes).all() and (rows >= 0).all()
        assert all((np.bincount(m.deal(i), minlength=c) == rows[i]).all() for i in range(p))


def test_cells_are_hypergeometric():
    seen = np.array([CommunicationMatrix(np.array([6, 10]), np.array([8, 8]), s).row(0)[0] for s in range(4000)])
    r = np.random.default_rng(1)
    want = r.hypergeometric(8, 8, 6, 4000)
    for k in range(7):
        assert abs((seen == k).mean() - (want == k).mean()) < 0.04


def test_large_draws(monkeypatch):
    r = np.random.default_rng(2)
    big = np.array([hypergeometric(r, 3 * 10 ** 9, 10 ** 9, 10 ** 6) for _ in range(50)])
    assert abs(big.mean() - 750_000) < 500
    monkeypatch.setattr(shards, "_LIMIT", 10)      # the same law below, too
    small = np.array([hypergeometric(r, 30, 20, 10) for _ in range(4000)])
    assert abs(small.mean() - 6) < 0.1 and abs(small.var() - 10 * .6 * .4 * 40 / 49) < 0.15
    assert hypergeometric(r, 30, 0, 10) == 10 and hypergeometric(r, 0, 30, 10) == 0


@pytest.mark.parametrize("part_rows", [1 << 20, 9])
def test_shards(spark, part_rows):
    rows = [(i % 300 if i % 50 else None, ["", None, "x" * (i % 7)][i % 3], 5, 1) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_at int, row_at_ int").repartition(5)
    out = shuffle(df, shards=8, block_rows=40, part_rows=part_rows)
    got = out.collect()
    assert out.columns == [*df.columns, "shard", "slot"]
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))


def test_few_rows(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [(r.doc_id, r.shard, r.slot) for r in shuffle(df, shards=40).collect()] == [(1, 0, 0)]
    assert shuffle(df.limit(0), shards=40).collect() == []


def test_every_order_is_as_likely(spark):
    df = spark.range(24).coalesce(1)
    first = Counter()
    for seed in range(20):
        for r in shuffle(df, shards=3, seed=seed, block_rows=5).where("slot = 0").collect():
            first[r.id] += 1
    assert sum(first.values()) == 60 and max(first.values()) < 12


def test_parts_change_neither_the_draws_nor_the_plan(spark, monkeypatch):
    df = spark.range(3000).repartition(3)
    drawn = []
    kept = CommunicationMatrix.__init__
    monkeypatch.setattr(CommunicationMatrix, "__init__", lambda self, b, columns, seed: (drawn.append(len(columns)), kept(self, b, columns, seed))[1])
    plans = [shuffle(df, shards=4, block_rows=100, part_rows=n)._jdf.queryExecution().optimizedPlan().toString() for n in (100, 2)]
    assert drawn == [4, 4]
    assert abs(len(plans[0]) - len(plans[1])) < 200


def test_parts_of_any_number_hold_the_same_shards(spark):
    rows = [(i, "x" * (i % 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    one, many = (shuffle(df, shards=5, block_rows=64, part_rows=n).collect() for n in (1 << 20, 3))
    assert {(r.doc_id, r.shard) for r in one} == {(r.doc_id, r.shard) for r in many}
    for s in range(5):
        assert sorted(r.slot for r in many if r.shard == s) == list(range(400))


def test_slots_do_not_follow_the_input_order(spark):
    got = shuffle(spark.range(4000).coalesce(1), shards=2, block_rows=64, part_rows=50).collect()
    for s in range(2):
        ids = [r.id for r in sorted((r for r in got if r.shard == s), key=lambda r: r.slot)]
        assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.08


def test_columns_of_the_added_names_are_replaced(spark):
    df = spark.createDataFrame([(i, "old", -1, 5) for i in range(20)], "doc_id long, Shard string, slot int, row_part int")
    out = shuffle(df, shards=4)
    assert out.columns == ["doc_id", "row_part", "shard", "slot"]
    assert {(r.shard, r.slot) for r in out.collect()} == {(s, i) for s in range(4) for i in range(5)}


def test_sizes_and_digests_of_the_query(spark):
    import duckdb
    import zlib
    import __spark_entry__ as E
    d = "/root/testdata/sf0.001"
    want = duckdb.sql(f"SELECT doc_id, strlen(coalesce(text, '')) + 16, coalesce(text, '') FROM '{d}/documents.parquet'").fetchall()
    got = E.queries()["op7_sharding"](spark, d).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, n, zlib.crc32(t.encode())) for i, n, t in want)

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions.splitter import split_text
from webloom.operators import chunks as CH
from webloom.operators.pages import seed_batches


def test_splitter_golden():
    t = "a" * 2500
    assert [(t.find(c), len(c)) for c in split_text(t)] == [(0, 1000), (0, 1000), (0, 900)]
    assert split_text("  short text  ") == ["short text"]
    assert split_text("   \n  ") == []
    assert split_text("") == [] and split_text(None) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "x", "longerword", " ", "\n", "\n\n", "é"]), max_size=800))
def test_splitter_properties(parts):
    text = "".join(parts)
    chunks = split_text(text)
    assert all(0 < len(c) <= 1000 for c in chunks)
    assert all(c in text for c in chunks)
    if len(text.strip()) <= 1000:
        assert chunks == ([text.strip()] if text.strip() else [])


def test_record_size_matches_json(spark):
    texts = ["", 'a"b\\c', "é", "line\nbreak\ttab", "\x01\x7f", "😀 x", "plain"]
    rows = [(f"http://h/{i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "url string, content string")
    got = [r[0] for r in df.select(CH.record_size(F.col("url"), F.col("content"), 0.5)).collect()]
    want = [len(json.dumps({"url": u, "content": c, "timestamp": 0.5})) for u, c in rows]
    assert got == want
    empty = spark.createDataFrame([("", "")], "url string, content string")
    assert empty.select(CH.record_size(F.col("url"), F.col("content"), 0.5)).first()[0] == 44


def test_chunk_assign_cases():
    assert CH.chunk_assign_reference([400] * 8, 1000) == [0, 0, 0, 1, 1, 1, 2, 2]
    assert CH.chunk_assign_reference([1000, 1], 1000) == [0, 1]


def test_assign_chunks_spark_matches_fold(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for h in ["a", "b", "c"]:
        sizes = [rnd.randint(1, 300) for _ in range(rnd.randint(1, 120))]
        for o, s in enumerate(sizes):
            rows.append((h, o * 3 + 1, s))
        want[h] = CH.chunk_assign_reference(sizes, 700)
    df = spark.createDataFrame(rows, "host string, page_id long, record_size long")
    for width, fan in ((1, 2), (1, 3), (17, 2), (5, 64), (1_000_000, 64)):
        got = CH.assign_chunks(df, 700, block_width=width, fan_out=fan).orderBy("host", "ord").collect()
        for h in want:
            assert [r.chunk_no for r in got if r.host == h] == want[h], (width, fan)


def test_records_without_a_host_are_a_host_of_their_own(spark):
    rows = [(None if i % 3 else "a", i, 400) for i in range(12)]
    df = spark.createDataFrame(rows, "host string, page_id long, record_size long")
    for fan in (2, 64):
        got = CH.assign_chunks(df, 1000, block_width=2, fan_out=fan).orderBy("ord").collect()
        assert [r.chunk_no for r in got if r.host is None] == CH.chunk_assign_reference([400] * 8, 1000)
        assert [r.chunk_no for r in got if r.host == "a"] == CH.chunk_assign_reference([400] * 4, 1000)


def test_batches(spark):
    df = spark.createDataFrame([(i, f"u{i}") for i in range(5)], "page_id long, url string")
    assert [r.batch_id for r in seed_batches(df, 2).orderBy("page_id").collect()] == [0, 0, 1, 1, 2]
    assert seed_batches(df.limit(0), 2).count() == 0


def test_split_documents_job(spark):
    docs = spark.createDataFrame([(1, "a" * 2500, "s"), (2, "   ", "s"), (3, "hi", "t")],
                                 "doc_id long, text string, source string")
    got = CH.split_documents(docs).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, len(r.chunk)) for r in got] == [(1, 0, 1000), (1, 1, 1000), (1, 2, 900), (3, 0, 2)]


def test_split_count_is_observed(spark):
    from pyspark.sql import Observation
    docs = spark.createDataFrame([(1, "a" * 2500, "s"), (2, "hi", "t")],
                                 "doc_id long, text string, source string")
    obs = Observation("split_metrics")
    CH.split_documents(docs, observation=obs).write.format("noop").mode("overwrite").save()
    assert obs.get == {"splits": 4}


def test_small_buffers_share_a_call(spark):
    """Many buffers of one block go to Python in bins (F1: a call for each buffer)."""
    rows = [(None if h == 0 else f"h{h}", o, 300 + o % 3) for h in range(300) for o in range(7)]
    df = spark.createDataFrame(rows, "host string, page_id long, record_size long")
    assert CH._binned(df.withColumn("node", F.lit(0))).count().count() <= CH.BINS * 8
    got = {(r.host, r.ord): r.chunk_no for r in CH.assign_chunks(df, 700).collect()}
    want = CH.chunk_assign_reference([300 + o % 3 for o in range(7)], 700)
    assert len(got) == len(rows) and all(got[h, o] == want[o] for h, o, _ in rows)

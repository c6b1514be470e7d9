import os

import pytest
from pyspark.sql import functions as F

from webloom.sinks import chunkfiles as KF
from webloom.sinks import store as ST
from webloom.sources import chunkfiles as SF


def test_scan_skips_truncated_chunk(spark, tmp_path):
    d = tmp_path / "chunks" / "host=a.com"
    d.mkdir(parents=True)
    (d / "good.txt").write_text('[{"url": "u1", "content": "c1", "timestamp": 1.0}, '
                                '{"url": "u2", "content": "c2", "timestamp": 2.0}]\n')
    (d / "bad.txt").write_text('[{"url": "u3", "content": "c3", "timest\n')
    root = str(tmp_path / "chunks")
    rows = SF.scan_chunks(spark, root).orderBy("url").collect()
    assert [(r.host, r.url) for r in rows] == [("a.com", "u1"), ("a.com", "u2")]
    assert SF.chunk_rejects(spark, root).count() == 1


def test_write_read_roundtrip_and_pruning(spark, tmp_path):
    recs = spark.createDataFrame(
        [(1, "h1", "u1", "c1", 1.5, 0), (2, "h1", "u2", "c2", 1.5, 0), (3, "h1", "u3", "c3", 1.5, 1),
         (4, "h:8080", "u4", "é", 1.5, 0)],
        "page_id long, host string, url string, content string, timestamp double, chunk_no long")
    root = str(tmp_path / "out")
    KF.write_chunk_files(recs, root)
    back = SF.scan_chunks(spark, root)
    assert sorted((r.host, r.url, r.content) for r in back.collect()) == \
        [("h1", "u1", "c1"), ("h1", "u2", "c2"), ("h1", "u3", "c3"), ("h:8080", "u4", "é")]
    one = SF.scan_chunks(spark, root, hosts=["h1"])
    assert one.count() == 3
    assert "PartitionFilters: [isnotnull(host" in one._jdf.queryExecution().executedPlan().toString()


def test_legacy_loader_requires_rows(spark, tmp_path):
    import pytest
    os.makedirs(tmp_path / "empty" / "host=x")
    (tmp_path / "empty" / "host=x" / "f.txt").write_text("[]\n")
    with pytest.raises(ValueError):
        SF.require_rows(SF.legacy_content(spark, str(tmp_path / "empty")))


def test_index_append_is_idempotent(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "s", 0, "x"), (1, "s", 1, "y"), (2, "s", 0, "x")],
                                   "doc_id long, source string, chunk_index int, chunk string")
    p = str(tmp_path / "index")
    ST.append_index(chunks, p)
    n1 = spark.read.parquet(p).count()
    ST.append_index(chunks, p)
    # equal passages of two documents are two rows
    assert spark.read.parquet(p).count() == n1 == 3


def test_an_unreadable_index_is_an_error(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "s", 0, "x")], "doc_id long, source string, chunk_index int, chunk string")
    bad = tmp_path / "index"
    bad.mkdir()
    (bad / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        ST.append_index(chunks, str(bad))


def test_seed_lists_keep_positions(spark, tmp_path):
    from webloom.sources.seeds import read_seed_lists
    (tmp_path / "s.json").write_text('["https://a.com/", "https://b.com/x", "https://a.com/"]')
    rows = read_seed_lists(spark, str(tmp_path / "s.json")).orderBy("seq").collect()
    assert [(r.seq, r.url) for r in rows] == [(0, "https://a.com/"), (1, "https://b.com/x"), (2, "https://a.com/")]


def test_feed_sink(spark, tmp_path):
    from webloom.operators.pages import page_title_content
    from webloom.sinks.feed import write_feed
    pages = spark.createDataFrame([(1, "http://a/", "<title>T</title><p>x</p>")],
                                  "page_id long, url string, html string")
    write_feed(page_title_content(pages), str(tmp_path / "feed"))
    r = spark.read.json(str(tmp_path / "feed")).first()
    assert (r.url, r.title, r.content) == ("http://a/", "T", "x")


def test_json_arrays_on_several_lines(spark, tmp_path):
    d = tmp_path / "feeds"
    d.mkdir()
    (d / "a.json").write_text('[\n  {"url": "u1", "content": "x\\ny",\n   "timestamp": 1.5},\n  {"url": "u2"}\n]\n')
    (d / "b.json").write_text('[{"url": "u3", "content": "z", "timestamp": 2.0}]')
    (d / "c.json").write_text('[{"url": "u4", "content')
    rows = SF.load_json_arrays(spark, str(d)).collect()
    good = sorted((r.url, r.content, r.timestamp) for r in rows if r.reject is None)
    assert good == [("u1", "x\ny", 1.5), ("u2", None, None), ("u3", "z", 2.0)]
    assert [r.reject[:6] for r in rows if r.reject is not None] == ['[{"url']


def test_hosts_of_empty_name_and_without_one_stay_apart(spark, tmp_path):
    recs = spark.createDataFrame([(0, "", "u0", "a"), (1, None, "u1", "b"), (2, "h", "u2", "c")],
                                 "page_id long, host string, url string, content string")
    recs = recs.withColumns({"timestamp": F.lit(1.0), "chunk_no": F.lit(0)})
    path = str(tmp_path / "chunks")
    KF.write_chunk_files(recs, path)
    assert {(r.host, r.url) for r in SF.scan_chunks(spark, path).collect()} == {("", "u0"), (None, "u1"), ("h", "u2")}
    assert [r.url for r in SF.scan_chunks(spark, path, hosts=[""]).collect()] == ["u0"]


def test_files_hold_runs_of_chunks(spark, tmp_path):
    """A file holds many chunks, however many partitions a shuffle has (F14: a stream of many small files)."""
    from webloom.sinks import chunkfiles as KF
    n = 2 * KF.CHUNKS_A_FILE
    recs = spark.createDataFrame([("h", i, i, f"u{i}", "x", 1.0) for i in range(n)],
                                 "host string, chunk_no long, page_id long, url string, content string, timestamp double")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        KF.write_chunk_files(recs, str(tmp_path / "c"))
    finally:
        spark.conf.set(key, old)
    files = list((tmp_path / "c").rglob("*.txt"))
    assert len(files) <= 2 and sum(len(f.read_text().splitlines()) for f in files) == n

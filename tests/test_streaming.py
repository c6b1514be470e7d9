"""Streams must equal their batch counterparts (availableNow triggers)."""
import __spark_entry__ as E

from conftest import SF001


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_chunk_assign_equals_batch(spark):
    q = E.queries()
    a = q["stream_chunk_assign"](spark, SF001)
    b = q["chunk_assign"](spark, SF001).select("host", "page_id", "chunk_no")
    assert a.count() > 0 and _same(a.select("host", "page_id", "chunk_no"), b)


def test_stream_feedback_equals_batch(spark):
    q = E.queries()
    assert _same(q["stream_feedback"](spark, SF001), q["feedback_stats"](spark, SF001))


def test_stream_ingest_equals_batch_index(spark):
    q = E.queries()
    cols = ["source", "chunk_index", "chunk"]
    # a chunk file names a record's URL, not the document's id: equal records are one document there
    a = q["stream_ingest"](spark, SF001).select(*cols).distinct()
    b = q["index_idempotent"](spark, SF001).select(*cols).distinct()
    assert a.count() > 0 and _same(a, b)


def test_stream_ingest_keeps_every_document(spark):
    q = E.queries()
    cols = ["doc_id", "source", "chunk_index", "chunk"]
    a = q["stream_ingest"](spark, SF001).select(*cols)
    b = q["index_idempotent"](spark, SF001).select(*cols)
    assert a.count() > 0 and _same(a, b)


def test_stream_ingest_copies_of_one_source(spark, tmp_path):
    from webloom.sinks.chunkfiles import write_chunk_files
    from webloom.streaming.ingest import ingest_chunk_files
    recs = spark.createDataFrame([(1, "h", "u", "same", 1.0, 0), (2, "h", "u", "same", 1.0, 0), (3, "h", "u", "other", 1.0, 1)],
                                 "page_id long, host string, url string, content string, timestamp double, chunk_no long")
    for doc, want in (("page_id", 3), (None, 2)):
        src, index = str(tmp_path / f"chunks-{doc}"), str(tmp_path / f"index-{doc}")
        write_chunk_files(recs, src, doc=doc)
        ingest_chunk_files(spark, src, index, str(tmp_path / f"ckpt-{doc}")).awaitTermination()
        rows = spark.read.parquet(index)
        assert rows.count() == want
        if doc:
            assert sorted(r.doc_id for r in rows.collect()) == [1, 2, 3]


def test_stream_dedup_drops_repeats(spark, tmp_path):
    from pyspark.sql import functions as F
    from webloom.streaming.dedup import distinct_pages_stream
    src = str(tmp_path / "pages")
    spark.createDataFrame([(1, "http://a/x#top"), (2, "http://a/x"), (3, "http://a/y")],
                          "page_id long, url string").write.parquet(src)
    stream = (spark.readStream.schema("page_id long, url string").parquet(src)
              .withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp")))
    out = str(tmp_path / "out")
    q = (distinct_pages_stream(stream).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.url_key for r in spark.read.parquet(out).collect()) == ["http://a/x", "http://a/y"]


def test_streams_read_a_table_of_part_files(spark, tmp_path):
    """A table may be one file or a folder of part files (F2: a folder gave no file, then an error)."""
    pages = [(i, f"http://h{i % 3}.example.com/{i // 2}#{i}", "<p>x</p>") for i in range(12)]
    events = [(i % 4, 0.5 * i) for i in range(12)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(events, "user_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    q = E.queries()
    got = [r.url_key for r in q["stream_distinct_pages"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted({u.split("#")[0] for _, u, _ in pages})
    assert _same(q["stream_feedback"](spark, str(tmp_path)), q["feedback_stats"](spark, str(tmp_path)))


def test_stream_of_pages_without_rows(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert E.queries()["stream_distinct_pages"](spark, str(tmp_path)).count() == 0

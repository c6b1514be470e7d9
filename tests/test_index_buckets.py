"""The passage index by hash buckets: what an append reads, replays, compaction."""
from webloom.sinks import store as ST

DDL = "doc_id long, source string, chunk_index int, chunk string"


def _chunks(spark, docs):
    return spark.createDataFrame([(d, f"s{d}", i, f"text {d} {i}") for d in docs for i in range(2)], DDL)


def _rows(spark, path):
    return sorted((r.doc_id, r.source, r.chunk_index, r.chunk) for r in ST.read_index(spark, path).collect())


def test_an_append_reads_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "index")
    ST.append_index(_chunks(spark, range(200)), path)
    few = _chunks(spark, [3, 500])
    touched = sorted(r.b for r in few.select(ST.bucket_of().alias("b")).distinct().collect())
    plan = ST.missing_from_index(few, path)._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in plan.splitlines() if "PartitionFilters" in ln]
    assert scans and all(f"IN ({', '.join(map(str, touched))})" in ln or
                         f"IN ({','.join(map(str, touched))})" in ln for ln in scans), scans
    ST.append_index(few, path)
    assert len(_rows(spark, path)) == 402


def test_repeats_nulls_and_empty_appends(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(None, "s", 0, "x"), (1, None, 0, None), (1, None, 0, None), (2, "s", 0, "")], DDL)
    ST.append_index(rows, path)
    ST.append_index(rows, path)
    ST.append_index(rows.limit(0), path)
    assert ST.read_index(spark, path).count() == 3


def test_compaction_keeps_the_rows_in_fewer_files(spark, tmp_path):
    path = str(tmp_path / "index")
    for batch in range(5):
        ST.append_index(_chunks(spark, range(batch * 40, batch * 40 + 40)), path, buckets=4)
    before, files = _rows(spark, path), len(list((tmp_path / "index").rglob("*.parquet")))
    assert ST.compact_index(spark, path, max_files=3) == [0, 1, 2, 3]
    assert _rows(spark, path) == before and len(before) == 400
    assert len(list((tmp_path / "index").rglob("*.parquet"))) == 4 < files
    assert ST.compact_index(spark, path, max_files=3) == []
    ST.append_index(_chunks(spark, range(200)), path, buckets=4)      # still known
    assert _rows(spark, path) == before


def test_one_bucket_is_read_alone(spark, tmp_path):
    path = str(tmp_path / "index")
    chunks = _chunks(spark, range(50))
    ST.append_index(chunks, path, buckets=4)
    got = ST.read_index(spark, path, [1])
    assert got.count() == chunks.where(ST.bucket_of(4) == 1).count() > 0
    assert ST.BUCKET not in got.columns

"""Running feedback as a log of changes: several batches, replayed epochs, compaction."""
from webloom.operators.answers import feedback_stats
from webloom.streaming import feedback as FB

DDL = "question string, rating double"
BATCHES = [[("a", 1.0), ("b", 0.5), ("a", 0.0)], [("a", 0.25), (None, 1.0)], [("c", 1.0), ("b", 0.1)], [("a", 0.7)]]


def _stream(spark, src, out, ckpt):
    ratings = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(src)
    FB.write_changes(FB.running_feedback(ratings), out, ckpt).awaitTermination()


def _run(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    for rows in BATCHES:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(src)
        _stream(spark, src, out, ckpt)
    return src, out


def _same(a, b):
    key = lambda r: repr(tuple(r[c] for c in sorted(r.asDict())))
    return sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_log_equals_the_batch_statistics(spark, tmp_path):
    src, out = _run(spark, tmp_path)
    want = feedback_stats(spark.read.parquet(src))
    assert _same(FB.latest_feedback(spark, out), want)
    # an epoch holds its changed keys only
    changed = spark.read.parquet(f"{out}/epoch=3").collect()
    assert [r.question for r in changed] == ["a"]


def test_a_replayed_epoch_and_compaction_change_nothing(spark, tmp_path):
    src, out = _run(spark, tmp_path)
    want = feedback_stats(spark.read.parquet(src))
    last = spark.createDataFrame(spark.read.parquet(f"{out}/epoch=3").collect())
    FB.write_epoch(last, 3, out)
    assert _same(FB.latest_feedback(spark, out), want)
    assert FB.compact_feedback(spark, out) == 2
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["epoch=2", "epoch=3"]
    assert _same(FB.latest_feedback(spark, out), want)
    FB.write_epoch(last, 3, out)        # the last epoch may still come again
    assert _same(FB.latest_feedback(spark, out), want)
    assert FB.compact_feedback(spark, out) is None

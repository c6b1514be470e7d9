"""Flush state under out-of-order arrival equals the sequential fold."""
import datetime as dt
import random

from webloom.streaming.chunk_state import assign_chunks_late

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
DDL = "host string, ord long, size long, ts timestamp"


def _fold(rows, limit):
    fill, chunk, out = {}, {}, {}
    for host, o, size, _ts in sorted(rows, key=lambda r: (r[3], r[1])):
        out[host, o] = chunk.setdefault(host, 0)
        fill[host] = fill.get(host, 0) + size
        if fill[host] >= limit:
            fill[host], chunk[host] = 0, chunk[host] + 1
    return out


def test_shuffled_arrival_gives_the_batch_numbers(spark, tmp_path):
    rnd = random.Random(2)
    # a hot host, ties in time, and arrival within 30 minutes of the right place
    rows = [("hot" if i % 3 else f"h{i % 4}", i, rnd.randrange(1, 40), T0 + dt.timedelta(minutes=i // 2)) for i in range(120)]
    late = sorted(rows, key=lambda r: r[1] + rnd.randrange(0, 50))
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    closing = [("end", 10 ** 6, 1, T0 + dt.timedelta(days=2))]
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        for batch in (late[:40], late[40:80], late[80:], closing):
            spark.createDataFrame(batch, DDL).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(DDL).parquet(src)
            q = (assign_chunks_late(stream, 100).writeStream.outputMode("append").format("parquet").option("path", out)
                 .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
            q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    got = [(r.host, r.ord, r.chunk_no) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(rows)
    assert {(h, o): c for h, o, c in got} == _fold(rows, 100)

"""Freshness from the metadata of written chunk files."""
import datetime as dt
import os

from webloom.operators import freshness as FR
from webloom.sinks import chunkfiles as KF
from webloom.sources.listing import file_listing

NOW = dt.datetime(2024, 2, 5, tzinfo=dt.timezone.utc)


def _written(spark, tmp_path, hosts):
    path = str(tmp_path / "chunks")
    rows = [(i, h, f"http://{h}/", "text", 1.0, 0) for i, h in enumerate(hosts)]
    KF.write_chunk_files(spark.createDataFrame(
        rows, "page_id long, host string, url string, content string, timestamp double, chunk_no long"), path)
    return path


def _touch(tmp_path, folder, days):
    at = (NOW - dt.timedelta(days=days)).timestamp()
    for f in (tmp_path / "chunks" / folder).glob("part-*"):
        os.utime(f, (at, at))


def test_hosts_times_and_sizes(spark, tmp_path):
    hosts = ["a.com", "b.com:8080", "c+d.com", "", "007"]
    rows = file_listing(spark, _written(spark, tmp_path, hosts)).collect()
    assert sorted(r.host for r in rows) == sorted(hosts)
    assert all(r.bytes > 0 and r.ts is not None for r in rows)


def test_split_by_file_times(spark, tmp_path):
    path = _written(spark, tmp_path, ["new.com", "old.com", "edge.com"])
    _touch(tmp_path, "host=new.com", 2)
    _touch(tmp_path, "host=old.com", 40)
    _touch(tmp_path, "host=edge.com", 11)        # exactly max_age + 1 days: no longer fresh
    urls = spark.createDataFrame([("u1", "new.com"), ("u2", "old.com"), ("u3", "never.com"), ("u4", "edge.com")], "url string, host string")
    fresh, stale = FR.split_urls(urls, file_listing(spark, path), NOW, 10)
    assert [r.url for r in fresh.collect()] == ["u1"]
    assert sorted(r.url for r in stale.collect()) == ["u2", "u3", "u4"]


def test_no_content_is_read_and_no_files_give_no_rows(spark, tmp_path):
    listing = file_listing(spark, _written(spark, tmp_path, ["a.com"]))
    scan = [ln for ln in listing._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in ln]
    assert scan and "content" not in scan[0].split("ReadSchema")[1]
    (tmp_path / "none").mkdir()
    assert file_listing(spark, str(tmp_path / "none")).count() == 0

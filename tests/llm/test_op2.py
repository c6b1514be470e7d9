import datetime as dt
import random

from pyspark.sql import functions as F

from webloom.llm.revisits import KEEP_STORED, canonical_url, captures, resolve

from .tests_data import SF001

SCHEMA = "record_id long, url string, ts timestamp, kind string, headers map<string,string>, payload string, key int, pid int"


def test_canonical_url(spark):
    cases = {"HTTPS://www.Ex.com:443/a/?utm_source=x&b=2&a=1#f": "ex.com/a?a=1&b=2", "http://u:p@m.ex.com/": "ex.com",
             "ex.com?ref=1": "ex.com", "http://ex.com/A//": "ex.com/A", "": "", "http://ex.com/?b&a=&": "ex.com?a=&b",
             "http://ex.com/?reference=1": "ex.com?reference=1"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "url string")
    got = {r.url: r.c for r in df.select("url", canonical_url(F.col("url")).alias("c")).collect()}
    assert got == {**cases, None: None}


def brute(rows):
    out = []
    key = lambda u: u.split("#")[0]
    low = lambda h: {k.lower(): v for k, v in sorted((h or {}).items(), key=lambda x: (x[0].lower(), x[1] or ""))}
    for rid, url, ts, kind, head, _ in rows:
        if kind != "revisit":
            continue
        new = low(head)
        before = [r for r in rows if r[3] == "response" and url is not None and r[1] is not None and ts is not None
                  and r[2] is not None and key(r[1]) == key(url) and (r[2], r[0]) < (ts, rid)]
        if not before:
            out.append((rid, "no_earlier_response", None, None, None))
            continue
        full = max(before, key=lambda r: (r[2], r[0]))
        old = low(full[4])
        weak = lambda x: x[2:] if x.startswith("W/") else x
        status = "no_validator"
        for name, f in (("etag", weak), ("last-modified", str)):
            if name in new and name in old:
                status = "resolved" if f(new[name]) == f(old[name]) else "validator_mismatch"
                break
        if status == "resolved":
            out.append((rid, status, full[0], {**old, **{k: v for k, v in new.items() if k not in KEEP_STORED}}, full[5]))
        else:
            out.append((rid, status, None, None, None))
    return sorted(out, key=lambda r: (r[0], str(r)))


def corpus():
    r = random.Random(8)
    rows = []
    for i in range(400):
        url = r.choice(["x.com/hot"] * 6 + [f"x.com/{r.randint(0, 60)}", None if i % 40 == 0 else "y.com"]) or None
        head = {}
        if r.random() < 0.7:
            head[r.choice(["ETag", "etag"])] = r.choice(["W/", ""]) + r.choice(["1", "2"])
        if r.random() < 0.7:
            head["Last-Modified"] = r.choice(["mon", "tue"])
        head[r.choice(["Date", "Content-Length", "X-A"])] = str(i)
        ts = None if i % 57 == 0 else dt.datetime(2020, 1, 1) + dt.timedelta(minutes=r.randint(0, 90))
        rows.append((i, url and url + r.choice(["", "#a"]), ts, r.choice(["revisit", "revisit", "response", "request"]),
                     None if i % 31 == 0 else head, f"p{i}"))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    rows += [rows[9], rows[10]]       # repeated records
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    for n in (1, 7):
        got = sorted(((r.record_id, r.status, r.response_id, r.headers, r.payload) for r in resolve(df, n).collect()),
                     key=lambda r: (r[0], str(r)))
        assert got == brute(rows)
    assert {r[1] for r in brute(rows)} == {"resolved", "validator_mismatch", "no_validator", "no_earlier_response"}


def test_empty_table(spark):
    assert resolve(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_status_occurs_in_the_query(spark):
    rows = resolve(captures(spark.read.parquet(f"{SF001}/pages.parquet"))).groupBy("status").count().collect()
    assert {r.status for r in rows} >= {"resolved", "validator_mismatch", "no_validator", "no_earlier_response"}

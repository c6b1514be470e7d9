import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import importance as I
from webloom.llm import words as W

from .tests_data import SF001


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, min_words=20, percent=5):
    """(doc_id, n_features, weight, score, rank) by the definition."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    each = [(d, *features(t)) for d, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in each for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for d, n, fs in each:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], -1 << 63 if r[0] is None else r[0]))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_checksums_of_joined_words():
    r = random.Random(3)
    texts = ["", "One", "one two", "a" * 70 + " b " + "é" * 500 + " " + "c" * 63 + " " + "d" * 64 + " " + "e" * 65,
             " ".join("".join(r.choices("abcé😀Z09", k=r.randint(1, 90))) for _ in range(300)), "x-y_z, 10%"]
    raw = [t.encode() for t in texts]
    w = W.segment(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), W.LETTERS)
    found = Counter()
    for at, bucket in I.feature_buckets(w):
        found.update(zip(w.doc_of(at).tolist(), bucket.tolist()))
    assert found == Counter((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in features(t)[1])


def test_odd_rows_by_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma9", "é", "wörd", "日本語", "x" * 80, "and", "and", "and"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(300)]
    rows += [(7, rows[7][1])] * 5 + [(None, " ".join(["and"] * 30)), (None, None), (1001, ""), (1002, None), (1003, "--- !!! \x00 \t")]
    target = ["alpha Beta alpha beta gamma9", None, "", "wörd " * 10]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, score int, rank int")
    items = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(I.resample(docs, items)) == brute(rows, target)
    assert got(I.resample(docs, items, percent=50)) == brute(rows, target, percent=50)
    assert got(I.resample(docs, items.limit(0), percent=100)) == brute(rows, [], percent=100)
    assert got(I.resample(docs.limit(0), items)) == []


def test_rows_that_repeat_an_id_are_drawn_one_by_one(spark):
    rows = [(i // 30, " ".join(["same", "words"] * 12)) for i in range(300)]       # ten ids, thirty equal rows each
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([("same words",)], "text string")
    for percent in (5, 17, 33, 50, 99, 100):
        out = I.resample(docs, items, percent=percent)
        assert got(out) == brute(rows, ["same words"], percent=percent)


@pytest.mark.parametrize("need", [1, 2, 37, 100, 499, 500])
def test_bisection_counts_exactly(spark, need):
    r = random.Random(need)
    values = [r.choice([-10 ** 12, -3, 0, 0, 0, 5, 10 ** 15]) + r.randint(0, 3) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    v, below = I.least_reaching(rows, F.col("v"), need)
    assert v == sorted(values)[need - 1] and below == sum(x < v for x in values)


def test_query_by_brute_force(spark):
    import __spark_entry__ as E
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    assert got(E.queries()["op13_importance_resampling"](spark, SF001)) == brute(docs, items)

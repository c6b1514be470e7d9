import os
import re
import sys
import zlib
from collections import Counter

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P  # noqa: E402
from webloom.llm import mixing, quality  # noqa: E402
from webloom.llm.jaccard import one_of_each  # noqa: E402
from webloom.llm.tokens import default_tokenizer  # noqa: E402

from .test_op1 import plain_sw, tokens  # noqa: E402
from .tests_data import SF001  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    items = spark.read.parquet(f"{SF001}/benchmark.parquet").collect()
    names = dict(P.STAGES)
    assert list(names) == [n for n, _ in P.STAGES] and len(P.STAGES) == 5
    rows = docs.collect()

    one = names["quality classifier"](spark, docs, SF001)
    assert one.columns == COLUMNS
    good = {r.doc_id for r in quality.scored(docs, labels).collect() if r.predicted}
    first = one.collect()
    assert sorted(r.doc_id for r in first) == sorted(good)
    clean = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert len(clean - good) <= 0.03 * len(clean)

    two = names["n-gram Jaccard join"](spark, spark.createDataFrame(first, docs.schema), SF001)
    second, sets = two.collect(), [shingles(r.text) for r in first]
    root = list(range(len(first)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(first)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    want = {min(first[j].doc_id for j in range(len(first)) if find(j) == find(i)) for i in range(len(first))}
    assert two.columns == COLUMNS and sorted(r.doc_id for r in second) == sorted(want)

    three = names["benchmark decontamination"](spark, spark.createDataFrame(second, docs.schema), SF001)
    third = three.collect()
    item_words = [a for a in (tokens(i.text) for i in items) if len(a) >= 8]
    leaky = {r.doc_id for r in second for a in item_words if plain_sw(a, tokens(r.text))[0] >= 0.5 * 2 * len(a)}
    assert three.columns == COLUMNS and {r.doc_id for r in third} == {r.doc_id for r in second} - leaky

    four = names["mixing to target weights"](spark, spark.createDataFrame(third, docs.schema), SF001)
    fourth = four.collect()
    assert four.columns == COLUMNS
    rate = {r.doc_id: r.rate for r in mixing.rates(spark.createDataFrame(third, docs.schema), labels, P.TARGET).collect()}
    for d, n in Counter(r.doc_id for r in fourth).items():
        assert n in (int(rate[d]), int(rate[d]) + 1)
    assert {d for d, r in rate.items() if r >= 1} <= {r.doc_id for r in fourth}

    from tokenizers import Tokenizer
    t = Tokenizer.from_file(default_tokenizer())
    five = names["token output"](spark, spark.createDataFrame(fourth, docs.schema), SF001).collect()
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [2] for r in fourth}
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in five) == sorted(
        (r.doc_id, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes())) for r in fourth)
    assert len(rows) >= len(first) >= len(second) >= len(third)

    whole = P.run(spark, SF001).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, five))


def test_one_of_each_with_odd_rows(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (None, "a b c d e f g h"),
            (5, None), (6, ""), (None, "only here it is once"), (None, "only here it is once"), (1, "something else is here now")]
    df = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, code int, node string")
    out = one_of_each(df, n=5, num=80, buckets=1 << 14, bits=1 << 14)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, "a b c d e f g h"), (5, None), (6, ""), (None, "only here it is once"), (1, "something else is here now")], key=str)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _name, stage in P.STAGES:
        out = stage(spark, docs, SF001)
        assert out.collect() == []
        docs = out if out.columns == COLUMNS else docs

"""A host list for each question, and dense retrieval within each host."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom import constants as C
from webloom.operators import ask as AK
from webloom.operators import similarity as V
from webloom.operators.embed import hashing_embedder
from webloom.session import refuse_local

WORDS = "red fox blue whale green leaf old stone tall tree cold rain".split()
EMBED = hashing_embedder(32)


def _corpus(seed=3, n=60):
    rnd = random.Random(seed)
    # a hot host, ties (equal texts), a text without words, a null text
    rows = [(i, "h0" if i % 2 else f"h{rnd.randrange(1, 5)}", f"s{i}", " ".join(rnd.choices(WORDS, k=rnd.randrange(1, 6)))) for i in range(n)]
    return rows + [(n, "h1", "s", "..."), (n + 1, "h2", "s", None), (n + 2, "h0", "s", rows[1][3])]


def _passages(spark, rows):
    return spark.createDataFrame(rows, "pid long, host string, source string, chunk string")


QS = [(1, "red fox and whale"), (2, "cold rain"), (3, "stone tree leaf"), (4, "zzz")]
LISTS = [(1, "h0"), (1, "h1"), (1, "h1"), (2, "h3"), (2, "nowhere"), (3, None), (None, "h0")]


def _vector(text):
    v = [0.0] * 32
    for t in (text or "").lower().replace(".", " ").split():
        h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
        v[h % 32] += 1.0 if h // 32 % 2 == 0 else -1.0
    return v


def _cos(a, b):
    d = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / d if d else 0.0


def _brute(rows, k, lists=None):
    out = set()
    for q, text in QS:
        for host in {r[1] for r in rows}:
            if lists is not None and (q, host) not in lists:
                continue
            mine = [(-round(_cos(_vector(text), _vector(c)), 6), p) for p, h, _s, c in rows if h == host and c and c != "..."]
            out |= {(q, host, i + 1, p, -s + 0.0) for i, (s, p) in enumerate(sorted(mine)[:k])}
    return out


def _got(df):
    return {(r.qid, r.host, r.rank, r.did, r.sim + 0.0) for r in df.collect()}


def test_embedder_is_the_plain_one(spark):
    texts = [(1, "Red fox, red."), (2, ""), (3, None), (4, "ÄRGER über"), (5, "cold " * 3000)]
    got = {r.id: r.embedding for r in EMBED(spark.createDataFrame(texts, "id long, text string")).collect()}
    assert set(got) == {1, 4, 5}
    assert got[1] == _vector("red fox red") and got[5] == _vector("cold " * 3000)


@pytest.mark.parametrize("k", [1, 4])
def test_dense_host_hits_equal_brute_force(spark, k):
    rows = _corpus()
    qs, ps = spark.createDataFrame(QS, "qid long, question string"), _passages(spark, rows)
    assert _got(AK.dense_host_hits(qs, ps, k, EMBED)) == _brute(rows, k)
    lists = AK.asked_hosts(spark.createDataFrame(LISTS, "qid long, host string"))
    want = _brute(rows, k, {(q, h) for q, h in LISTS})
    assert want and _got(AK.dense_host_hits(qs, ps, k, EMBED, lists)) == want


def test_knn_within_does_not_depend_on_the_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "hot" if i % 3 else f"v{i % 4}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)]
    corpus = spark.createDataFrame(rows, "id long, host string, embedding array<double>")
    queries = corpus.where(F.col("id") % 10 == 0)
    small = V.knn_within(queries, corpus, 3, "host", block_rows=7)
    large = V.knn_within(queries, corpus, 3, "host")
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert V.knn_within(queries, corpus.limit(0), 3, "host").count() == 0


def test_fan_out_is_the_list(spark):
    rows = _corpus()
    qs, ps = spark.createDataFrame(QS, "qid long, question string"), _passages(spark, rows)
    hosts = spark.createDataFrame(LISTS, "qid long, host string")
    for embedder in (None, EMBED):
        got = {(r.qid, r.host) for r in AK.host_answers(qs, ps, scope="host", embedder=embedder, hosts=hosts).collect()}
        assert {h for q, h in got if q == 1} == {"h0", "h1"} and got <= {(q, h) for q, h in LISTS}
        out = {r.qid: r for r in AK.ask(qs, ps, None, scope="host", embedder=embedder, hosts=hosts).collect()}
        assert out[3].answer == out[4].answer == C.NO_VALID_ANSWERS     # no list, and nothing to find


def test_global_scope_ranks_the_listed_hosts_together(spark):
    rows = _corpus()
    qs, ps = spark.createDataFrame(QS, "qid long, question string"), _passages(spark, rows)
    hosts = spark.createDataFrame(LISTS, "qid long, host string")
    best = sorted((-s, p, h) for q, h, _r, p, s in _brute(rows, 4, {(q, h) for q, h in LISTS}) if q == 1)[:4]
    r = {r.qid: r for r in AK.host_answers(qs, ps, scope="global", embedder=EMBED, hosts=hosts).collect()}
    assert r[1].host == "*" and r[1].confidence == pytest.approx(-best[0][0], abs=1e-9)
    assert r[1].sources == sorted({next(x[2] for x in rows if x[0] == p) for _s, p, _h in best})


def test_few_hosts_prune_folders_and_many_are_joined(spark, tmp_path):
    path = str(tmp_path / "passages")
    _passages(spark, _corpus()).write.partitionBy("host").parquet(path)
    ps = spark.read.parquet(path)
    hosts = AK.asked_hosts(spark.createDataFrame(LISTS, "qid long, host string"))
    few = AK.passages_of(ps, hosts)
    scan = [ln for ln in few._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in ln]
    assert scan and "PartitionFilters: [host#" in scan[0] and "IN (" in scan[0]
    many = AK.passages_of(ps, hosts, max_named=1)
    assert "LeftSemi" in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.pid for r in few.collect()) == sorted(r.pid for r in many.collect())


def test_scratch_is_refused_on_machine_local_disks():
    refuse_local("local[4]", "file:///")
    refuse_local("spark://host:7077", "hdfs://names:8020")
    with pytest.raises(RuntimeError):
        refuse_local("yarn", "file:///")


def _few(spark):
    passages = spark.createDataFrame([(i, f"h{i % 3}", f"h{i % 3}", f"word{i % 7} other{i % 5} text") for i in range(30)],
                                     "pid long, host string, source string, chunk string")
    return spark.createDataFrame([(1, "word1 other2"), (2, "text word3")], "qid long, question string"), passages


def test_passages_are_scored_once(spark):
    """Sources and answers read the ranked passages, not the scoring twice (F3)."""
    from webloom.operators import ask as AK
    qs, passages = _few(spark)
    plan = AK.host_answers(qs, passages, scope="host")._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan


def test_each_text_is_embedded_once(spark):
    """Counting, dealing and joining the vectors does not embed again (F13, F17)."""
    import pandas as pd
    from webloom.operators import ask as AK
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        def job(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pd.DataFrame({"id": pdf["id"], "embedding": [[float(len(t)), 1.0] for t in pdf["text"]]})
        return texts.mapInPandas(job, "id long, embedding array<double>")
    qs, passages = _few(spark)
    assert AK.ask(qs, passages, None, scope="host", embedder=embed).count() == 2
    assert seen.value == 32

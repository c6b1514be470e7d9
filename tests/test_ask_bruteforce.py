"""The registered ``ask`` (split passages, per-host scope) against a plain
Python brute force of the same pass on the smoke data."""
import math
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pyarrow.parquet as pq
import regex

import __spark_entry__ as E
from webloom import constants as C
from webloom.functions.splitter import split_text

from conftest import SF001

TOKEN = regex.compile(r"\p{L}+")


def _terms(text):
    return Counter(TOKEN.findall(text.lower())) if text else Counter()


def _cos(a, b):
    dot = sum(v * b[t] for t, v in a.items() if t in b)
    if dot == 0:
        return None
    na = math.sqrt(sum(v * v for v in a.values()))
    nb = math.sqrt(sum(v * v for v in b.values()))
    return dot / (na * nb)


def _r6(x):
    return float(Decimal(x).quantize(Decimal("1e-6"), rounding=ROUND_HALF_UP))


def _brute(k=4, threshold=C.SIMILARITY_THRESHOLD):
    docs = pq.read_table(f"{SF001}/documents.parquet").to_pylist()
    bench = pq.read_table(f"{SF001}/benchmark.parquet").to_pylist()
    users = {r["text"] for r in pq.read_table(f"{SF001}/conversations.parquet").to_pylist()
             if r["role"] == "user"}
    passages = [(d["doc_id"] * 100000 + i, d["source"], chunk, _terms(chunk))
                for d in docs for i, chunk in enumerate(split_text(d["text"]))]
    out = {}
    for q in bench:
        assert q["text"] not in users  # nothing is cached in the registered query
        qt = _terms(q["text"])
        by_host = {}
        for pid, host, chunk, pt in passages:
            s = _cos(qt, pt)
            if s is not None:
                by_host.setdefault(host, []).append((-_r6(s), pid, chunk, host))
        cand = {}
        for host, rows in by_host.items():
            top = sorted(rows)[:k]
            if top[0][2]:
                cand[host] = (top[0][2], -top[0][0], sorted({r[3] for r in top}))
        if not cand:
            out[q["item_id"]] = (C.NO_VALID_ANSWERS, [], 0.0)
            continue
        hosts = sorted(cand)
        terms = {h: _terms(cand[h][0]) for h in hosts}
        nb = {}
        for i in hosts:
            nb[i] = [j for j in hosts if (_cos(terms[i], terms[j]) or 0.0) >= threshold]
        if len(hosts) == 1:
            nb[hosts[0]] = hosts
        best = min((h for h in hosts if nb[h]), key=lambda h: (-len(nb[h]), h))
        members = nb[best]
        votes = Counter(cand[m][0] for m in members)
        answer = min(votes, key=lambda a: (-votes[a], a))
        mean = sum(Decimal(repr(cand[m][1])) for m in members) / len(members)
        conf = float(mean.quantize(Decimal("1e-6"), rounding=ROUND_HALF_UP))
        sources = sorted({s for h in hosts for s in cand[h][2]})
        out[q["item_id"]] = (answer, sources, conf)
    return out


def test_ask_equals_brute_force(spark):
    want = _brute()
    got = {r.qid: (r.answer, list(r.sources), r.confidence, r.cached, r.confident)
           for r in E.queries()["ask"](spark, SF001).collect()}
    assert set(got) == set(want)
    for qid, (answer, sources, conf) in want.items():
        g = got[qid]
        assert (g[0], g[1], g[2]) == (answer, sources, conf), qid
        assert g[3] is False and g[4] == (conf >= C.CONFIDENCE_GATE)

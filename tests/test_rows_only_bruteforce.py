"""Rows-only registered queries against plain-Python brute force on the smoke data."""
import hashlib

import pyarrow.parquet as pq

import __spark_entry__ as E
from webloom.functions.splitter import split_text

from conftest import SF001


def _docs():
    return pq.read_table(f"{SF001}/documents.parquet").to_pylist()


def _brute_chunks():
    return sorted((d["doc_id"], d["source"], i, c) for d in _docs()
                  for i, c in enumerate(split_text(d["text"])))


def test_doc_chunks(spark):
    got = sorted(tuple(r) for r in E.queries()["doc_chunks"](spark, SF001)
                 .select("doc_id", "source", "chunk_index", "chunk").collect())
    assert got == _brute_chunks()


def test_chunk_counts(spark):
    want = {}
    for doc_id, _, _, _ in _brute_chunks():
        want[doc_id] = want.get(doc_id, 0) + 1
    got = {r.doc_id: r.n_chunks for r in E.queries()["chunk_counts"](spark, SF001).collect()}
    assert got == want


def test_index_idempotent(spark):
    want = sorted({(d, s, i, hashlib.md5(c.encode()).hexdigest()) for d, s, i, c in _brute_chunks()})
    got = sorted((r.doc_id, r.source, r.chunk_index, r.chunk_md5) for r in
                 E.queries()["index_idempotent"](spark, SF001).collect())
    assert got == want

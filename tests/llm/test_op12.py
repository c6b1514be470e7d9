import zlib
from collections import defaultdict

import numpy as np
import pytest

from webloom.llm.packing import bucket_table, decompose, pack
from webloom.llm.tokens import default_tokenizer

from .test_op9 import ODD


def test_decompose_by_binary_digits():
    n = np.array([1, 2, 3, 4095, 4096, 4097, 10_000, 131_072 + 5])
    doc, start, length = decompose(n, 4096)
    for i, total in enumerate(n.tolist()):
        mine = length[doc == i].tolist()
        assert mine == [4096] * (total // 4096) + [1 << k for k in range(11, -1, -1) if total % 4096 >> k & 1]
        assert start[doc == i].tolist() == np.concatenate([[0], np.cumsum(mine)[:-1]]).tolist()
    assert [len(x) for x in decompose(np.zeros(0, np.int64), 8)] == [0, 0, 0]


def check(rows, pieces, most):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(default_tokenizer())
    want = sorted((d, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for d, x in rows)
    whole = defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.sequence_id):     # a document's pieces lie in order in one task
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length and p.length & (p.length - 1) == 0 and p.length <= most and p.offset == 0
        if p.start == 0:
            whole[p.doc_id].append([])
        assert len(whole[p.doc_id][-1]) == p.start
        whole[p.doc_id][-1] += ids.tolist()
    assert sorted((d, tuple(x)) for d, xs in whole.items() for x in xs) == want
    assert len({p.sequence_id for p in pieces}) == len(pieces)      # no sequence of two documents


@pytest.mark.parametrize("most", [4096, 64])
def test_pieces_are_the_documents(spark, most):
    rows = [(1000 - i, x) for i, x in enumerate(ODD)] + [(3, "dup"), (3, "dup"), (3, "other one")]
    df = spark.createDataFrame([(d, x, 1, b"") for d, x in rows], "doc_id long, text string, start int, ids binary")
    out = pack(df.repartition(3), most=most)
    check(rows, out.collect(), most)
    for r in bucket_table(out).collect():
        assert r.n_tokens == r.length * r.n_sequences


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "no id"), (None, None)], "doc_id long, text string")
    assert sorted(p.doc_tokens for p in pack(df).collect() if p.start == 0) == [1, 3]
    none = pack(df.limit(0))
    assert none.collect() == [] and none.columns[-1] == "length"
    with pytest.raises(ValueError):
        pack(df, most=1000)


def test_readers_of_a_bucket_prune_the_others(spark):
    df = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id long, text string")
    out = pack(df).where("length = 16")
    assert "PartitionFilters: [isnotnull(length" in out._jdf.queryExecution().executedPlan().toString()
    assert {p.doc_id for p in out.collect()} == {i for i in range(40) if i + 1 & 16}


def test_query_digests(spark):
    import __spark_entry__ as E
    from .tests_data import SF001
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(default_tokenizer())
    ids = {d.doc_id: np.array(t.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4") for d in docs}
    seen = defaultdict(int)
    for p in E.queries()["op12_packing"](spark, SF001).collect():
        part = ids[p.doc_id][p.start:p.start + p.length]
        assert zlib.crc32(part.tobytes()) == p.ids_crc32 and len(part) == p.length and p.doc_tokens == len(ids[p.doc_id])
        seen[p.doc_id] += p.length
    assert seen == {d: len(x) for d, x in ids.items()}

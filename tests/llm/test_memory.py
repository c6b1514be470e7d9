"""Memory of a Python worker's steps, as numpy's allocations are traced."""
import tracemalloc

import numpy as np
import pyarrow as pa

from webloom.llm import decontaminate, idcoder
from webloom.llm import words as W
from webloom.llm.tables import Bloom


def peak(job):
    job()                       # tables that are kept are made before
    tracemalloc.start()
    try:
        job()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_coder_holds_ids_in_four_bytes():
    ids = np.random.default_rng(1).zipf(1.3, 1 << 19).clip(max=49407).astype(np.uint32)
    block = idcoder.encode(ids)
    assert (idcoder.decode(block) == ids).all()
    assert peak(lambda: idcoder.encode(ids)) < 26 * len(ids)
    assert peak(lambda: idcoder.decode(block)) < 27 * len(ids)


def test_slices_bound_the_words_of_a_batch():
    column = pa.array(["some words of one text, again and again " * 50] * 1500)

    def scan():
        for _lo, _hi, raw, off in W.slices(column):
            W.segment(raw, off).hashes()
    assert peak(scan) < 12e6


def test_gram_counts_over_slices(spark):
    text = "one two three four five six seven eight nine ten " * 400
    docs = spark.createDataFrame([(i, text if i % 9 else None) for i in range(100)], "doc_id long, text string").coalesce(1)
    assert 89 * len(text) > 2 * W.SLICE_BYTES
    words = W.segment(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), W.LETTERS)
    grams = decontaminate._grams(words, decontaminate._DOC)[2]
    bloom = Bloom(1 << 12)
    bloom.words[:] = -1         # asks for all
    got = {r.gram: r.n for r in decontaminate.gram_counts(docs, bloom, decontaminate._DOC).collect()}
    u, n = np.unique(grams.view(np.int64), return_counts=True)
    assert got == {g: 88 * k for g, k in zip(u.tolist(), n.tolist())}

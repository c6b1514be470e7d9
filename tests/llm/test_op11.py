import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import fim
from webloom.llm.fim import ChunkMemo, chunk_starts, locate, restored, rolling_hash, summarise, transform


def plain(doc_id, text):
    """The contract, by slicing strings."""
    t = text or ""
    n = len(t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


SHARED = "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz  é😀ß", k=9000))
TEXTS = ["", None, "a", "é", "😀", "two\nlines\r\n", "a <P> b", "a <S", "P> <", "<<P", "M>", "x" * 40_000, "é" * 30_000, "😀" * 5000,
         SHARED, "other start " + SHARED, "Ünlike start" + SHARED[100:], SHARED[:4000] + "…" + SHARED[3000:], "\x00nul\x00", "́combining"]


def test_equals_slicing(spark):
    rows = [(i * 37 + j, t) for i, t in enumerate(TEXTS) for j in range(12)] + [(5, "dup"), (5, "dup"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(d, t, 7, "x", "y") for d, t in rows], "doc_id long, text string, n int, form string, output string")
    for memo_bytes in (1 << 25, 2000):        # a memo too small to keep anything changes nothing
        out = transform(df.repartition(3), memo_bytes=memo_bytes).withColumn("back", restored(F.col("output"), F.col("form")))
        got = sorted((tuple(r) for r in out.collect()), key=repr)
        assert got == sorted(((d, *plain(d, t), t or "") for d, t in rows), key=repr)
        assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    out = transform(spark.createDataFrame([], "doc_id int, text string"))
    assert out.collect() == [] and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_rolling_hash_by_definition():
    data = np.random.default_rng(1).integers(0, 256, 200).astype(np.uint8)
    h, gear = rolling_hash(data), fim._gear()
    for i in range(len(data)):
        want = sum(int(gear[data[i - k]]) << k for k in range(min(32, i + 1))) & 0xFFFFFFFF
        assert int(h[i]) == want


def chunks(texts, **options):
    raw = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts = chunk_starts(raw, off, **options).tolist()
    assert set(off[:-1][np.diff(off) > 0].tolist()) <= set(starts)      # no chunk of two documents
    return [bytes(raw[a:b]) for a, b in zip(starts, starts[1:] + [len(raw)])], starts, off


def test_chunks_are_the_texts_and_follow_content():
    body = SHARED.encode()
    one, _, _ = chunks([body, b"", b"zz" + body, b"tiny"])
    assert b"".join(one) == body + b"zz" + body + b"tiny"
    assert len(set(one)) < 0.6 * len(one)             # the shifted copy has the same chunks but for the first
    alone, _, _ = chunks([b"zz" + body])
    assert set(alone) <= set(one)                     # what stands before a document does not matter
    assert max(map(len, chunks([b"a" * 50_000], most=1000)[0])) == 1000


def test_memo_verifies_content_and_is_bounded():
    memo = ChunkMemo(limit=100)
    assert memo.get(1, "aé".encode())[0] == 2 and memo.get(1, "aé".encode())[0] == 2 and memo.hits == 1
    assert memo.get(1, b"another")[0] == 7 and memo.hits == 1       # equal fingerprint, other content
    assert memo.get(1, "aé".encode())[0] == 2 and memo.hits == 2
    for i in range(50):
        memo.get(10 + i, bytes([65 + i]) * 30)
    assert memo.held <= 100


@pytest.mark.parametrize("text", ["abc", "aé😀ß" * 400, "é" * 129, "x" * 63 + "é" * 70])
def test_locate_every_point(text):
    data = text.encode()
    cuts = list(range(0, len(data), 50)) + [len(data)]             # chunks may begin inside a code point
    starts, summaries = cuts[:-1], [summarise(data[a:b]) for a, b in zip(cuts, cuts[1:])]
    assert sum(c for c, _ in summaries) == len(text)
    for p in range(len(text) + 1):
        assert locate(memoryview(data), starts, summaries, p) == len(text[:p].encode())

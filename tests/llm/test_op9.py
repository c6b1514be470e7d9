import zlib

import numpy as np
import pytest

from webloom.llm import idcoder
from webloom.llm.tokens import default_tokenizer, pack, token_output, unpack, write_blocks


@pytest.mark.parametrize("n", [0, 1, 63, 64, 129, 5000, 70_000])
def test_coder_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 49408, n), np.minimum(r.zipf(1.3, n), 49407), np.full(n, 7), np.arange(n) % 50,
                np.tile(r.integers(0, 49408, 97), n // 97 + 1)[:n]):
        block = idcoder.encode(ids.astype(np.uint32))
        assert (idcoder.decode(block) == ids).all()


def test_coder_learns():
    r = np.random.default_rng(1)
    text = np.tile(r.integers(0, 49408, 3000), 30).astype(np.uint32)
    assert len(idcoder.encode(text)) < len(text)   # 32 bits each before


def test_total_is_bounded():
    ids = np.zeros(1_200_000, np.uint32)
    assert (idcoder.decode(idcoder.encode(ids)) == ids).all()


def test_damage_is_found():
    ids = np.random.default_rng(2).integers(0, 49408, 4000).astype(np.uint32)
    block = bytearray(idcoder.encode(ids))
    block[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        idcoder.decode(bytes(block))
    for bad in (b"", b"WTB1" + b"\0" * 40):
        with pytest.raises(ValueError):
            idcoder.decode(bad)
    with pytest.raises(ValueError):
        idcoder.encode(np.array([49408]))


def test_directory_round_trip():
    doc, counts, ids = unpack(pack([None, 5, -3], [1, 2, 1], np.array([2, 9, 2, 2], np.uint32)))
    assert doc == [None, 5, -3] and counts.tolist() == [1, 2, 1] and ids.tolist() == [2, 9, 2, 2]


ODD = ["", None, "plain text", "Don't STOP!! it's 12,345 ok?", "a<|endoftext|>b <|startoftext|>", "É́tude ΣΑΣ ſ İ x́!",
       "tab\tand\x0bvertical space em", "a" * 3000, "word " * 5000, "''s 'll x's' (it's)", "́combining", "|!|",
       "l'été, c'est-à-dire...", "foo_bar baz-qux; a.b.c", "日本語テキスト です。", "no\x00nul", "a\x1cb \x1c c\x85d\xa0e\u2003f\u200bg", "\n\n  x  \r\n y ", "😀😀 ok!"]


def test_query_matches_whole_text_tokenizer(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(default_tokenizer())
    rows = [(1000 - i, x) for i, x in enumerate(ODD)] + [(3, "dup"), (3, "dup"), (3, "other"), (None, "none"), (None, None)]
    df = spark.createDataFrame([(d, x, 1) for d, x in rows], "doc_id long, text string, start int")
    got = token_output(df, block_ids=700, partitions=3).collect()
    expect = sorted(((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, x in rows
                     for ids in [t.encode(x or "", add_special_tokens=False).ids + [2]]), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == expect
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        key = (r.doc_id is not None, r.doc_id or 0)
        assert last is None or key >= last
        last = key


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_output(df).collect() == []
    assert write_blocks(df).count() == 0

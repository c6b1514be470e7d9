import random
import re

import numpy as np
from pyspark.sql import functions as F

from webloom.llm.decontaminate import leaks, smith_waterman, without_leaks


def plain_sw(a, b):
    best, end = 0, 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
            if new[-1] > best:
                best, end = new[-1], j + 1
        row = new
    return best, end


def tokens(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_smith_waterman_matches_plain():
    r = random.Random(1)
    a = [np.array([r.randint(1, 4) for _ in range(r.randint(0, 12))], np.int64) for _ in range(60)]
    b = [np.array([r.randint(1, 4) for _ in range(r.randint(0, 30))], np.int64) for _ in range(60)]
    score, end = smith_waterman(a, b)
    for i in range(60):
        best, _ = plain_sw(a[i].tolist(), b[i].tolist())
        assert score[i] == best
        assert plain_sw(a[i].tolist(), b[i][:end[i]].tolist())[0] == best


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(1, 5)))
    items = [(i, " ".join(word() for _ in range(r.randint(15, 40)))) for i in range(12)]
    items += [(50, "too short to tell"), (51, ""), (None, None), (52, items[0][1])]
    docs = []
    for i in range(60):
        w = [word() for _ in range(r.randint(0, 150))]
        if i % 4 == 0:
            copy = items[i % 12][1].split()
            for _ in range((i // 4) % 5):                 # edited copies
                k = r.randrange(len(copy))
                copy[k:k + 1] = r.choice([[], [word()], [word(), word()]])
            w[len(w) // 3:len(w) // 3] = [x.upper() if i % 8 else x + "," for x in copy]
        docs.append((i, " ".join(w)))
    docs += [(80, "he says it is TOO short, to tell."), (81, "too short not to tell"), (82, "too short to")]
    docs += [(70, None), (71, ""), (None, items[3][1]), (5, items[4][1]), (5, items[4][1]), (72, (items[5][1] + " ") * 30)]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, 9, "x") for d, t in docs], "doc_id long, text string, th int, words string"),
            spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, gram int"))


def test_matches_brute_force(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    got = {(x.doc_id, x.item_id): round(x.score, 9) for x in leaks(d, i, bits=1 << 16).collect()}
    want = {}
    for doc, t in docs:
        for item, s in items:
            a = tokens(s)
            if a:
                score = plain_sw(a, tokens(t))[0] / (2 * len(a))
                if score >= (0.5 if len(a) >= 8 else 1):
                    want[doc, item] = max(want.get((doc, item), 0), round(score, 9))
    assert got == want
    assert len(want) >= 15


def test_spans_and_clean_documents(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    text = dict(items)
    for x in leaks(d, i, bits=1 << 16).where("score = 1").collect():
        for t in (t for doc, t in docs if doc == x.doc_id):
            if tokens(t)[x.start_word:x.end_word] == tokens(text[x.item_id]):
                break
        else:
            raise AssertionError(x)
    kept = without_leaks(d, i, bits=1 << 16)
    assert kept.columns == d.columns
    left = [x.doc_id for x in kept.collect()]
    assert 80 not in left and 81 in left and 82 in left
    assert 80 in [x.doc_id for x in without_leaks(d, i, min_words=8).collect()]
    assert 1 in left and 70 in left and 71 in left and 0 not in left and None not in left
    assert left.count(5) == 1


def test_empty_tables(spark):
    d, i = frames(spark, *corpus())
    none_d, none_i = frames(spark, [], [])
    assert leaks(none_d, i, bits=1 << 12).collect() == []
    assert leaks(d, none_i, bits=1 << 12).collect() == []
    assert without_leaks(d, none_i, bits=1 << 12).count() == d.count()


def test_dense_edits_match_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(4, 7)))
    items = [(i, " ".join(word() for _ in range(15 + i % 6 if i < 18 else 8))) for i in range(20)]
    docs = []
    for i, t in items:
        for every in (2, 3, 4, 5):
            for edit in (lambda x: [word()], lambda x: [], lambda x: [x, word()], lambda x: [word(), word()]):
                copy = [y for k, x in enumerate(t.split()) for y in (edit(x) if k % every == every - 1 else [x])]
                docs.append((len(docs), " ".join([word() for _ in range(40)] + copy + [word() for _ in range(40)])))
        docs.append((len(docs), " ".join(f"{x} {word()}" for x in t.split())))
    d, i = frames(spark, docs, items)
    got = {(x.doc_id, x.item_id): round(x.score, 9) for x in leaks(d, i, bits=1 << 16).collect()}
    scores = {(n, m): plain_sw(tokens(s), tokens(t))[0] / (2 * len(tokens(s))) for n, t in docs for m, s in items}
    want = {k: round(v, 9) for k, v in scores.items() if v >= 0.5}
    assert got == want
    assert len(want) > 200


def test_every_leak_has_its_seeds():
    """Most that an alignment scores which has fewer seeds than a leak needs, by its item's words."""
    from webloom.llm.decontaminate import _DOC, _ITEM
    gaps = [(d, e) for d in range(4) for e in range(5)]
    shared = {((s[1] - 1, s[2] - s[1] - 1), (t[1] - 1, t[2] - t[1] - 1)) for s in _ITEM for t in _DOC}
    longest, most = 40, 7
    best = {(1, None, 0): 2}                     # (item words, gap before the last match, seeds): score
    for n in range(2, longest + 1):
        for gap in gaps:
            for (_, last, k), score in [(x, y) for x, y in best.items() if x[0] == n - 1 - gap[0]]:
                k += last is not None and ((last[0], gap[0]), (last[1], gap[1])) in shared
                if k < most:
                    best[n, gap, k] = max(best.get((n, gap, k), 0), score + 2 - max(gap))
    for n in range(8, longest + 1):
        need = max(-(-2 * n // 9) - 2, 1)
        assert need <= most
        assert max(s for (m, _, k), s in best.items() if m <= n and k < need) < n


def zipf_corpus(n_docs=300, n_items=40, length=40):
    """Texts of which 45 % are function words of Zipf frequency."""
    r = random.Random(8)
    function = [f"f{k}" for k in range(22)]
    weights = [1 / (k + 1) for k in range(22)]

    def word():
        return r.choices(function, weights)[0] if r.random() < 0.45 else "w%d" % r.randrange(4000)
    items = [(i, " ".join(word() for _ in range(length))) for i in range(n_items)]
    docs = [[word() for _ in range(r.randint(50, 250))] for _ in range(n_docs)]
    for i in range(0, n_docs, 10):
        copy = items[i // 10 % n_items][1].split()
        for k in r.sample(range(length), length // 6):
            copy[k] = word()
        docs[i][20:20] = copy
    return [(i, " ".join(w)) for i, w in enumerate(docs)], items


def test_rare_seeds_are_complete_and_few(spark):
    from webloom.llm import decontaminate as D
    docs, items = zipf_corpus()
    d, i = frames(spark, docs, items)
    got = {(x.doc_id, x.item_id) for x in leaks(d, i).collect()}
    assert got == {(n, m) for n, t in docs for m, s in items if plain_sw(tokens(s), tokens(t))[0] >= 40} and len(got) >= 30
    # rows of the join of document grams with all item grams, and with the rarest only
    base = d.select("doc_id", "text")
    texts = D._sequences(i.select("item_id", F.xxhash64("text").alias("th"), "text"))
    marks = D.grams_of_items(texts, D._ITEM).cache()
    counts = D.gram_counts(base, D.sized(marks.count(), None).build(marks, "gram"), D._DOC).cache()
    rare = D.rarest(marks, counts)
    rows = lambda x: x.join(counts, "gram").agg(F.sum("n")).first()[0]
    assert rows(rare) * 4 <= rows(marks)
    per_item = marks.groupBy("item_id").agg(F.sum("times").alias("g"), F.max("need").alias("need")).collect()
    assert {(r.g, r.need) for r in per_item} == {(3 * 40 - 8, 7)}

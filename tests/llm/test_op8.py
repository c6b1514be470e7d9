import random
import zlib

import numpy as np
import pytest

from webloom.llm.toxicity import Lexicon, maximal_segments, scored


def ruzzo_tompa_brute(x):
    """Recursive definition: the best segment (shortest, then leftmost), then both sides."""
    best = None
    for i in range(len(x)):
        for j in range(i + 1, len(x) + 1):
            s = sum(x[i:j])
            if s > 1e-9 and (best is None or s > best[0] + 1e-9 or (abs(s - best[0]) <= 1e-9 and j - i < best[2] - best[1])):
                best = (s, i, j)
    if best is None:
        return []
    _, i, j = best
    return ruzzo_tompa_brute(x[:i]) + [(i, j)] + [(a + j, b + j) for a, b in ruzzo_tompa_brute(x[j:])]


@pytest.mark.parametrize("seed", range(30))
def test_segments_match_definition(seed):
    r = random.Random(seed)
    drift = 0.37
    x = [r.choice([1.13, 2.41, 0.59]) if r.random() < 0.3 else -drift for _ in range(24)]
    at = [i for i, v in enumerate(x) if v > 0]
    got = maximal_segments(at, [x[i] for i in at], drift)
    assert [(a, b) for a, b, _ in got] == ruzzo_tompa_brute(x)
    for a, b, s in got:
        assert np.isclose(s, sum(x[a:b]))


def test_decay_solves_its_equation():
    lex = Lexicon(np.arange(3, dtype=np.uint64), np.array([3.0, 4.0, 5.0]), np.array([1e-3, 1e-4, 1e-5]), 0.05)
    x = lex.decay()
    assert np.isclose((lex.rate * np.exp(x * lex.score)).sum() + (1 - lex.rate.sum()) * np.exp(-x * 0.05), 1, atol=1e-6)


def corpus(n=700):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    bad = ["zorrid", "zukkal", "quixat"]
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(15, 250))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(r.randint(3, 8)):
                b = r.choice(bad)
                w[r.randrange(len(w))] = r.choice([b, b.upper() + "!", "vexq" + word()])
        docs.append((i, " ".join(w)))
        if i % 2 or toxic:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_passages(spark):
    docs, labels = corpus()
    extra = [(None, "zorrid " * 9), (9001, None), (9002, ""), (0, docs[0][1]), (9003, "zorrid quixat zukkal " * 20000)]
    d = spark.createDataFrame([(a, t, 0.5, "x") for a, t in docs + extra], "doc_id long, text string, score double, label string")
    l = spark.createDataFrame(labels + [(None, 1), (3, None), (5, 0), (5, 1)], "doc_id long, toxic int")
    rows = scored(d, l).collect()
    assert len(rows) == len(docs) + len(extra)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    truth = {i: int(i % 6 == 0) for i in range(len(docs))}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.97
    by = {r.doc_id: r for r in rows}
    assert by[9001].predicted == by[9002].predicted == 0 and by[9003].predicted == 1 and by[None].predicted == 1
    assert by[0].n_passages >= 1 and by[0].passages[0].score > 0


def test_without_labels_or_rows(spark):
    docs, labels = corpus(60)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert scored(d, l.limit(0)).where("predicted = 1").count() == 0
    assert scored(d.limit(0), l).count() == 0


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.88), ("sf0.1", 0.9)])
def test_held_out_rows_of_the_given_labels(spark, sf, least):
    """At sf0.01, 18 toxic rows are held out, two of which (850, 881) hold no word that toxic rows favour."""
    read = lambda name: spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
    rows = scored(read("documents"), read("labels")).join(read("labels"), "doc_id").where("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    alone = [1 - r.predicted for r in rows if r.toxic == 0]
    assert np.mean(caught) >= least and np.mean(alone) >= 0.97


def plain_lexicon(train, strength, z, least):
    """{word or prefix: log-odds} of (text, label) rows, by dictionaries."""
    import math
    import re
    from collections import Counter
    split = lambda t: set(re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()))
    n = {0: Counter(), 1: Counter()}
    for text, label in train:
        n[label].update(split(text))
    t, c = max(sum(n[1].values()), 1), max(sum(n[0].values()), 1)
    fam = {y: Counter() for y in n}
    for y in n:
        for w, k in n[y].items():
            fam[y][w[:4]] += k

    def entry(toxic, clean, share):
        a, b = toxic + strength * share, clean + strength * (1 - share)
        odds = math.log(a / b) - math.log(t / c)
        return odds if odds >= least and odds / math.sqrt(1 / a + 1 / b) >= z else None
    base, out = t / (t + c), {}
    for p in set(fam[0]) | set(fam[1]):
        out["prefix", p] = entry(fam[1][p], fam[0][p], base)
    for w in n[1]:
        ft, fc = fam[1][w[:4]] - n[1][w], fam[0][w[:4]] - n[0][w]
        out["word", w] = entry(n[1][w], n[0][w], (ft + strength * base) / (ft + fc + strength))
    return sorted(round(min(v, 8.0), 9) for v in out.values() if v is not None)


def test_lexicons_by_dictionaries(spark):
    from webloom.llm.toxicity import FOLDS, learn_lexicons, word_counts
    docs, labels = corpus(500)
    truth = dict(labels)
    rows = [(t, truth[i], i // 6 % FOLDS) for i, t in docs if i in truth]
    counts = word_counts(spark.createDataFrame(rows, "text string, label int, fold int"))
    grid = ((1.0, 2.0, 1.0), (5.0, 2.0, 0.5))
    for view, entries in enumerate(learn_lexicons(counts, grid)):
        train = [(t, y) for t, y, f in rows if f != view]
        for (strength, z, least), lex in zip(grid, entries):
            want = plain_lexicon(train, strength, z, least)
            assert np.allclose(sorted(lex.score), want) and len(want) > 0

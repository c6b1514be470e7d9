import random
import re

from webloom.llm.components import components
from webloom.llm.jaccard import jaccard_classes


def brute(rows, n=3, num=90, den=100):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(own) if own else None) if sets[i] else d))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeFG") for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(12):                       # groups of near copies, few and many edits
        base = [word() for _ in range(r.choice([3, 20, 60, 150]))]
        for _ in range(r.randint(2, 14)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
    common = " ".join(word() for _ in range(12))
    rows += [f"{common} {word()} {word()}" for _ in range(25)]    # one very common passage
    rows += ["a b", "A  b", "a", "a b c", "", " \n", "x " * 50, "x " * 70, " ".join(word() for _ in range(3000))]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return list(zip(ids, rows)) + [(None, rows[0]), (None, "only here now"), (None, None), (500, None), (501, rows[3]), (502, rows[3])]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, n int, node string")
    return sorted((tuple(x) for x in jaccard_classes(df, buckets=1 << 14, **kw).collect()), key=str)


def test_matches_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_semi_joins_beyond_the_filters(spark):
    rows = corpus()
    assert run(spark, rows, bits=1 << 8) == brute(rows)


def test_five_words_lower_threshold(spark):
    rows = corpus()
    assert run(spark, rows, n=5, num=80, fragments=3) == brute(rows, 5, 80)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    table = spark.createDataFrame(links, "a long, b long").repartition(7)
    root = {v: v for e in links if e[0] != e[1] for v in e}
    for _ in range(len(root)):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    for block in (40, 1 << 17):     # many blocks, one
        assert {x.node: x.comp for x in components(table, block).collect()} == root

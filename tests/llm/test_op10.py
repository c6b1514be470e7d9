import hashlib
import re
from collections import Counter

from webloom.llm.repeats import remove_repeats


def brute(rows, window):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, window=35, anchor=8):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, th string, unitig int")
    return sorted((tuple(r) for r in remove_repeats(df, window, anchor, 1 << 16).collect()), key=str)


def corpus():
    import random
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(40):
        w = [word() for _ in range(r.randint(0, 120))]
        if i % 3 == 0:
            cut = r.randint(0, 20)
            w[len(w) // 2:len(w) // 2] = passage[cut:cut + r.randint(30, 60)]
        rows.append((i, r.choice([" ", "\n", "  "]).join(w)))
    rows += [(100, rows[3][1]), (3, rows[3][1]), (3, rows[6][1]), (None, rows[0][1]), (None, None), (101, ""),
             (102, None), (103, "be " * 300), (104, "a b c " * 200), (105, " ".join(word() for _ in range(4000)))]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows, 35)


def test_short_windows(spark):
    rows = corpus()
    assert run(spark, rows, 5, 3) == brute(rows, 5)


def test_empty_table(spark):
    assert run(spark, []) == []

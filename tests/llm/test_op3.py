import re
from collections import Counter


from webloom.llm.rules import POLICIES, RULES, ablations, ledger, mask, measured, passes

from .tests_data import SF001

TEXTS = ["", None, " \n\t", "one two three", "a b c d e f g h " * 4, "word " * 30, "x\x0by z\r\nq  w\n\n\nq  w\nq  w\n",
         "A#b *c* $%&|<>! É" * 5, " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i % 9}" for i in range(100)) + " tail",
         "lead " + " ".join("abcdefgh") + " mid " + " ".join("abcdefgh"), "nul\x00nul  em space", "é" * 40, "ab " * 30000]


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    g = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen = Counter(g)
    covered = {k for i, x in enumerate(g) if seen[x] > 1 for k in range(i, i + 8)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
            "n_upper": sum(c.isupper() for c in t), "n_marks": t.count("!"), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "n_same": sum(a == b for a, b in zip(w, w[1:]))}


def test_measurements_match_plain_python(spark):
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(TEXTS)] + [(None, "x", 1), (0, "", 1)],
                               "doc_id long, text string, n_words int")
    out = ledger(df.withColumnRenamed("n_words", "failed"), keep=("doc_id", "text"))
    assert out.count() == len(TEXTS) + 2
    for r in out.where("doc_id > 0").collect():
        want = plain(r.text)
        assert {k: r[k] for k in want} == want, TEXTS[r.doc_id]
        assert r.failed == sum(1 << i for i, (_, rule) in enumerate(RULES) if eval(rule.replace("=", "=="), {}, want))  # noqa: S307


def test_policies_and_ablations(spark):
    entries = ledger(spark.read.parquet(f"{SF001}/documents.parquet"))
    bits = [r.failed for r in entries.collect()]
    for policy, rules in POLICIES.items():
        full = mask(rules)
        assert entries.where(passes(policy)).count() == sum(b & full == 0 for b in bits)
        got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in ablations(entries, policy).collect()}
        assert got == {r: (sum(b & mask([r]) != 0 for b in bits), sum(b & full == mask([r]) for b in bits),
                           sum(b & full & ~mask([r]) == 0 for b in bits)) for r in rules}


def test_no_python_in_the_plan(spark, capsys):
    measured(spark.read.parquet(f"{SF001}/documents.parquet")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    entries = ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert entries.collect() == [] and ablations(entries, "v2").collect() == []

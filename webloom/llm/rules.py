"""Quality rules as a bitmask ledger (operator 3), in DataFrame functions only.

Every rule is evaluated once for each document: the ledger holds the rules'
measurements and one long whose bit r says that rule r failed.  A policy is a
versioned set of rules, that is a mask: a document passes if its bits and the
mask have nothing in common.  New policies and what each rule of a policy
contributes (its ablation) follow from the ledger alone, the latter from counts
of equal bit sets.

Measurements are made inside the row (arrays of the document's own words), so
nothing is shuffled.  Repeated windows of 8 words are found by a 64-bit hash of
their words, sorted only in documents that repeat one.

Defined results: words are runs of anything but space and \\t-\\r; a null or
empty text has no words and fails ``few_words``; repeated rows are judged one by
one; null ids are kept; an empty table gives no rows; other columns are ignored
(those named in ``keep`` stay).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise

WINDOW = 8


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x).cast("long")


def _pairs(a: str, step: int, f) -> Column:
    """f(x[i], x[i + step]) for all i of an array column."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), f)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the rules' measurements as columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumns({"_w": F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != ""), "_l": lines})
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        "n_upper": F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long"),
        "n_marks": F.regexp_count(body, F.lit("!")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_h": F.transform("_w", lambda w: F.xxhash64(w))}).drop("_w", "_l")
    both = lambda a, b: F.xxhash64(a, b)
    d = d.withColumns({"_2": _pairs("_h", 1, both),
                       "n_same": _sum(_pairs("_h", 1, lambda a, b: (a == b).cast("int")))}).drop("_h")
    d = d.withColumn("_4", _pairs("_2", 2, both)).drop("_2")
    d = d.withColumn("_8", _pairs("_4", 4, both)).drop("_4")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = F.sort_array(F.transform("_8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_8")) < F.size("_8"), placed).otherwise(none)).drop("_8")
    s = F.col("_s")
    again = F.filter(s, lambda x, i: (F.get(s, i - 1).h == x.h) | (F.get(s, i + 1).h == x.h))
    d = d.withColumn("_p", F.sort_array(F.transform(again, lambda x: x.i))).drop("_s")
    covered = _sum(_pairs("_p", 1, lambda a, b: F.least(b - a, F.lit(WINDOW)))) + WINDOW
    return d.withColumn("n_repeat_words", F.when(F.size("_p") > 0, covered).otherwise(F.lit(0)).cast("long")).drop("_p")


#: Rule of each bit, as what fails.  Bits are never given to another rule.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "n_repeat_words * 100 > n_words * 30"),
    ("duplicate_lines", "n_dup_lines * 100 > n_lines * 60"),
    ("symbols", "n_symbols * 100 > n_words * 25"),
    ("short_words", "word_chars < n_words * 2"),
    ("long_words", "word_chars > n_words * 20"),
    ("shouting", "n_upper * 100 > word_chars * 30"),
    ("exclamations", "n_marks * 100 > n_words * 25"),
    ("same_word", "n_same * 100 > n_words * 25"),
)

#: Rules of each version of the policy.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "duplicate_lines", "symbols"),
    "v2": ("few_words", "repeated_windows", "duplicate_lines", "symbols", "shouting", "exclamations", "same_word", "long_words"),
}
_BIT = {name: i for i, (name, _) in enumerate(RULES)}


def mask(rules) -> int:
    return sum(1 << _BIT[r] for r in set(rules))


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The stored ledger: columns ``keep``, the measurements and ``failed``, the
    rules' bits.  It is written once, so that policies, filters and ablations
    read it instead of evaluating rules again."""
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    rows = measured(docs.select(*keep, F.col(text).alias("_text")), "_text")
    return materialise(rows.drop("_text").withColumn("failed", bits), "ledger")


def passes(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing
    else of the policy, and that would be kept without it."""
    full = mask(POLICIES[policy])
    sets = entries.groupBy(F.col("failed").bitwiseAND(F.lit(full).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << _BIT[r]).cast("long").alias("bit"))
                                for r in POLICIES[policy]]))
    each = sets.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    without = F.lit(full).cast("long").bitwiseAND(F.bitwise_not("bit"))
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), count(F.col("bits") == F.col("bit")).alias("n_only"),
        count(F.col("bits").bitwiseAND(without) == 0).alias("n_kept_without"))

"""Soft-membership mixing to target weights (operator 6), in DataFrame
functions only.

1. A classifier trained on a labelled table predicts each document's posterior
   over domains, so a document belongs to several domains in part: naive Bayes
   on hashed words (their mean log-likelihood, ``temper`` times) and on four
   levels of marks, symbols, capitals and repeated words.
2. Document rates r >= 0 are fitted so that the expected tokens of domain k,
   the sum of r_d n_d p_dk over documents, meet its target: least squares by
   projected gradient.  A step needs one distributed sum of a few numbers over
   the stored (tokens, posterior) table; a document's rate is rebuilt from the
   steps, so rates are never stored between them.  The gradient is scaled by the
   damped inverse of the domains' second moments over the documents not at 0.

There is one equation for each domain, of which there are few, and one unknown
for each document; rates start at 1 and move as little as they need to.

Defined results: words are runs of anything but space and \\t-\\r, in lower
case; a document's tokens are its words; a null or empty text has none and rate
1; labels that are null, or differ between rows of one doc_id, are not used;
repeated rows have a rate each; a domain without labels has no posterior, and
its target cannot be met (the least squares of the rest is); without any labels
all rates are 1; an empty table gives no rows; other columns are kept by
``mixed`` and ignored otherwise.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise

BUCKETS = 8192
LEVELS = 12
_STATS = ("marks", "symbols", "capitals", "repeats")


def _read(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, n (words), b (their buckets), s (levels of the four statistics)."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.lower(body), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = docs.select(*keep, F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).alias("_b"),
                    *[F.regexp_count(body, F.lit(x)).alias(f"_{i}") for i, x in enumerate(("!", "[#*$%&|<>]", "[A-Z]"))])
    less = F.greatest(F.size("_b") - 1, F.lit(0))
    same = F.aggregate(F.zip_with(F.slice("_b", F.lit(1), less), F.slice("_b", F.lit(2), less), lambda x, y: (x == y).cast("int")),
                       F.lit(0), lambda a, x: a + x)
    n = F.greatest(F.size("_b"), F.lit(1))
    level = lambda c, full: F.least(F.floor(c * (LEVELS - 1) / (n * full)), F.lit(LEVELS - 1)).cast("int")
    return d.select(*keep, F.size("_b").cast("long").alias("_n"), "_b",
                    _kept(level(F.col("_0"), 1.0), level(F.col("_1"), 3.0), level(F.col("_2"), 5.0), level(same, 1.0)).alias("_s"))


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table: low quality, toxic, or clean."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where(
        "doc_id IS NOT NULL AND domain IS NOT NULL")
    return (rows.groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other"))
            .where("domain = other").select("doc_id", "domain"))


def _numbers(values: np.ndarray) -> Column:
    """A literal array of doubles (one string that the optimizer folds)."""
    return F.split(F.lit(",".join(map(repr, np.asarray(values, float).tolist()))), ",").cast("array<double>")


def _total(table: Column) -> Column:
    """Sum of the table's values at the buckets _b."""
    return F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.get(table, b))


def _kept(*values: Column) -> Column:
    """An array that the optimizer computes once: it would copy the expressions
    of a bare array to each place that takes an item of it."""
    return F.slice(F.array(*values), 1, len(values))


class Classifier:
    """Smoothed counts as log-likelihoods: of words (domain x bucket) and of
    statistics (domain x statistic x level)."""

    def __init__(self, names: list[str], docs: np.ndarray, words: np.ndarray, stats: np.ndarray, temper: float):
        self.names, self.temper = names, temper
        self.prior = np.log(docs / docs.sum())
        w, s = words + 0.5, stats + 0.5
        self.words = np.log(w / w.sum(1, keepdims=True))
        self.stats = np.log(s / s.sum(2, keepdims=True))

    def posterior(self) -> Column:
        """Probabilities of the domains, from columns _n, _b and _s."""
        share = F.lit(float(self.temper)) / F.greatest(F.col("_n"), F.lit(1))
        logs = [F.lit(float(self.prior[0]))]
        flat = (self.stats - self.stats[:1]).reshape(len(self.names), -1)
        for j in range(1, len(self.names)):          # relative to the first domain
            mean = _total(_numbers(self.words[j] - self.words[0])) * share
            levels = [F.get(_numbers(flat[j]), F.get("_s", F.lit(i)) + i * LEVELS) for i in range(len(_STATS))]
            logs.append(F.lit(float(self.prior[j])) + mean + reduce(lambda a, b: a + b, levels))
        return _kept(*logs)


def _softmax(d: DataFrame, k: int) -> DataFrame:
    """Column _p: softmax of column _l."""
    d = d.withColumn("_m", F.array_max("_l"))
    d = d.withColumn("_e", _kept(*[F.exp(F.col("_l")[j] - F.col("_m")) for j in range(k)]))
    total = reduce(lambda a, b: a + b, [F.col("_e")[j] for j in range(k)])
    return d.withColumn("_p", _kept(*[F.col("_e")[j] / total for j in range(k)])).drop("_l", "_m", "_e")


def train(docs: DataFrame, labelled: DataFrame, sample: int = 20_000, temper: float = 40.0) -> Classifier | None:
    """Fit on about ``sample`` labelled documents of each domain at most, those
    of smallest hash of doc_id."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = keyed.select("doc_id").where("doc_id IS NOT NULL").distinct().join(labelled, "doc_id")
    size = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    if not size:
        return None
    names = sorted(size)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    keep = reduce(lambda a, b: a | b, [(F.col("domain") == x) & (place < int(min(1.0, sample / size[x]) * (1 << 30))) for x in names])
    rows = _read(keyed.join(known.where(keep), "doc_id"), "text", ["domain"])
    units = F.concat(F.transform("_b", lambda b: b), F.transform("_s", lambda v, i: BUCKETS + i * LEVELS + v))
    # explode_outer: explode would have the words read twice, for a filter on their number
    counts = rows.select("domain", F.explode_outer(units).alias("unit")).groupBy("domain", "unit").count().collect()
    words, stats = np.zeros((len(names), BUCKETS)), np.zeros((len(names), len(_STATS) * LEVELS))
    for r in counts:             # domains x (buckets + levels) rows at any input
        row = names.index(r.domain)
        if r.unit < BUCKETS:
            words[row, r.unit] = r["count"]
        else:
            stats[row, r.unit - BUCKETS] = r["count"]
    return Classifier(names, np.array([size[x] for x in names], float), words, stats.reshape(len(names), len(_STATS), LEVELS), temper)


def _rate(steps: list[np.ndarray], n: str = "_n", p: str = "_p") -> Column:
    """The rate after the steps: r <- max(0, r - n p.v), from 1."""
    r = F.lit(1.0)
    for v in steps:
        move = reduce(lambda a, b: a + b, [F.col(p)[j] * float(x) for j, x in enumerate(v)])
        r = F.greatest(F.lit(0.0), r - F.col(n) * move)
    return r


class Steps(list):
    """The steps taken, and the largest miss of a target they leave, as a share
    of all tokens."""
    residual = 0.0


def fit_rates(table: DataFrame, target: np.ndarray, steps: int = 40, tolerance: float = 1e-6) -> Steps:
    """Projected-gradient steps over the stored table (_n, _p) until the
    expected totals meet ``target`` (a share of all tokens for each domain), or
    ``steps`` are taken; their ``residual`` says what is missed."""
    k = len(target)
    x = [F.col("_n") * F.col("_p")[j] for j in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(taken: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
        r = F.col("_r")
        row = (table.select("_n", "_p", _rate(taken).alias("_r"))
               .agg(*[F.sum(r * c) for c in x], *[F.sum(F.when(r > 0, x[i] * x[j]).otherwise(0.0)) for i, j in pairs], F.sum("_n")).first())
        values = np.array([v or 0.0 for v in row], float)
        moments = np.zeros((k, k))
        for (i, j), v in zip(pairs, values[k:]):
            moments[i, j] = moments[j, i] = v
        return values[:k], moments, float(values[-1])

    taken = Steps()
    totals, moments, tokens = sums(taken)
    goal = np.asarray(target, float) * tokens
    # damping turns the scaled step into a short plain gradient step, which never fails
    damping, least = 0.0, 1e-3 * max(np.trace(moments) / k, 1e-300)
    for _ in range(steps):
        if np.abs(totals - goal).max() <= tolerance * max(tokens, 1.0):
            break
        scale = np.linalg.pinv(moments + damping * np.eye(k), rcond=1e-12, hermitian=True)
        after = sums([*taken, v := scale @ (totals - goal)])
        if np.linalg.norm(after[0] - goal) < np.linalg.norm(totals - goal) * (1 - 1e-9):
            taken.append(v)
            (totals, moments, _), damping = after, damping / 10
        else:
            damping = max(10 * damping, least)
    taken.residual = float(np.abs(totals - goal).max() / max(tokens, 1.0))
    return taken


def _goal(names: list[str], target: dict[str, float]) -> np.ndarray:
    total = sum(target.values())
    return np.array([target.get(x, 0.0) / total for x in names])


def rates(docs: DataFrame, labels: DataFrame, target: dict[str, float], sample: int = 20_000) -> DataFrame:
    """Per row: doc_id, n_tokens, domains (names), posterior, rate, and residual:
    the largest miss of a target by all rates, as a share of all tokens."""
    table, model, steps = _fit(docs, labels, target, sample)
    names = F.array(*[F.lit(x) for x in (model.names if model else [])]).cast("array<string>")
    return table.select("doc_id", F.col("_n").alias("n_tokens"), names.alias("domains"), F.col("_p").alias("posterior"),
                        _rate(steps).alias("rate"), F.lit(steps.residual).alias("residual"))


def _fit(docs: DataFrame, labels: DataFrame, target: dict[str, float], sample: int):
    model = train(docs, domains(labels), sample)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        empty = _read(keyed, "text", ["doc_id"]).select("doc_id", "_n", F.array().cast("array<double>").alias("_p"))
        return materialise(empty, "posteriors"), None, Steps()
    rows = _read(keyed, "text", ["doc_id"]).select("doc_id", "_n", model.posterior().alias("_l"))
    table = materialise(_softmax(rows, len(model.names)), "posteriors")
    return table, model, fit_rates(table, _goal(model.names, target))


def mixed(docs: DataFrame, labels: DataFrame, target: dict[str, float], sample: int = 20_000) -> DataFrame:
    """The documents at their rates, all columns kept: each row comes
    floor(rate + u) times, u a uniform hash of the row's doc_id and text."""
    _table, model, steps = _fit(docs, labels, target, sample)
    if model is None:
        return docs
    # the columns ride along under one name, so that none can clash
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    rows = _read(whole, "_text", ["_row"]).select("_row", "_n", model.posterior().alias("_l"))
    u = F.pmod(F.xxhash64("_row.doc_id", "_row.text"), F.lit(1 << 40)) / float(1 << 40)
    copies = F.floor(_rate(steps) + u).cast("int")
    # explode_outer and a filter above it, for a filter below would compute the rates again
    return (_softmax(rows, len(model.names)).select("_row", F.explode_outer(F.array_repeat(F.lit(True), copies)).alias("_c"))
            .where("_c").select("_row.*"))

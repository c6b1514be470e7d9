"""Quality classifier by Bradley-Terry pairwise ranking (operator 4).

A document's worth is a linear function of text statistics.  Preference pairs
(a labelled-good row against a labelled-bad one) follow the Bradley-Terry
model: P(good beats bad) = 1 / (1 + exp(-w . (x_good - x_bad))); ``w`` is the
ridge-penalised maximum likelihood over the pairs' feature differences.  The
cut is a quantile of the worth of *all* documents: of ``levels`` quantiles the
one that separates the labelled training rows best.  Scores are worth relative
to the cut, on a logistic scale on which the cut is 0.7.

Only ``w`` is fitted on a bounded sample (``sample`` labelled rows of each
label, those of smallest hash); quantiles and their choice use every row.

Defined results: every row gets a score, a null or empty text that of no
words; labels that are null, or differ between rows of one doc_id, are not
used; rows that repeat a doc_id are scored one by one.  Without both labels
every score is 0.7 (nothing is rejected).  Empty tables give no rows; other
columns are ignored (or kept, by ``accepted``).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .tables import materialise

THRESHOLD = 0.7
FEATURES = ("words", "word_bytes", "upper", "digits", "exclaims", "pipes", "symbols", "points", "other_marks",
            "same_as_before", "distinct", "line_breaks", "non_ascii", "long_words")


def _classes() -> np.ndarray:
    """Class of each byte: the index of the feature that counts it, or 31."""
    t = np.full(256, 31, np.uint8)
    for chars, name in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), (b"0123456789", "digits"), (b"!", "exclaims"),
                        (b"|", "pipes"), (b"#*$%&<>", "symbols"), (b".,;:?", "points"),
                        (b"\"'()+-/=@[\\]^_`{}~", "other_marks"), (b"\n", "line_breaks")):
        t[list(chars)] = FEATURES.index(name)
    t[128:] = FEATURES.index("non_ascii")
    return t


_CLASS = _classes()


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(column), len(FEATURES)))
    at = {name: i for i, name in enumerate(FEATURES)}
    for lo, hi, raw, off in W.slices(column):
        w = W.segment(raw, off)
        size, n = np.diff(off), hi - lo
        doc = np.repeat(np.arange(n), size)
        x = np.bincount(doc * 32 + _CLASS[raw], minlength=n * 32).reshape(n, 32)[:, :len(FEATURES)].astype(float)
        words = w.counts.astype(float)
        per = 1 / np.maximum(words, 1)
        h = w.hashes()
        own = np.repeat(np.arange(n), w.counts)
        length = w.end - w.start
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
        distinct = np.bincount(w.doc_of(np.unique(W.mix(h ^ W.mix(own.astype(np.uint64))), return_index=True)[1]), minlength=n)
        x[:, at["same_as_before"]] = np.bincount(own, weights=same, minlength=n)
        x[:, at["long_words"]] = np.bincount(own, weights=length > 25, minlength=n)
        x = np.sqrt(x * per[:, None])                    # shares of words, spread out near 0
        x[:, at["words"]] = np.log1p(words)
        x[:, at["word_bytes"]] = np.log1p(np.bincount(own, weights=length, minlength=n) * per)
        x[:, at["distinct"]] = np.sqrt(distinct * per)
        out[lo:hi] = x
    return out


def _feature_array(texts: pa.Array) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(features(texts).reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))


def _with_features(docs: DataFrame, name: str) -> DataFrame:
    def job(batches):
        for b in batches:
            yield b.append_column(name, _feature_array(b["text"]))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(job, schema)


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = 200_000, ridge: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Weights of the worth, by Newton steps on the mean logistic loss of
    feature differences.  Each row takes part in about equally many pairs."""
    n = max(len(good), len(bad), min(pairs, len(good) * len(bad)))
    r = np.random.default_rng(4)
    draw = lambda k: np.concatenate([r.permutation(k) for _ in range(-(-n // k))])[:n]
    d = good[draw(len(good))] - bad[draw(len(bad))]
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))             # P(the pair is the other way round)
        gradient = -(d * p[:, None]).mean(0) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): one row for each doc_id with one known label."""
    return (labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo = hi")
            .select("doc_id", F.col("lo").cast("int").alias("label")))


def held_out(mod: int, left: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) == left, F.lit(False))


def bounded_sample(rows: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows of each label at most, chosen by hash of doc_id."""
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect() if r.label in (0, 1)}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    keep = F.lit(False)
    for label, n in counts.items():
        keep |= (F.col("label") == label) & (place < int(min(1.0, bound / n) * (1 << 30)))
    return rows.where(keep)


class Quality:
    """A fitted worth: ``score(features)`` is 0.7 at the cut."""

    def __init__(self, weights: np.ndarray, cut: float, scale: float):
        self.weights, self.cut, self.scale = weights, cut, scale

    def worth(self, x: str) -> Column:
        return sum((F.col(x)[i] * float(w) for i, w in enumerate(self.weights)), F.lit(0.0))

    def score(self, x: str) -> Column:
        z = (self.worth(x) - self.cut) * self.scale + float(np.log(THRESHOLD / (1 - THRESHOLD)))
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def fit(table: DataFrame, labels: DataFrame, sample: int = 20_000, levels: int = 400) -> Quality | None:
    """``table``: (doc_id, held_out, x) of all documents; ``labels``: (doc_id, label)."""
    train = table.where("NOT held_out").join(labels, "doc_id").select("doc_id", "x", "label")
    rows = bounded_sample(train, sample).select("x", "label").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = rows["label"].to_numpy()
    if not ((y == 1).any() and (y == 0).any()):
        return None
    unit = x.std(0) + 1e-3
    weights = bradley_terry(x[y == 1] / unit, x[y == 0] / unit) / unit
    worth = Quality(weights, 0.0, 1.0).worth("x")
    at = [(i + 0.5) / levels for i in range(levels)]
    cuts = table.agg(F.percentile_approx(worth, at, 20_000).alias("q")).first().q
    # labelled training rows between neighbouring quantiles
    bins = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col("worth")))
    counts = np.zeros((levels + 1, 2))
    for r in train.select("label", worth.alias("worth")).groupBy("label", bins.alias("bin")).count().collect():
        if r.label in (0, 1):
            counts[r.bin, r.label] = r["count"]
    below = np.cumsum(counts, 0)[:-1] / np.maximum(counts.sum(0), 1)      # shares under each quantile
    gain = below[:, 0] - below[:, 1]
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    cut = (cuts[best[0]] + cuts[best[-1]]) / 2
    return Quality(weights, float(cut), 1.0)


def _fit_on(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, Quality | None]:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = materialise(_with_features(base, "x").select("doc_id", held_out(4, 2).alias("held_out"), "x"), "quality-features")
    return table, fit(table, clean_labels(labels, "quality"), sample)


def scored(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    table, model = _fit_on(docs, labels, sample)
    score = model.score("x") if model else F.lit(THRESHOLD)
    return table.select("doc_id", "held_out", score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """The documents scored 0.7 or more, with all their columns."""
    _table, model = _fit_on(docs, labels, sample)
    if model is None:
        return docs
    name = "x"
    while name in docs.columns:
        name += "_"
    return _with_features(docs, name).where(model.score(name) >= THRESHOLD).drop(name)

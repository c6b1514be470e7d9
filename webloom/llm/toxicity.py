"""Toxic passages by maximum-scoring segment search (operator 8).

1. Words of labelled training documents are counted once per document, by
   label.  A word's log-odds has a Dirichlet prior centred on its 4-byte
   prefix, a prefix's one centred on all words, so that rare words lean on
   their family and chance words on nothing.  All words and prefixes whose log-odds
   are ``least`` and ``z`` standard errors or more form the lexicon.
2. Every word of every text scores its log-odds, words outside the lexicon a
   little less than 0 (what their absence from toxic text says).  A linear scan
   finds all maximal-scoring segments (Ruzzo and Tompa, 1999): disjoint
   passages that no extension improves.
3. Extreme-value calibration (Karlin and Altschul): by chance a text of n words
   has K n exp(-lambda S) passages of score S or more; lambda solves
   E[exp(lambda s)] = 1 over clean words, K is counted on clean training
   documents.  A passage is significant below ``expect``; a document's evidence
   is the sum of -ln E of its significant passages.
4. Scores are evidence on a logistic scale, 0.7 at the cut that tells labelled
   training documents apart best.

Prior strength, ``z`` and ``least`` are chosen from ``GRID`` by cross-validation: the labelled
training documents fall into ``FOLDS`` folds by a hash of their text, and each is scanned
with lexicons counted without its fold.  The cut is taken from the same evidence, as that of a
lexicon on its own documents would be too high for others.

The lexicon is fitted on a bounded sample (``sample`` training rows of each
label, of smallest hash), whose words bound its size; all else covers every row.

Defined results: words are runs of ASCII letters, digits and non-ASCII bytes,
A-Z lower-cased; a null or empty text has no passage; labels that are null, or
differ between rows of one doc_id, are not used; rows that repeat a doc_id are
scored one by one.  Without both labels no text is toxic.  Empty tables give no
rows; other columns are ignored.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .quality import THRESHOLD, bounded_sample, clean_labels, held_out
from .tables import materialise

PREFIX_BYTES = 4
FOLDS = 3
#: (prior strength, least z, least log-odds) to choose from; of equal ones the last is taken.
GRID = tuple((strength, z, least) for strength in (1.0, 5.0) for z, least in ((2.5, 1.5), (3.5, 2.0), (4.5, 3.0)))


def units(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and of its first bytes."""
    pre = W.prefix(w.data, W.BYTES_A)
    short = np.minimum(w.end, w.start + PREFIX_BYTES)
    return (W.spans_hash(pre, w.start, w.end, W.BYTES_A),
            W.mix(W.spans_hash(pre, w.start, short, W.BYTES_A) + np.uint64(1)))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, prefix, fold, toxic, clean): documents of a fold that hold each word, by label."""
    def job(batches):
        for b in batches:
            labels, folds = b["label"].to_numpy(), b["fold"].to_numpy()
            for lo, hi, raw, off in W.slices(b["text"]):
                w = W.segment(raw, off, W.LETTERS)
                h, p = units(w)
                own = np.repeat(np.arange(hi - lo), w.counts)
                once = np.unique(W.mix(h ^ W.mix(own.astype(np.uint64))), return_index=True)[1]
                h, p, toxic, fold = h[once], p[once], labels[lo:hi][own[once]] == 1, folds[lo:hi][own[once]]
                for f in np.unique(fold).tolist():
                    mine = fold == f
                    u, first, inverse = np.unique(h[mine], return_index=True, return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(W.as_long(u)), pa.array(W.as_long(p[mine][first])), pa.array(np.full(len(u), f, np.int32)),
                         pa.array(np.bincount(inverse, weights=toxic[mine], minlength=len(u)).astype(np.int64)),
                         pa.array(np.bincount(inverse, weights=~toxic[mine], minlength=len(u)).astype(np.int64))],
                        ["word", "prefix", "fold", "toxic", "clean"])
    return (train.select("text", "label", "fold")
            .mapInArrow(job, "word long, prefix long, fold int, toxic long, clean long")
            .groupBy("word", "prefix", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


@dataclass
class Lexicon:
    keys: np.ndarray      # sorted hashes of words and prefixes
    score: np.ndarray     # log-odds
    rate: np.ndarray      # smoothed share of clean words
    drift: float          # score of any other word

    def scores(self, word: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Positive scores of lexicon words, 0 for the rest: the word's own
        entry, else its prefix's."""
        return np.where((own := self._of(word)) > 0, own, self._of(prefix))

    def _of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.score[at], 0.0)

    def decay(self) -> float:
        """The lambda of extreme-value statistics: E[exp(lambda s)] = 1."""
        rest = max(1 - self.rate.sum(), 0.0)

        def excess(x):
            return float((self.rate * np.exp(np.minimum(x * self.score, 600))).sum() + rest * math.exp(-x * self.drift) - 1)
        lo, hi = 1e-6, 1.0
        while excess(hi) < 0 and hi < 64:
            hi *= 2
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
        return (lo + hi) / 2


def learn_lexicons(counts: DataFrame, grid=GRID) -> list[list[Lexicon]]:
    """For each fold, and last for none, the lexicons of the grid counted without it.

    Log-odds with Dirichlet priors, on Spark in one job; what passes the loosest entry comes back."""
    views = counts.withColumn("view", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(FOLDS)), lambda v: v != F.col("fold"))))
    views = (views.groupBy("view", "word", "prefix").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    totals = views.groupBy("view").agg(F.greatest(F.sum("toxic"), F.lit(1)).alias("t"), F.greatest(F.sum("clean"), F.lit(1)).alias("c"))
    strength, everywhere = F.col("strength"), F.col("t") / (F.col("t") + F.col("c"))

    def scored(rows: DataFrame, share) -> DataFrame:
        rows = rows.join(F.broadcast(totals), "view").withColumn("strength", F.explode(F.array(*[F.lit(x) for x in sorted({g[0] for g in grid})])))
        a, b = F.col("toxic") + strength * share, F.col("clean") + strength * (1 - share)
        odds = F.log(a / b) - F.log(F.col("t") / F.col("c"))
        return rows.select("view", "strength", "key", "prefix", odds.alias("odds"), (b / F.col("c")).alias("rate"), "toxic", "t",
                           (odds / F.sqrt(1 / a + 1 / b)).alias("z"))

    prefixes = views.groupBy("view", "prefix").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    families = scored(prefixes.withColumn("key", F.col("prefix")), everywhere)
    # a word's prior: the share of its family without the word itself
    family = prefixes.select("view", "prefix", F.col("toxic").alias("ft"), F.col("clean").alias("fc"))
    own = views.where("toxic > 0").join(family, ["view", "prefix"]).withColumn("key", F.col("word"))
    share = ((F.col("ft") - F.col("toxic") + strength * everywhere)
             / (F.col("ft") - F.col("toxic") + F.col("fc") - F.col("clean") + strength))
    found = (scored(own, share).unionByName(families)
             .where((F.col("z") >= min(g[1] for g in grid)) & (F.col("odds") >= min(g[2] for g in grid))).toPandas())
    out = []
    for view in range(FOLDS + 1):
        of_view = found[found["view"] == view]
        out.append([_lexicon(of_view[(of_view["strength"] == s) & (of_view["z"] >= z) & (of_view["odds"] >= least)])
                    for s, z, least in grid])
    return out


def _lexicon(rows) -> Lexicon:
    keys, score = rows["key"].to_numpy(np.int64).view(np.uint64), np.minimum(rows["odds"].to_numpy(np.float64), 8.0)
    order = np.argsort(keys)
    # what one word outside the lexicon says: its share among toxic against clean words
    # (a word whose family has an entry is counted with it)
    families = rows["prefix"][rows["key"] == rows["prefix"]]
    once = rows["toxic"][(rows["key"] == rows["prefix"]) | ~rows["prefix"].isin(families)]
    share_t = min(float(once.sum()) / float(rows["t"].iloc[0]), 0.9) if len(rows) else 0.0
    return Lexicon(keys[order], score[order], np.minimum(rows["rate"].to_numpy(np.float64)[order], 1e-2),
                   max(-math.log1p(-share_t), 1e-3))


def maximal_segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, word after the last, score) of
    a text whose words score ``score`` at the places ``at`` and -drift elsewhere.
    One pass; a stack of candidates with the sums left and right of each."""
    out: list[tuple[int, int, float, float]] = []    # begin, end, sum before, sum after
    total, last = 0.0, 0
    for p, s in zip(at, score):
        total -= drift * (p - last)
        begin, before = p, total
        total += s
        last = p + 1
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= before:
                j -= 1
            if j < 0 or out[j][3] >= total:
                out.append((begin, last, before, total))
                break
            begin, before = out[j][0], out[j][2]
            del out[j:]
    return [(b, e, r - q) for b, e, q, r in out]


_SCAN = ("doc_id long, held_out boolean, label int, entry int, view int, n_words long, "
         "passages array<struct<first:int,last:int,score:double>>")


def scan(docs: DataFrame, lexicons: list[list[Lexicon]]) -> DataFrame:
    """Every maximal-scoring passage of every text, by each lexicon (``entry``) of the row's ``view``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def job(batches):
        for b in batches:
            views = b["view"].to_numpy()
            for lo, hi, raw, off in W.slices(b["text"]):
                w = W.segment(raw, off, W.LETTERS)
                word, prefix = units(w)
                own = np.repeat(np.arange(hi - lo), w.counts)
                for view in np.unique(views[lo:hi]).tolist():
                    rows = np.flatnonzero(views[lo:hi] == view)
                    mine = np.flatnonzero((views[lo:hi] == view)[own])
                    for entry, lex in enumerate(shared.value[view]):
                        s = lex.scores(word[mine], prefix[mine])
                        k, s = mine[s > 0], s[s > 0]
                        cut, found = np.searchsorted(own[k], np.arange(hi - lo + 1)), {}
                        for d in np.unique(own[k]).tolist():
                            p = slice(cut[d], cut[d + 1])
                            found[d] = [{"first": x, "last": y, "score": z} for x, y, z in
                                        maximal_segments((k[p] - w.first[d]).tolist(), s[p].tolist(), lex.drift)]
                        at = pa.array(lo + rows)
                        yield pa.RecordBatch.from_arrays(
                            [b["doc_id"].take(at), b["held_out"].take(at), b["label"].take(at),
                             pa.array(np.full(len(rows), entry, np.int32)), b["view"].take(at),
                             pa.array(w.counts[rows].astype(np.int64)), pa.array([found.get(d, []) for d in rows.tolist()], kind)],
                            ["doc_id", "held_out", "label", "entry", "view", "n_words", "passages"])
    return docs.select("doc_id", "held_out", "label", "view", "text").mapInArrow(job, _SCAN)


def with_evidence(table: DataFrame, labelled: DataFrame, lexicons: list[list[Lexicon]], expect: float) -> DataFrame:
    """Scanned rows with their significant passages only, and ``evidence``.

    K is counted on the clean ones of ``labelled`` scanned training rows of each entry, above the
    least score of a word (a count, which a few wrong labels move little)."""
    spark = table.sparkSession
    known = spark.createDataFrame(
        [(v, e, lex.decay(), float(lex.score.min()) if len(lex.score) else 1.0) for v, entries in enumerate(lexicons)
         for e, lex in enumerate(entries)], "view int, entry int, decay double, least double")
    known = F.broadcast(known)                                        # one row a lexicon
    table, labelled = table.join(known, ["view", "entry"]), labelled.join(known, ["view", "entry"])
    seen = F.size(F.filter("passages", lambda p: p.score >= F.col("least") - 1e-9))
    clean = {r.entry: r for r in labelled.where("label = 0").groupBy("entry").agg(
        F.sum("n_words").alias("n"), F.sum(seen).alias("e")).collect()}
    rate = F.lit(1.0)
    for e, r in clean.items():
        rate = F.when(F.col("entry") == e, max(r.e or 0, 1) / max(r.n or 0, 1)).otherwise(rate)
    k = rate * F.exp(F.least(F.col("decay") * F.col("least"), F.lit(600.0)))
    chance = lambda p: F.log(k * F.greatest(F.col("n_words"), F.lit(1))) - p.score * F.col("decay")
    real = table.withColumn("passages", F.filter("passages", lambda p: chance(p) <= math.log(expect)))
    return real.withColumn("evidence", F.aggregate("passages", F.lit(0.0), lambda a, p: a - chance(p)))


_STEP, _FINE = 0.25, 4000


def _bin(evidence):
    """A step of evidence; above ``_FINE`` steps, sixteenths of a doubling."""
    steps = evidence / _STEP
    return F.when(steps < _FINE, F.floor(steps)).otherwise(F.floor(_FINE + 16 * F.log2(steps / _FINE))).cast("int")


def _edge(b: float) -> float:
    return b * _STEP if b <= _FINE else _FINE * _STEP * 2 ** ((b - _FINE) / 16)


def best_cuts(marked: DataFrame) -> dict[int, tuple[float, float]]:
    """For each entry: (share of toxic less share of clean rows at or above the cut, cut), from the
    counts of all rows by bin of evidence.  Of equally good cuts the lowest: it misses least."""
    seen = marked.groupBy("entry", "label", _bin(F.col("evidence")).alias("bin")).count().toPandas()
    out = {}
    for entry, rows in seen.groupby("entry"):
        hist = np.zeros((int(rows["bin"].max()) + 2, 2))
        np.add.at(hist, (rows["bin"].to_numpy(), rows["label"].to_numpy()), rows["count"].to_numpy())
        if hist.sum(0).all():
            share = (np.cumsum(hist[::-1], 0)[::-1] / hist.sum(0))[1:]     # a text without evidence is never toxic
            g = share[:, 1] - share[:, 0]
            out[entry] = float(g.max()), _edge(float(np.flatnonzero(g >= g.max() - 1e-9)[0] + 1))
    return out


def scored(docs: DataFrame, labels: DataFrame, sample: int = 20_000, grid=GRID, expect: float = 0.05) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, n_passages, passages."""
    base = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(3, 1)))
    truth = clean_labels(labels, "toxic").select("doc_id", F.col("label").cast("int").alias("label")).where("label IN (0, 1)")
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    train = materialise(base.where("NOT held_out").join(truth, "doc_id").withColumn("fold", fold), "labelled")
    # copies of one text count once: they are one piece of evidence
    rows = bounded_sample(train, sample).withColumn("th", F.xxhash64("text")).dropDuplicates(["th"])
    lexicons = learn_lexicons(materialise(word_counts(rows), "word-counts"), grid)
    tried = materialise(scan(train.withColumn("view", F.col("fold")), lexicons), "tried")
    cuts = best_cuts(with_evidence(tried, tried, lexicons, expect))
    if not cuts:
        best, cut = 0, math.inf
    else:
        best = max(cuts, key=lambda e: (round(cuts[e][0], 9), e))
        cut = cuts[best][1]
    chosen = [[entries[best]] for entries in lexicons]
    whole = base.withColumn("label", F.lit(None).cast("int")).withColumn("view", F.lit(FOLDS))
    table = materialise(scan(whole, chosen), "toxic-passages")
    marked = with_evidence(table, table.where("NOT held_out").drop("label").join(truth, "doc_id"), chosen, expect)
    if math.isinf(cut):
        score = F.lit(0.0)
    else:
        x = (F.col("evidence") - cut) / max(cut, 1.0) * 4 + math.log(THRESHOLD / (1 - THRESHOLD))
        score = 1 / (1 + F.exp(-F.least(x, F.lit(30.0))))
    return marked.withColumn("score", score).select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"), "passages")

"""Resampling towards a target distribution (operator 13).

Documents are drawn without replacement with probabilities proportional to how
much likelier their word n-grams are in the target texts than in the corpus.
Adding independent Gumbel noise to log weights and taking the highest sums is
such a draw.

1. Features are runs of one to three words, hashed into 10,000 buckets by CRC-32.
   One pass over the corpus and one over the target texts count the buckets.
2. The bucket's log ratio is a table of 10,000 integers; a second pass adds up the
   table's entries for each document, whole slices of texts at a time, and the
   scores are written with their rows.
3. The cutoff is bisected over the written scores: each job counts exactly how
   many rows reach the thresholds that the next halvings could ask for.  Rows
   tied at the cutoff are bisected by doc_id, rows that repeat it by their place.
4. Selected rows are range-partitioned in order, written and numbered from
   the partitions' counts; all others pass by without an exchange.

CRC-32 is linear: the checksum of two joined strings is the first's, moved over
the second's length, xor the second's.  Checksums of n-grams are therefore
put together from those of words by table lookups.

Defined results: a null text has no words, weight 0 and is never drawn; a null
doc_id draws its noise like an empty one and comes before all others; rows that repeat
a doc_id are documents of their own; an empty table gives no rows, empty target
texts a ratio of counts with none; other columns are ignored, whatever their names.
"""
from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from . import words as W
from .tables import materialise

BUCKETS = 10_000
_SHORT = 64                 # words up to this many bytes are looked up by their length
_HALVINGS = 3               # halvings answered by one job


# ---------------------------------------------------------------- checksums of joined words
def _advance(crc: np.ndarray) -> np.ndarray:
    """A checksum register moved over one zero byte."""
    return _byte_table().take(crc & np.uint32(255)) ^ (crc >> np.uint32(8))


@lru_cache
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1)).astype(np.uint32)
    return t


@lru_cache
def _moves() -> tuple[np.ndarray, list[np.ndarray]]:
    """(tables that move a register over 0 to 65 bytes, flat; the ones over 1, 2, 4, ... bytes).

    A table has 256 entries for each of the register's four bytes."""
    one = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    near = [one]
    for _ in range(_SHORT + 1):
        near.append(_advance(near[-1]))
    far = [near[1]]
    for _ in range(40):
        far.append(_move(far[-1], far[-1]))
    return np.concatenate(near), far


def _move(table: np.ndarray, crc: np.ndarray, at=0) -> np.ndarray:
    """Registers moved by a table (the one that begins at ``at``, where tables are laid end to end)."""
    byte = np.uint32(255)
    return (table.take(at + (crc & byte)) ^ table.take(at + 256 + (crc >> np.uint32(8) & byte))
            ^ table.take(at + 512 + (crc >> np.uint32(16) & byte)) ^ table.take(at + 768 + (crc >> np.uint32(24))))


def moved(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums moved over ``size`` bytes each."""
    near, far = _moves()
    out = _move(near, crc, np.minimum(size, _SHORT + 1) * 1024)
    long = np.flatnonzero(size > _SHORT + 1)
    if len(long):
        c, rest = crc[long], size[long]
        for k in range(int(rest.max()).bit_length()):
            on = np.flatnonzero(rest >> k & 1)
            c[on] = _move(far[k], c[on])
        out[long] = c
    return out


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each word [start, end) of the bytes."""
    size = end - start
    by = np.argsort(np.minimum(size, _SHORT + 1).astype(np.uint8), kind="stable")[::-1]   # longest first
    sizes, at = size[by], start[by]
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    table = _byte_table()
    counts = np.searchsorted(-sizes, -np.arange(1, min(int(sizes[0]), _SHORT) + 1), "right") if len(sizes) else []
    for k, m in enumerate(np.asarray(counts).tolist()):     # the m words that have a byte k
        c = crc[:m]
        crc[:m] = table.take((c ^ data.take(at[:m] + k)) & np.uint32(255)) ^ (c >> np.uint32(8))
    out = np.empty_like(crc)
    out[by] = ~crc
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = zlib.crc32(data[start[i]:end[i]])
    return out


def feature_buckets(w: W.Words, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word at which it starts, bucket) of all features of one, two and three words."""
    size = (w.end - w.start) + 1
    crc = word_crcs(w.data, w.start, w.end)
    spaced = moved(np.full(len(crc), zlib.crc32(b" "), np.uint32), size - 1) ^ crc      # of " word"
    two, three = w.starts_of(2), w.starts_of(3)
    pairs = np.zeros(len(crc), np.uint32)
    pairs[two] = moved(crc[two], size[two + 1]) ^ spaced[two + 1]
    triples = moved(pairs[three], size[three + 2]) ^ spaced[three + 2]
    out = [(np.arange(len(crc)), crc), (two, pairs[two]), (three, triples)]
    return [(at, (c % np.uint32(buckets)).astype(np.int64)) for at, c in out]


# ---------------------------------------------------------------- counts and weights
def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; one row a bucket reaches the driver."""
    def job(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _lo, _hi, raw, off in W.slices(b["text"]):
                for _at, bucket in feature_buckets(W.segment(raw, off, W.LETTERS), buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
    rows = (texts.select("text").mapInArrow(job, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of the smoothed ratio of shares, rounded down, for each bucket."""
    k, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (all_s + k)) / ((s + 1) * (all_t + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times a Gumbel draw that the id decides, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    u = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row."""
    def job(batches):
        for b in batches:
            for lo, hi, raw, off in W.slices(b["text"]):
                w = W.segment(raw, off, W.LETTERS)
                each = np.zeros(len(w.start) + 1, np.int64)       # what the features that start at a word are worth
                for at, bucket in feature_buckets(w, len(gain)):
                    each[at + 1] += gain.take(bucket)
                upto, n = np.cumsum(each), w.counts.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(lo, hi - lo), pa.array(n),
                     pa.array(n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)),
                     pa.array(upto[w.first[1:]] - upto[w.first[:-1]])],
                    ["doc_id", "n_words", "n_features", "weight"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(job, "doc_id long, n_words long, n_features long, weight long"))


# ---------------------------------------------------------------- the draw
def least_reaching(rows: DataFrame, key: Column, need: int) -> tuple[int, int]:
    """(least v for which at least ``need`` rows have key <= v, rows with key < v), by bisection.

    A job counts the rows up to each of the thresholds that ``_HALVINGS`` halvings could ask for."""
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi, below = ends.lo, ends.hi, 0
    while lo < hi:
        parts = 1 << _HALVINGS
        probes = sorted({lo + (hi - lo) * i // parts for i in range(1, parts)})
        inside = rows.where((key >= F.lit(lo)) & (key < F.lit(hi)))
        passed = 0
        for p, n in zip(probes, inside.agg(*[F.count_if(key <= F.lit(p)) for p in probes]).first()):
            if below + n >= need:
                hi = p
                break
            lo, passed = p + 1, n
        below += passed
    return lo, below


def drawn(scored: DataFrame, need: int) -> Column:
    """Whether a row is among the ``need`` highest scores, ties to the smaller doc_id."""
    rows, chosen, all_ties = scored, F.lit(False), F.lit(True)
    for key in (-F.col("score"), F.col("doc_key"), F.col("row_at")):
        v, below = least_reaching(rows, key, need)
        chosen = chosen | (all_ties & (key < F.lit(v)))
        all_ties, rows, need = all_ties & (key == F.lit(v)), rows.where(key == F.lit(v)), need - below
        if rows.count() == need:
            break
    return chosen | all_ties


def ranked(rows: DataFrame, partitions: int) -> DataFrame:
    """``rows`` with ``rank`` from 1 by score, doc_id and place, over range partitions."""
    order = [F.col("score").desc(), F.col("doc_key"), F.col("row_at")]
    placed = materialise(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
                         .withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33).alias("part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = SparkWindow.orderBy("part").rowsBetween(SparkWindow.unboundedPreceding, -1)
    # one row for each range partition
    bases = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn("part", part).join(F.broadcast(bases), "part")
            .withColumn("rank", F.col("base") + inner + 1).drop("part", "place", "base"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42,
             buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every row of ``docs``.

    ``percent`` of the documents of at least ``min_words`` words are drawn; the others have no rank."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = materialise(
        weights(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
        .withColumn("doc_key", F.coalesce("doc_id", F.lit(-1 << 63)))
        .withColumn("row_at", F.monotonically_increasing_id()), "scored")
    able = F.col("n_words") >= min_words
    need = percent * scored.where(able).count() // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not need:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    chosen = able & drawn(scored.where(able), need)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = scored.where(~chosen).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(scored.where(chosen), n).select(*columns, "rank").unionByName(rest)

"""Benchmark decontamination (operator 1): rare n-gram seeds, then Smith-Waterman.

1. An item's n-grams are all its triples of words in the places (0, 1, 2),
   (0, 1, 3) and (0, 2, 3).  A leak shares at least ``need`` of the item's G (below), so it
   shares one of any G - need + 1 of them.  How often each occurs in the documents is
   counted, and the G - need + 1 rarest are the item's seeds.
2. A document's triples have up to two words between; the words around those
   that are seeds are its passages, and seeds join them to test items.
3. A passage also lists all items' n-grams that it holds.  Pairs of a passage and an
   item with ``need`` in common are aligned word by word (match +2, mismatch -1, gap -1).  The score is the best local alignment's, over
   that of the item with itself: 1 for a verbatim copy, less with each edit.  Pairs of
   ``threshold`` or more are leaks.

An item of fewer than eight words has its whole word sequence as its one seed, and is
found where it stands verbatim; ``min_words`` leaves out items of fewer words than that.

No leak is missed.  Let an alignment match m of an item's L words, leave out E
at the item's ends, and have d words of the item and e of the document between
two matches, which costs max(d, e); v = max(d, e) + d.  As L = m + E + sum d,
a score of 2 m - sum max(d, e) >= L (threshold 0.5) says sum v <= m - E.  Two
neighbouring gaps with v + v' <= 2 have a seed as their three matches (see
_ITEM and _DOC).  All others have v + v' >= 3; the sum of v + v' over the
m - 2 neighbouring gaps is at most 2 (m - E), so that at least
m - 2 - 2 (m - E) / 3 of them are seeds.  As sum d <= sum v / 2, L is at most
(3 m + E) / 2, and so the seeds are at least 2 L / 9 - 2.  For L < 14, at least
one: without any, sum v >= 3 * floor((m - 1) / 2), which leaves m <= 3 (then
L <= 6), m = 4 (L <= 6), or m = 6 and L <= 8, whose one alignment of eight
words has seeds (gaps of one word in the item and two in the document).  The
alignment spans at most m + sum e <= (3 - 2 * threshold) L words of the
document, which is what passages take in on each side of a seed (the seeds of
longer items take in more: there is a filter for each quarter of a doubling).  For thresholds
below 0.5 every single word is an n-gram, and one of them is needed.

Test items and documents meet through shuffled joins; only Bloom filters of
n-grams, sized by counted keys up to a bound, are broadcast, so neither side's size is bounded.

Defined results: words are runs of ASCII letters, digits and non-ASCII bytes,
A-Z lower-cased; null or empty texts and items have none.  Rows that repeat a
doc_id or item_id, or have none, are reported by that id (equal rows once).
Empty tables give no rows; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from . import words as W
from .tables import Bloom, materialise

MATCH, MISMATCH, GAP = 2, -1, -1
SHORT = 8                # items of fewer words are looked up whole
_MOST_BITS = 1 << 27     # bound of a filter; beyond it, more rows pass
_COUNTED = 1 << 17      # occurrences that a task counts at a time
_C = np.uint64(0x9E3779B97F4A7C15)


#: Places of an n-gram's words in an item and in a document, in the order of their first word.
_ITEM = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_DOC = _ITEM + ((0, 2, 4), (0, 1, 4), (0, 3, 4))
_WORD = ((0,),)


def _hash(h: np.ndarray, start: np.ndarray, shape: tuple) -> np.ndarray:
    acc = np.zeros(len(start), np.uint64)
    for i in shape:
        acc = acc * _C + h[start + i]
    return W.as_long(W.mix(acc))


def _grams(w: W.Words, shapes: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each gram, hash of each gram) of all shapes."""
    h = w.hashes()
    starts = [w.starts_of(shape[-1] + 1) for shape in shapes]
    return h, np.concatenate(starts), np.concatenate([_hash(h, at, shape) for at, shape in zip(starts, shapes)])


def _sequence_grams(words: np.ndarray, shapes: tuple) -> np.ndarray:
    """The grams of one sequence of word hashes."""
    h = words.view(np.uint64)
    return np.concatenate([_hash(h, np.arange(max(len(h) - shape[-1], 0)), shape) for shape in shapes])


def _needed(size: int) -> int:
    """How many of its grams a leak of an item of ``size`` words shares at least."""
    return max(-(-2 * size // 9) - 2, 1)


def _whole(size: int) -> tuple:
    return (tuple(range(size)),)


def grams_of_items(texts: DataFrame, shapes: tuple) -> DataFrame:
    """(item_id, th, gram, need, size, times): the grams of all items of ``(item_id, th, item)``."""
    def job(batches):
        for b in batches:
            for i, item in enumerate(b["item"]):
                words = np.asarray(item.values, np.int64)
                if not len(words):
                    continue
                whole = shapes is not _WORD and len(words) < SHORT
                g, n = np.unique(_sequence_grams(words, _whole(len(words)) if whole else shapes), return_counts=True)
                need = 1 if whole or shapes is _WORD else _needed(len(words))
                same = pa.array(np.full(len(g), i))
                yield pa.RecordBatch.from_arrays(
                    [b["item_id"].take(same), b["th"].take(same), pa.array(g), pa.array(np.full(len(g), need)),
                     pa.array(np.full(len(g), len(words))), pa.array(n)], ["item_id", "th", "gram", "need", "size", "times"])
    return texts.mapInArrow(job, "item_id long, th long, gram long, need long, size long, times long")


def gram_counts(docs: DataFrame, bloom: Bloom, shapes: tuple) -> DataFrame:
    """(gram, n): how often the filter's grams (and a few others) occur in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def counted(held):
        u, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["gram", "n"])

    def job(batches):
        bloom, held, size = shared.value, [], 0
        for b in batches:
            for _lo, _hi, raw, off in W.slices(b["text"]):
                g = _grams(W.segment(raw, off, W.LETTERS), shapes)[2]
                if len(g):
                    held.append(g[bloom.has(g)])
                    size += len(held[-1])
                if size >= _COUNTED:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)
    return docs.select("text").mapInArrow(job, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def rarest(marks: DataFrame, counts: DataFrame) -> DataFrame:
    """The item's grams of which a leak shares at least one: the rarest, up to all but ``need`` - 1
    occurrences in the item.  Grams that no document has are among them and need no row."""
    item = SparkWindow.partitionBy("item_id", "th")
    before = F.sum("times").over(item.orderBy("n", "gram").rowsBetween(SparkWindow.unboundedPreceding, -1))
    ranked = (marks.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
              .withColumn("before", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("times").over(item)))
    return ranked.where("before < total - need + 1 AND n > 0").select("item_id", "th", "gram", "size")


def sized(n: int, bits: int | None) -> Bloom:
    """A filter for ``n`` keys."""
    return Bloom(bits or min(1 << max(12, (16 * n - 1).bit_length() if n else 0), _MOST_BITS))


def _passages(docs: DataFrame, filters: list[tuple[int, Bloom]], shapes: tuple, known: Bloom,
              only: Bloom | None = None) -> DataFrame:
    """(doc_id, th, first, seeds, grams) of the words around seed hits (as many on each side as the widest
    filter says that has the seed; overlapping ones together): the seeds, and all grams in ``known``;
    with ``only``, a filter of texts by th, (doc_id, th, first, words) of the same passages of these texts."""
    shared = docs.sparkSession.sparkContext.broadcast((filters, known, only))
    n = max(shape[-1] for shape in shapes) + 1

    def job(batches):
        filters, known, only = shared.value
        for b in batches:
            if only is not None:
                b = b.filter(pa.array(only.has(b["th"].to_numpy())))
            for lo, hi, raw, off in W.slices(b["text"]):
                w = W.segment(raw, off, W.LETTERS)
                h, start, g = _grams(w, shapes)
                # seeds are known grams: their filters are asked about those only
                some = np.flatnonzero(known.has(g)) if len(g) else np.zeros(0, np.int64)
                start, g = start[some], g[some]
                around = np.zeros(len(g), np.int64)
                for width, bloom in filters if len(g) else []:     # narrow to wide
                    around[bloom.has(g)] = width
                k = np.flatnonzero(around)
                if not len(k):
                    continue
                doc = w.doc_of(start[k])
                first = np.maximum(start[k] - around[k], w.first[doc])
                last = np.minimum(start[k] + n + around[k], w.first[doc + 1])
                by = np.argsort(first, kind="stable")
                k, doc, first, last = k[by], doc[by], first[by], np.maximum.accumulate(last[by])
                new = np.ones(len(k), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > last[:-1])
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(k))
                d, first, last = doc[begin], first[begin], last[end - 1]
                columns = [b["doc_id"].slice(lo, hi - lo).take(pa.array(d)), b["th"].slice(lo, hi - lo).take(pa.array(d)),
                           pa.array((first - w.first[d]).astype(np.int32))]
                longs = pa.list_(pa.int64())
                if only is not None:
                    hl = W.as_long(h)
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([hl[p:q] for p, q in zip(first, last)], longs)],
                                                     ["doc_id", "th", "first", "words"])
                    continue
                some = np.argsort(start, kind="stable")
                at = np.searchsorted(start[some], np.stack([first, last]))     # grams that start in the passage
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([np.unique(g[k[p:q]]) for p, q in zip(begin, end)], longs),
                     pa.array([np.unique(g[some[p:q]]) for p, q in at.T], longs)], ["doc_id", "th", "first", "seeds", "grams"])
    out = "seeds array<long>, grams array<long>" if only is None else "words array<long>"
    return docs.mapInArrow(job, f"doc_id long, th long, first int, {out}")


def smith_waterman(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(score, end of the best local alignment in b) for each pair of word
    sequences; all pairs advance together, a word of ``a`` at a time."""
    n, la, lb = len(a), max(map(len, a), default=0), max(map(len, b), default=0)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int32)
    if not la or not lb:
        return best, end
    wa, wb = np.zeros((n, la), np.int64), np.zeros((n, lb), np.int64)
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    for i in range(n):
        wa[i, :len(a[i])], wb[i, :len(b[i])] = a[i], b[i]
    real = np.arange(lb) < size_b[:, None]
    ramp = (np.arange(lb + 1) * -GAP).astype(np.int32)
    row = np.zeros((n, lb + 1), np.int32)
    for i in range(la):
        hit = (wb == wa[:, i:i + 1]) & real & (i < size_a)[:, None]
        new = np.maximum(row[:, :-1] + np.where(hit, MATCH, MISMATCH).astype(np.int32), row[:, 1:] + GAP)
        new = np.concatenate([np.zeros((n, 1), np.int32), np.maximum(new, 0)], 1)
        row = np.maximum.accumulate(new + ramp, 1) - ramp      # gaps along b
        top = np.where(real, row[:, 1:], 0)
        at = top.argmax(1)
        score = top[np.arange(n), at]
        better = score > best
        best[better], end[better] = score[better], at[better] + 1
    return best, end


def _align(threshold: float, whole_if_short: bool, chunk: int = 128):
    def job(batches):
        for b in batches:
            items = [np.asarray(x.values, np.int64) for x in b["item"]]
            passages = [np.asarray(x.values, np.int64) for x in b["words"]]
            order = np.argsort([len(x) for x in passages], kind="stable")
            for at in range(0, len(order), chunk):
                k = order[at:at + chunk]
                a, p = [items[i] for i in k], [passages[i] for i in k]
                score, end = smith_waterman(a, p)
                full = np.array([MATCH * len(x) for x in a])
                least = np.array([1.0 if whole_if_short and len(x) < SHORT else threshold for x in a])
                ok = np.flatnonzero(score >= least * full)
                if not len(ok):
                    continue
                # the beginning: the same alignment read from its end
                back = smith_waterman([a[i][::-1] for i in ok], [p[i][:end[i]][::-1] for i in ok])[1]
                rows = pa.array(k[ok])
                first = b["first"].take(rows).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(rows), b["th"].take(rows), b["item_id"].take(rows), pa.array(score[ok] / full[ok]),
                     pa.array((first + end[ok] - back).astype(np.int64)), pa.array((first + end[ok]).astype(np.int64))],
                    ["doc_id", "th", "item_id", "score", "start_word", "end_word"])
    return job


def _sequences(items: DataFrame) -> DataFrame:
    def job(batches):
        for b in batches:
            for lo, hi, raw, off in W.slices(b["text"]):
                w = W.segment(raw, off, W.LETTERS)
                h = W.as_long(w.hashes())
                yield pa.RecordBatch.from_arrays(
                    [b["item_id"].slice(lo, hi - lo), b["th"].slice(lo, hi - lo),
                     pa.array([h[p:q] for p, q in zip(w.first[:-1], w.first[1:])], pa.list_(pa.int64()))],
                    ["item_id", "th", "item"])
    return items.mapInArrow(job, "item_id long, th long, item array<long>")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, min_words: int = 1,
          bits: int | None = None) -> DataFrame:
    """(doc_id, th, item_id, score, start_word, end_word): the best alignment of
    each leaked item in each document; th is the text's 64-bit hash.

    ``bits`` sets the size of all filters (None: by their keys)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("th"), "text").distinct()
    texts = materialise(_sequences(items).where(F.size("item") >= min_words), "item-words")
    of_item, of_doc = (_ITEM, _DOC) if threshold >= 0.5 else (_WORD, _WORD)
    if of_item is _ITEM:      # short items' whole sequences: at most seven lengths
        short = texts.where(F.size("item").between(1, SHORT - 1)).select(F.size("item").alias("n")).distinct().collect()
        lookup = of_doc + tuple(s for r in sorted(short) for s in _whole(r.n) if s not in of_doc)
    else:
        lookup = of_doc
    marks = materialise(grams_of_items(texts, of_item), "grams")
    known = sized(marks.count(), bits).build(marks, "gram")
    counts = gram_counts(docs, known, lookup)
    # the most words of a document that an alignment spans, up to the next quarter of a doubling
    width = F.ceil(F.pow(F.lit(2.0), F.ceil(4 * F.log2(F.col("size") * max(3 - 2 * threshold, 1))) / 4)).cast("long")
    rare = materialise(rarest(marks, counts).withColumn("width", width), "seeds")
    filters = [(r.width, sized(r["count"], bits).build(rare.where(F.col("width") == r.width), "gram"))
               for r in sorted(rare.groupBy("width").count().collect())]       # four a doubling of item length
    p = F.xxhash64("doc_id", "th", "first").alias("p")
    hits = materialise(_passages(docs, filters, lookup, known).withColumn("p", p), "hits")
    pairs = (hits.select("doc_id", "th", "first", "p", F.explode("seeds").alias("gram"))
             .join(rare.select("item_id", F.col("th").alias("ith"), "gram"), "gram")
             .select("doc_id", "th", "first", "p", "item_id", "ith").distinct())
    # occurrences of an item's gram beyond the first count as common, whether or not the passage has it
    of_items = marks.groupBy("item_id", F.col("th").alias("ith")).agg(
        F.collect_list("gram").alias("all_grams"), F.max("need").alias("need"), F.sum(F.col("times") - 1).alias("more"))
    same_passage = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("doc_id", "th", "first")]
    same_item = F.col("x.item_id").eqNullSafe(F.col("z.item_id")) & (F.col("x.ith") == F.col("z.ith"))
    pairs = (pairs.alias("x").join(hits.alias("y"), [F.col("x.p") == F.col("y.p"), *same_passage])
             .select("x.*", "y.grams").alias("x").join(of_items.alias("z"), same_item)
             .where(F.size(F.array_intersect("all_grams", "grams")) + F.col("more") >= F.col("need")).select("x.*").drop("grams"))
    pairs = materialise(pairs, "pairs")
    # words are written for the texts that have a pair, which a second pass over the documents reads again
    passages = _passages(docs, filters, lookup, known, sized(pairs.select("th").distinct().count(), bits).build(pairs, "th"))
    keyed = materialise(passages.select("doc_id", "th", "first", "words", p), "passages")
    t = texts.select("item_id", F.col("th").alias("ith"), "item")
    with_item = pairs.alias("p").join(t.alias("t"), F.col("p.item_id").eqNullSafe(F.col("t.item_id"))
                                      & (F.col("p.ith") == F.col("t.ith"))).select("p.*", "t.item")
    same = [F.col("a.p") == F.col("b.p"), F.col("a.first") == F.col("b.first"), F.col("a.th") == F.col("b.th"),
            F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))]
    both = with_item.alias("a").join(keyed.dropDuplicates(["p", "doc_id", "th", "first"]).alias("b"), same).select(
        "a.doc_id", "a.th", "a.first", "a.item_id", "a.item", "b.words")
    found = both.mapInArrow(_align(threshold, of_item is _ITEM), "doc_id long, th long, item_id long, score double, start_word long, end_word long")
    best = F.max(F.struct("score", F.negative("start_word").alias("s"), "end_word")).alias("m")
    return found.groupBy("doc_id", "th", "item_id").agg(best).select(
        "doc_id", "th", "item_id", F.col("m.score").alias("score"), F.negative("m.s").alias("start_word"),
        F.col("m.end_word").alias("end_word"))


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no test item leaked, all columns kept."""
    found = leaks(docs, items, **options).select(F.col("doc_id").alias("leak_doc"), F.col("th").alias("leak_th")).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("leak_doc"))
                     & (F.xxhash64("text") == F.col("leak_th")), "left_anti")

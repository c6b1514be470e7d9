"""Substring de-duplication by de Bruijn compaction (operator 10).

The graph's edges are the ``window``-word k-mers of all texts (35 words by
default), its nodes the k-1 words two edges share.  Edges are never shuffled
one by one.  The windows of a text that share their minimiser (the ``anchor``
words of smallest hash in the window) are neighbours, and form one *run*;
equal windows have equal minimisers, so runs group equal edges just as well,
at about two runs for every 28 words.

1. Anchors that occur twice are counted (partial aggregation, so a hot anchor
   is one row for each task) and put in a fixed-size Bloom filter.
2. Runs at such anchors are written with their source coordinates and counted
   by content.  A run seen twice is a path of repeated edges.
3. Runs whose successor and predecessor are the same wherever they occur are
   nonbranching; joining each run to the next one along the coordinates of its
   representative occurrence compacts them into unitigs.  Only a unitig's head
   is joined back to the texts.
4. A run seen once at an anchor with several runs may still share some windows
   with them (where a repeated passage begins or ends): the windows of one
   occurrence for each such run are compared one by one.
5. Every unitig occurrence is re-read at its source coordinates and its words
   are digested; an occurrence whose digest no other occurrence has is kept.

Defined results: a null or empty text has no words, removes nothing and hashes
as the empty string; rows that repeat a doc_id, or have none, are separate
rows (texts under one doc_id are told apart by their 64-bit hash; fully equal
rows repeat each other); other columns are ignored; an empty table gives an
empty result.  Identity of runs and windows is 128 bits of content hash.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from . import words as W
from .tables import Bloom, materialise, release

POS_BITS = 26                      # word position inside an occurrence code
_LOW = np.uint64((1 << 28) - 1)    # index of a k-mer inside its slice

_RUN_SCHEMA = ("doc_id long, th long, occ long, pos int, n int, anchor long, run long, "
               "prev int, next int")
_WINDOW_SCHEMA = "doc_id long, th long, pos int, anchor long, hash long, repeated boolean"


class _Runs:
    """Runs of the texts of one slice, in text order."""

    def __init__(self, w: W.Words, window: int, anchor: int):
        self.size = 0
        start = w.starts_of(window)
        if not len(start):
            return
        ha, hb = w.hashes(W.BYTES_A), w.hashes(W.BYTES_B)
        self.pre = W.prefix(hb, W.WORDS_B)
        pre = W.prefix(ha, W.WORDS_A)
        at = np.arange(len(ha) - anchor + 1)
        kmer = W.spans_hash(pre, at, at + anchor, W.WORDS_A)
        best = (kmer & ~_LOW) | at.astype(np.uint64)   # ties: the leftmost
        width, need = 1, window - anchor + 1
        while 2 * width <= need:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if need > width:
            best = np.minimum(best[:width - need], best[need - width:])
        chosen = (best[start] & _LOW).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (np.diff(start) != 1) | (np.diff(chosen) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        self.window = window
        self.start = start[first]                      # word index in the slice
        self.n = last - first + 1                      # windows
        self.size = len(first)
        self.anchor = W.as_long(kmer[chosen[first]])
        self.run = W.as_long(W.spans_hash(self.pre, self.start, self.start + self.n - 1 + window,
                                          W.WORDS_B))
        self.doc = w.doc_of(self.start)
        self.pos = self.start - w.first[self.doc]
        short = self.run.astype(np.int32) | 1          # 0 stands for none
        same = self.doc[1:] == self.doc[:-1]
        self.prev, self.next = np.zeros(self.size, np.int32), np.zeros(self.size, np.int32)
        self.prev[1:][same], self.next[:-1][same] = short[:-1][same], short[1:][same]

    def occ(self, doc_id: np.ndarray, th: np.ndarray) -> np.ndarray:
        """Code of an occurrence: text hash above, word position below, so
        that the runs of one text follow each other in this order."""
        d = self.doc
        text = W.mix(th[d].view(np.uint64) ^ W.mix(doc_id[d].view(np.uint64))
                     + (self.pos >> POS_BITS).astype(np.uint64))
        low = np.uint64((1 << POS_BITS) - 1)
        return W.as_long((text >> np.uint64(1)) & ~low | (self.pos.astype(np.uint64) & low))

    def window_hashes(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run index, hash) of every window of the picked runs."""
        n = self.n[picked]
        owner = np.repeat(np.flatnonzero(picked), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = self.start[owner] + step
        return owner, step, W.as_long(W.spans_hash(self.pre, at, at + self.window, W.WORDS_B))


def _ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch[name].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _each(batch: pa.RecordBatch, window: int, anchor: int) -> Iterator[tuple[_Runs, np.ndarray, np.ndarray, pa.Array]]:
    doc, th = _ids(batch, "doc_id"), _ids(batch, "th")
    for lo, hi, raw, off in W.slices(batch["text"]):
        runs = _Runs(W.segment(raw, off), window, anchor)
        if runs.size:
            yield runs, doc[lo:hi], th[lo:hi], batch["doc_id"].slice(lo, hi - lo)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("text").alias("th"), "text")


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Anchors seen twice or more."""
    def job(batches):
        for b in batches:
            for runs, *_ in _each(b, window, anchor):
                a, n = np.unique(runs.anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n)], ["anchor", "n"])
    return (docs.mapInArrow(job, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
            .where("n > 1").select("anchor"))


def _runs(docs: DataFrame, repeated: Bloom, window: int, anchor: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def job(batches):
        bloom = shared.value
        for b in batches:
            for r, doc, th, ids in _each(b, window, anchor):
                k = np.flatnonzero(bloom.has(r.anchor))
                if len(k):
                    d = r.doc[k]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(d)), pa.array(th[d]), pa.array(r.occ(doc, th)[k]),
                         pa.array(r.pos[k].astype(np.int32)), pa.array(r.n[k].astype(np.int32)),
                         pa.array(r.anchor[k]), pa.array(r.run[k]), pa.array(r.prev[k]), pa.array(r.next[k])],
                        ["doc_id", "th", "occ", "pos", "n", "anchor", "run", "prev", "next"])
    return docs.mapInArrow(job, _RUN_SCHEMA)


def _windows(docs: DataFrame, compared: Bloom, window: int, anchor: int) -> DataFrame:
    """Every window of the runs whose occurrence code is in the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(compared)

    def job(batches):
        bloom = shared.value
        for b in batches:
            for r, doc, th, ids in _each(b, window, anchor):
                occ = r.occ(doc, th)
                picked = bloom.has(occ)
                if picked.any():
                    own, step, h = r.window_hashes(picked)
                    d = r.doc[own]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(d)), pa.array(th[d]), pa.array((r.pos[own] + step).astype(np.int32)),
                         pa.array(r.anchor[own]), pa.array(h), pa.array(occ[own]), pa.array(r.run[own])],
                        ["doc_id", "th", "pos", "anchor", "hash", "occ", "run"])
    return docs.mapInArrow(job, "doc_id long, th long, pos int, anchor long, hash long, occ long, run long")


def unitigs(classes: DataFrame) -> DataFrame:
    """Compact repeated runs into unitigs: (anchor, run) of the head, unitig id
    and length in windows.

    Run v follows u on a nonbranching path when u always has the same next run
    and v always the same previous one; their representatives (the smallest
    occurrence codes) are then neighbours in one text, which makes the path an
    island in coordinate order.
    """
    along = SparkWindow.partitionBy(F.shiftright("rep", POS_BITS)).orderBy("rep")
    out = (F.col("min_next") == F.col("max_next")) & (F.col("min_next") != 0)
    into = (F.col("min_prev") == F.col("max_prev")) & (F.col("min_prev") != 0)
    short = F.col("run").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1))
    low = F.col("min_next").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    steps = classes.withColumns({"out": out, "into": into, "short": short, "low": low})
    before = F.lag(F.struct("rep", "n", "c", "out", "low")).over(along)
    steps = steps.withColumn("b", before).withColumn(
        "joined", F.coalesce(F.col("into") & F.col("b.out") & (F.col("b.rep") + F.col("b.n") == F.col("rep"))
                             & (F.col("b.c") == F.col("c")) & (F.col("b.low") == F.col("short")), F.lit(False)))
    island = SparkWindow.partitionBy(F.shiftright("rep", POS_BITS)).orderBy("rep").rowsBetween(
        SparkWindow.unboundedPreceding, 0)
    steps = steps.withColumn("unitig", F.max(F.when(~F.col("joined"), F.col("rep"))).over(island))
    return (steps.groupBy("unitig").agg(F.sum("n").alias("len"),
                                        F.min(F.when(~F.col("joined"), F.struct("anchor", "run"))).alias("head"))
            .select("unitig", "len", "head.anchor", "head.run"))


def repeated_spans(docs: DataFrame, window: int = 35, anchor: int = 8, bits: int = 1 << 27) -> DataFrame:
    """(doc_id, th, pos, n, unitig): ``n`` repeated windows of the text from
    word ``pos`` on; ``unitig`` is null for windows found one by one."""
    keyed = _keyed(docs)
    some = Bloom(bits).build(_anchors(keyed, window, anchor), "anchor")
    release(docs.sparkSession)
    runs = materialise(_runs(keyed, some, window, anchor), "runs")
    classes = materialise(
        runs.groupBy("anchor", "run").agg(
            F.count("*").alias("c"), F.min("occ").alias("rep"), F.max("n").alias("n"),
            F.min("prev").alias("min_prev"), F.max("prev").alias("max_prev"),
            F.min("next").alias("min_next"), F.max("next").alias("max_next")), "classes")
    heads = unitigs(classes.where("c > 1"))
    whole = runs.select("doc_id", "th", "pos", "anchor", "run").join(heads, ["anchor", "run"]).select(
        "doc_id", "th", "pos", F.col("len").cast("int").alias("n"), "unitig")
    # partly shared runs: anchors with several runs, one occurrence of each run
    several = classes.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    partial = materialise(classes.join(several, "anchor").select("anchor", "run", "rep", "c"), "partial")
    compared = Bloom(bits).build(partial, "rep")
    rows = _windows(keyed, compared, window, anchor)
    status = partial.select("anchor", "run", F.col("rep").alias("occ"), (F.col("c") > 1).alias("repeated"))
    rows = materialise(rows.join(status, ["anchor", "run", "occ"]).select(
        "doc_id", "th", "pos", "anchor", "hash", "repeated"), "windows")
    shared = rows.groupBy("anchor", "hash").agg(
        F.count("*").alias("k"), F.max("repeated").alias("r")).where("k > 1 OR r").select("anchor", "hash")
    single = rows.where("NOT repeated").join(shared, ["anchor", "hash"]).select(
        "doc_id", "th", "pos", F.lit(1).alias("n"), F.lit(None).cast("long").alias("unitig"))
    return whole.unionByName(single)


def _cut(window: int):
    def job(batches):
        for b in batches:
            out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "digests")}
            spans = b["spans"].to_pylist()
            at = 0
            for _lo, _hi, raw, off in W.slices(b["text"]):
                w = W.segment(raw, off)
                for d in range(w.n_docs):
                    start, end = w.start[w.first[d]:w.first[d + 1]], w.end[w.first[d]:w.first[d + 1]]
                    n, digests = len(start), []
                    text = raw[off[d]:off[d + 1]].tobytes()
                    if spans[at]:
                        gone = np.zeros(n + 1, np.int64)
                        for s in spans[at]:
                            lo, hi = s["pos"], s["pos"] + s["n"] - 1 + window
                            gone[lo] += 1
                            gone[hi] -= 1
                            if s["unitig"] is not None:
                                words = b" ".join(text[start[lo] - off[d]:end[hi - 1] - off[d]].split())
                                digests.append({"unitig": s["unitig"], "digest": hashlib.blake2b(words, digest_size=16).digest()})
                        keep = np.cumsum(gone[:-1]) == 0
                        kept = b" ".join(text[p:q] for p, q in zip((start[keep] - off[d]).tolist(), (end[keep] - off[d]).tolist()))
                        removed = n - int(keep.sum())
                    else:
                        kept, removed = b" ".join(text.split()), 0
                    out["n_words"].append(n)
                    out["n_removed"].append(removed)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["digests"].append(digests)
                    at += 1
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["th"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                 pa.array(out["kept_sha256"], pa.string()),
                 pa.array(out["digests"], pa.list_(pa.struct([("unitig", pa.int64()), ("digest", pa.binary())])))],
                ["doc_id", "th", "n_words", "n_removed", "kept_sha256", "digests"])
    return job


def _apply(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """Cut the spans out of whole texts; each text meets its own spans only."""
    per_text = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "n", "unitig")).alias("spans"))
    t, s = _keyed(docs).alias("t"), per_text.alias("s")
    both = t.join(s, F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.th") == F.col("s.th")), "left")
    return both.select("t.doc_id", "t.th", "t.text", "s.spans").mapInArrow(
        _cut(window), "doc_id long, th long, n_words long, n_removed long, kept_sha256 string, "
                      "digests array<struct<unitig:long,digest:binary>>")


def remove_repeats(docs: DataFrame, window: int = 35, anchor: int = 8, bits: int = 1 << 27) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (see module docstring)."""
    spans = materialise(repeated_spans(docs, window, anchor, bits), "spans")
    out = materialise(_apply(docs, spans, window), "cut")
    seen = out.select("doc_id", "th", F.explode("digests").alias("d")).select("doc_id", "th", "d.*")
    alone = seen.groupBy("unitig", "digest").agg(
        F.count("*").alias("k"), F.min(F.struct("doc_id", "th")).alias("t")).where("k = 1")
    wrong = materialise(alone.select("unitig", "t.doc_id", "t.th"), "unverified")
    result = out.select("doc_id", "n_words", "n_removed", "kept_sha256")
    if wrong.isEmpty():
        return result
    # spans that hash alike but read differently: cut these texts again without them
    drop = [F.col("a.unitig") == F.col("w.unitig"), F.col("a.doc_id").eqNullSafe(F.col("w.doc_id")), F.col("a.th") == F.col("w.th")]
    left = spans.alias("a").join(wrong.alias("w"), drop, "left_anti")
    texts = wrong.select("doc_id", "th").distinct().alias("w")
    own = [F.col("a.doc_id").eqNullSafe(F.col("w.doc_id")), F.col("a.th") == F.col("w.th")]
    again = _keyed(docs).alias("a").join(texts, own, "left_semi")
    fixed = _apply(again.select("doc_id", "text"), left, window).select("doc_id", "n_words", "n_removed", "kept_sha256")
    kept = out.alias("a").join(texts, own, "left_anti").select("doc_id", "n_words", "n_removed", "kept_sha256")
    return kept.unionByName(fixed)

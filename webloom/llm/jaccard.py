"""N-gram Jaccard join by vertical partitioning (operator 5).

Documents are sets of word n-grams in one global order, rare n-grams first
(see ``Order``).

1. Equal sets are one class (a 128-bit hash of the set).
2. Prefix filter: two sets of Jaccard ``num/den`` or more share an n-gram of
   their first ``n - ceil(n * num / den) + 1``; the places of the first shared
   one also bound the overlap.  N-grams of one class only are dropped.
3. In each n-gram's classes, the one that has it earliest is the hub; each
   other class is paired with it.  Classes that these links leave apart are
   paired with each other, so no link between components is missed, while the
   pairs inside a large group of near copies are never listed.
4. The global order is cut into ``fragments`` of equal weight.  For each pair
   and fragment the overlap of the two segments is counted on its own; the
   sum over fragments decides the pair exactly.
5. Linked classes are put together by distributed connected components.

Defined results: words are lower-cased (A-Z) runs of anything but space and
\\t-\\r; a text of fewer than n words is one n-gram, its whole sequence; a null
or empty text has none and links with nothing.  Rows that repeat a doc_id are
separate rows; rows without one (null) link by content and take the smallest
doc_id they reach, null if there is none (doc_ids are below 2^62).  An empty
table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .tables import Bloom, materialise, release, small_batches

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_NO_ID = 1 << 62


def grams(w: W.Words, n: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of a slice and the document of each."""
    h = w.hashes() if h is None else h
    start = w.starts_of(n)
    acc = np.zeros(len(start), np.uint64)
    for i in range(n):
        acc += h[start + i] * _C[i % len(_C)] ** np.uint64(1 + i // len(_C))
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    whole = W.spans_hash(W.prefix(h, W.WORDS_A), w.first[short], w.first[short + 1], W.WORDS_A)
    return np.concatenate([W.mix(acc), whole]), np.concatenate([w.doc_of(start), short])


class Order:
    """The global order of n-grams, as 63-bit keys.

    Two fixed-size tables of hashed counts over the whole corpus, one of
    n-grams and one of words, rank an n-gram by the power of two by which its
    count is above the mean (common passages go last), then by the product of
    its words' counts (rare words go first), then by hash.
    """

    CHUNK = 1 << 14

    def __init__(self, buckets: int):
        self.level = np.zeros(buckets, np.uint8)          # of n-grams: 0 up to the mean, at most 15
        self.log2 = np.zeros(max(buckets // 4, self.CHUNK), np.float32)   # of word counts

    @staticmethod
    def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
        return (h & np.uint64(buckets - 1)).view(np.int64)

    def learn(self, docs: DataFrame, n: int) -> "Order":
        """Count all words and n-grams of all documents; each task sends its
        counts in chunks, each chunk is summed as it streams in."""
        size, words, chunk, bucket = len(self.level), len(self.log2), self.CHUNK, self._bucket

        def count(batches):
            total = np.zeros(size + words, np.int32)
            for b in batches:
                for _lo, _hi, raw, off in W.slices(b["text"]):
                    w = W.segment(raw, off, W.ASCII_LOWER)
                    h = w.hashes()
                    for at in (bucket(grams(w, n, h)[0], size), bucket(h, words) + size):
                        at.sort()
                        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
                        total[at[first]] += np.diff(np.append(first, len(at))).astype(np.int32)
            for i, part in enumerate(total.reshape(-1, chunk)):
                if part.any():
                    kind = np.uint16 if part.max() < 1 << 16 else np.int32
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())],
                                                     ["chunk", "counts"])

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for i, raw in zip(b["chunk"].to_pylist(), b["counts"].to_pylist()):
                    part = np.frombuffer(raw, np.uint16 if len(raw) == 2 * chunk else np.int32).astype(np.int64)
                    sums[i] = sums[i] + part if i in sums else part
            for i, part in sums.items():
                log2 = np.log2(np.maximum(part, 1)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([int(part.sum())]), pa.array([log2.tobytes()], pa.binary())],
                                                 ["chunk", "total", "log2"])

        with small_batches(docs.sparkSession):
            rows = (docs.select("text").mapInArrow(count, "chunk int, counts binary").repartition("chunk")
                    .mapInArrow(add, "chunk int, total long, log2 binary").collect())
        logs, total = np.zeros(size + words, np.float32), 0
        for r in rows:       # a row for each CHUNK buckets: the tables have one size at any input
            logs[r.chunk * chunk:(r.chunk + 1) * chunk] = np.frombuffer(r.log2, np.float32)
            total += r.total if r.chunk * chunk < size else 0
        usual = np.log2(max(total / size, 1.0)) + 0.5
        self.level = np.clip(np.ceil(logs[:size] - usual), 0, 15).astype(np.uint8)
        self.log2 = logs[size:]
        return self

    def keys(self, w: W.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, document) of each n-gram of a slice."""
        h = w.hashes()
        g, doc = grams(w, n, h)
        start, log2 = w.starts_of(n), self.log2[self._bucket(h, len(self.log2))]
        rarity = np.zeros(len(g), np.float32)
        for i in range(n):
            rarity[:len(start)] += log2[start + i]
        rank = self.level[self._bucket(g, len(self.level))].astype(np.uint64) << np.uint64(5) | np.minimum(rarity / n, 31).astype(np.uint64)
        return (rank << np.uint64(54) | g >> np.uint64(10)).view(np.int64), doc


def _sets(column: pa.Array, n: int, order: Order):
    """(row, ordered keys, 16-byte set hash) of each text with words."""
    for lo, hi, raw, off in W.slices(column):
        keys, doc = order.keys(W.segment(raw, off, W.ASCII_LOWER), n)
        by = np.argsort(doc, kind="stable")
        keys, ends = keys[by], np.searchsorted(doc[by], np.arange(hi - lo + 1))
        for d in range(hi - lo):
            if ends[d] < ends[d + 1]:
                k = np.unique(keys[ends[d]:ends[d + 1]])
                u = k.view(np.uint64)
                node = np.array([W.mix(u).sum(), W.mix(u ^ _C[0]).sum(), ], np.uint64)
                yield lo + d, k, W.mix(node + np.uint64(len(k))).tobytes()


def _describe(docs: DataFrame, n: int, order: Order, num: int, den: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def job(batches):
        for b in batches:
            size, node, prefix, probes = np.zeros(b.num_rows, np.int64), *([None] * b.num_rows for _ in range(3))
            for row, k, h in _sets(b["text"], n, shared.value):
                size[row], node[row] = len(k), h
                prefix[row] = k[:len(k) - -(-num * len(k) // den) + 1]
                probes[row] = k[h[0] % 64::64]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["code"], pa.array(size), pa.array(node, pa.binary()),
                                              pa.array(prefix, pa.list_(pa.int64())), pa.array(probes, pa.list_(pa.int64()))],
                                             ["doc_id", "code", "n", "node", "prefix", "probes"])
    return docs.mapInArrow(job, "doc_id long, code long, n long, node binary, prefix array<long>, probes array<long>")


def _pivots(sets: DataFrame, fragments: int) -> np.ndarray:
    """Keys that cut the global order into fragments of about equal weight,
    from every 64th key of each set."""
    at = [i / fragments for i in range(1, fragments)]
    found = sets.select(F.explode("probes").alias("k")).agg(F.percentile_approx("k", at, 1000).alias("q")).first().q
    return np.array(found or [0] * (fragments - 1), np.int64)


def _filter(keys: DataFrame, column: str, bits: int) -> Bloom | None:
    """A filter of 16 bits for each of the stored keys; None where that is more
    than ``bits``, as the keys are then too many to be sent to all tasks."""
    need = 1 << max(12, (16 * keys.count()).bit_length())
    return Bloom(need).build(keys, column) if need <= bits else None


def _candidates(classes: DataFrame, several: DataFrame, bits: int) -> DataFrame:
    """(token, node, n, pos): prefix n-grams that may be in several classes."""
    shared_grams = _filter(several, "token", bits)
    if shared_grams is None:
        rows = classes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
        return rows.select("token", "node", "n", F.col("pos").cast("long").alias("pos")).join(several, "token", "left_semi")
    shared = classes.sparkSession.sparkContext.broadcast(shared_grams)

    def job(batches):
        for b in batches:
            prefix = b["prefix"]
            token = prefix.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(prefix.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            k = np.flatnonzero(shared.value.has(token))
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[k]), b["node"].take(pa.array(row[k])), b["n"].take(pa.array(row[k])), pa.array(pos[k])],
                ["token", "node", "n", "pos"])
    return classes.select("prefix", "node", "n").mapInArrow(job, "token long, node binary, n long, pos long")


def _segments(docs: DataFrame, n: int, order: Order, codes: DataFrame, bits: int, pivots: np.ndarray) -> DataFrame:
    """(node, fragment, keys) of the wanted representatives, read from their texts."""
    wanted = _filter(codes, "code", bits)
    if wanted is None:
        docs = docs.join(codes, "code", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast((order, wanted))

    def job(batches):
        ranks, bloom = shared.value
        for b in batches:
            few = b.filter(pa.array(bloom.has(b["code"].to_numpy()))) if bloom else b
            nodes, frags, keys = [], [], []
            for _row, k, h in _sets(few["text"], n, ranks):
                cut = np.searchsorted(k, pivots)
                for f, part in enumerate(np.split(k, cut)):
                    if len(part):
                        nodes.append(h)
                        frags.append(f)
                        keys.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(frags, pa.int32()),
                                              pa.array(keys, pa.list_(pa.int64()))], ["node", "fragment", "keys"])
    return docs.select("code", "text").mapInArrow(job, "node binary, fragment int, keys array<long>")


def _links(pairs: DataFrame, segments: DataFrame, fragments: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose overlap, summed over the fragments, is enough.

    The fragment of the rarest n-grams goes first: what it leaves possible
    drops the pairs that met by chance before the other fragments are joined.
    """
    of = lambda rows, s: rows.select(F.col("node").alias(s), "fragment", F.col("keys").alias(f"keys_{s}"))
    key = ["a", "b", "na", "nb"]
    none = F.array().cast("array<long>")
    sides = [F.coalesce(F.col(f"keys_{s}"), none) for s in "ab"]
    overlap = F.size(F.array_intersect(*sides))
    rare = segments.where("fragment = 0")
    head = (pairs.join(of(rare, "a").drop("fragment"), "a", "left").join(of(rare, "b").drop("fragment"), "b", "left")
            .select(*key, overlap.alias("i"), F.size(sides[0]).alias("sa"), F.size(sides[1]).alias("sb"))
            .groupBy(*key).agg(F.max("i").alias("first"), F.max("sa").alias("sa"), F.max("sb").alias("sb")))   # rows that repeat a text
    most = F.col("first") + F.least(F.col("na") - F.col("sa"), F.col("nb") - F.col("sb"))
    open_ = materialise(head.where(most * (den + num) >= num * (F.col("na") + F.col("nb"))).select(*key, "first"), "open")
    each = open_.withColumn("fragment", F.explode(F.sequence(F.lit(1), F.lit(fragments - 1))))
    partial = (each.join(of(segments, "a"), ["a", "fragment"]).join(of(segments, "b"), ["b", "fragment"])
               .select(*key, "fragment", overlap.alias("i"))
               .groupBy(*key, "fragment").agg(F.max("i").alias("i")))
    total = (partial.select(*key, "i").unionByName(open_.withColumnRenamed("first", "i"))
             .groupBy(*key).agg(F.sum("i").alias("i")))
    return total.where(F.col("i") * den >= num * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _components(docs: DataFrame, n: int, num: int, den: int, fragments: int, buckets: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows with doc_id, code, n, node; components with node, component_id and
    the code of the row that stands for the component)."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("code"), "text")
    order = Order(buckets).learn(keyed, n)
    sets = materialise(_describe(keyed, n, order, num, den), "sets")
    # a row's key: its doc_id, or a number above all of them taken from its set
    key = F.coalesce("doc_id", F.lit(_NO_ID) + F.shiftrightunsigned(F.xxhash64("node"), 2))
    classes = materialise(
        sets.where("n > 0").withColumn("key", key).groupBy("node").agg(
            F.min("key").alias("rep"), F.max("n").alias("n"), F.min_by("code", "key").alias("code"),
            F.min_by("prefix", "key").alias("prefix")), "classes")
    several = materialise(classes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
                          .where("c > 1").select("token"), "shared-grams")
    cand = materialise(_candidates(classes, several, bits), "candidates")
    # n-grams with the same classes make the same pairs: the first of them is enough, as it is
    # the first one (of those) that any two of its classes share
    members = [F.expr(f"bit_xor(xxhash64(node, {seed}))").alias(f"m{seed}") for seed in (1, 2)]
    hubs = cand.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("pos", "node", "n")).alias("h"), *members).where("c > 1")
    hubs = materialise(hubs.groupBy("c", "m1", "m2").agg(F.min(F.struct("token", "h")).alias("t"))
                       .select("t.token", "c", "t.h"), "hubs")
    both = (cand.join(hubs, "token").select("token", "c", *(F.col(x).alias(f"{x}_x") for x in ("node", "n", "pos")),
                                            *(F.col(f"h.{x}").alias(f"{x}_y") for x in ("node", "n", "pos"))))
    enough = (F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) * (den + num)
              >= num * (F.col("n_x") + F.col("n_y")))
    first = F.col("node_x") < F.col("node_y")
    pair = [F.when(first, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")).alias(a) for c, a in (("node", "a"), ("n", "na"))] + [
        F.when(first, F.col(f"{c}_y")).otherwise(F.col(f"{c}_x")).alias(a) for c, a in (("node", "b"), ("n", "nb"))]
    star = materialise(both.where(enough & (F.col("node_x") != F.col("node_y"))).select(*pair).distinct(), "star-pairs")
    pivots = _pivots(sets, fragments)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are links, their texts read again."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        codes = materialise(classes.join(nodes, "node", "left_semi").select("code"), "wanted")
        segments = materialise(_segments(keyed, n, order, codes, bits, pivots), "segments")
        return materialise(_links(pairs, segments, fragments, num, den), "verified")

    links = verified(star)
    label = materialise(components(links), "star-components")
    # what the hubs left apart: pairs across components, by the same n-grams and bounds
    some = (cand.join(hubs.where("c > 2").select("token"), "token")
            .join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    open_tokens = some.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("token")
    left = materialise(some.join(open_tokens, "token"), "open")
    x, y = (left.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "pos", "comp"))) for s in "xy")
    rest = (x.join(y, "token").where((F.col("comp_x") != F.col("comp_y")) & (F.col("node_x") < F.col("node_y")) & enough)
            .select(*pair).distinct().join(star.select("a", "b"), ["a", "b"], "left_anti"))
    comps = components(links.union(verified(materialise(rest, "open-pairs"))))
    found = classes.select("node", "rep", "code").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = found.groupBy("comp").agg(F.min("rep").alias("component_id"), F.min_by("code", "rep").alias("first"))
    release(spark)
    return sets, found.join(smallest, "comp").select("node", "component_id", "first")


def jaccard_classes(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, fragments: int = 8,
                    buckets: int = 1 << 22, bits: int = 1 << 28) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (see module docstring).

    Filters take 16 bits for each counted key, ``bits`` at most; beyond that
    the same rows are found by a semi join."""
    sets, comps = _components(docs, n, num, den, fragments, buckets, bits)
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("component_id") < _NO_ID, F.col("component_id")))
    return sets.select("doc_id", "n", "node").join(comps, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, fragments: int = 8,
                buckets: int = 1 << 22, bits: int = 1 << 28) -> DataFrame:
    """The documents without their near copies, all columns kept: of each
    component the row of smallest doc_id stays, and every row without words;
    rows that repeat both doc_id and text are one."""
    sets, comps = _components(docs, n, num, den, fragments, buckets, bits)
    stay = (sets.select("code", "n", "node").join(comps, "node", "left")
            .where((F.col("n") == 0) | (F.col("code") == F.col("first"))).select(F.col("code").alias("stay_code")).distinct())
    code = "code"
    while code in docs.columns:
        code += "_"
    rows = docs.withColumn(code, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    return rows.join(stay, F.col(code) == F.col("stay_code"), "left_semi").dropDuplicates([code]).drop(code)

"""Fill-in-middle transformation by content-defined chunk memoization (operator 11).

A document is cut at two code points into prefix, middle and suffix, which are
put in another order between markers.  The cuts are drawn as code points, the
text is bytes; finding the bytes means counting the code points before them.

1. A rolling hash over the last 32 bytes cuts each text into chunks, so texts
   that share a passage share its chunks wherever the passage stands.
2. A worker keeps the boundary summary of each chunk it has met (how many code
   points begin in it, and where every 64th of them does) in ``ChunkMemo``.  The
   fingerprint finds an entry, the chunk's content verifies it.
3. The chunks' counts are added up: their sum is the text's length, a cut lies
   in the chunk where the running sum passes it, and the chunk's summary leads
   to the byte.

Rows are independent, so nothing is exchanged; a task holds one slice of texts
(or the longest document) and a memo of bounded size, whose oldest entries go
first.  What a memo holds never changes a result.

Defined results: a null text is an empty one, a null doc_id draws like an empty
one; rows that repeat a doc_id draw the same numbers; an empty table gives no rows;
other columns are ignored, whatever their names.  Texts that hold a marker stay
plain, so that every output can be read back (``restored``).
"""
from __future__ import annotations

import hashlib
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_WINDOW = 32        # bytes the rolling hash looks back on
_EVERY = 64         # code points between the marks of a summary


@lru_cache
def _gear() -> np.ndarray:
    """A fixed random number for each byte."""
    return (W.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the last 32 bytes' numbers, the k-th last shifted by k bits.

    The window doubles: a sum over 2k bytes is one over k bytes plus the shifted one before it."""
    h, k = _gear().take(data), 1
    while k < _WINDOW:
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        k *= 2
    return h


def chunk_starts(data: np.ndarray, offsets: np.ndarray, bits: int = 9, most: int = 1 << 14) -> np.ndarray:
    """Byte offsets at which the chunks of a slice of documents begin.

    A chunk ends where the hash's upper ``bits`` are zero (once in 2^bits bytes), at its document's
    end, or after ``most`` bytes.  The first 32 bytes of a document have no whole window and no cut."""
    ends = np.flatnonzero(rolling_hash(data) >> np.uint32(32 - bits) == 0) + 1
    ends = ends[ends < len(data)]
    doc = np.searchsorted(offsets, ends, "right") - 1
    ends = ends[ends - offsets[doc] >= _WINDOW]
    filled = offsets[:-1][np.diff(offsets) > 0]
    starts = np.union1d(filled, ends)
    size = np.diff(np.append(starts, len(data)))
    if len(size) and size.max() > most:
        n = -(-size // most)
        starts = np.repeat(starts, n) + most * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return starts


def summarise(chunk: bytes) -> tuple[int, np.ndarray | None]:
    """(code points that begin in the chunk, byte offset of every 64th of them); no offsets where all
    bytes begin one."""
    lead = np.flatnonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80)
    return len(lead), None if len(lead) == len(chunk) else lead[::_EVERY].astype(np.uint32)


class ChunkMemo:
    """Summaries of chunks by fingerprint and content; at most ``limit`` bytes of content."""

    def __init__(self, limit: int = 1 << 25):
        self.limit, self.held, self.hits, self.misses = limit, 0, 0, 0
        self.entries: OrderedDict[int, tuple[bytes, tuple]] = OrderedDict()

    def get(self, fingerprint: int, chunk: bytes) -> tuple[int, np.ndarray | None]:
        entry = self.entries.get(fingerprint)
        if entry is not None and entry[0] == chunk:
            self.hits += 1
            return entry[1]
        self.misses += 1
        summary = summarise(chunk)
        if entry is None:      # a fingerprint that stands for another chunk keeps it
            self.entries[fingerprint] = chunk, summary
            self.held += len(chunk)
            while self.held > self.limit and len(self.entries) > 1:
                self.held -= len(self.entries.popitem(last=False)[1][0])
        return summary


def locate(text: memoryview, starts: list[int], summaries: list[tuple], point: int) -> int:
    """The byte at which code point ``point`` of a text begins (its length, if there is none)."""
    for start, (count, marks) in zip(starts, summaries):
        if point < count:
            if marks is None:
                return start + point
            at = start + int(marks[point // _EVERY])
            lead = np.flatnonzero((np.frombuffer(text[at:at + 4 * _EVERY], np.uint8) & 0xC0) != 0x80)
            return at + int(lead[point % _EVERY])
        point -= count
    return len(text)


def draws(doc_id, seed: int) -> list[int]:
    """Four numbers below 2^32 for a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in range(0, 32, 8)]


def transform_text(doc_id, text: memoryview, starts: list[int], summaries: list[tuple], seed: int,
                   fim_percent: int, spm_percent: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    n = sum(count for count, _ in summaries)
    h1, h2, h3, h4 = draws(doc_id, seed)
    whole = bytes(text)
    if not n or h3 % 100 >= fim_percent or any(m in whole for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, whole
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    lo, hi = locate(text, starts, summaries, a), locate(text, starts, summaries, b)
    prefix, middle, suffix = whole[:lo], whole[lo:hi], whole[hi:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def _job(seed: int, fim_percent: int, spm_percent: int, bits: int, memo_bytes: int):
    def job(batches):
        memo = ChunkMemo(memo_bytes)
        for b in batches:
            for lo, hi, raw, off in W.slices(b["text"]):
                ids = b["doc_id"].slice(lo, hi - lo).to_pylist()
                starts = chunk_starts(raw, off, bits)
                ends = np.append(starts[1:], len(raw))
                marks = W.spans_hash(W.prefix(raw, W.BYTES_A), starts, ends, W.BYTES_A).tolist()
                first = np.searchsorted(starts, off).tolist()
                whole = memoryview(raw.tobytes())
                starts, ends, bounds = starts.tolist(), ends.tolist(), off.tolist()
                out = []
                for i, doc_id in enumerate(ids):
                    mine = range(first[i], first[i + 1])
                    begin = bounds[i]
                    out.append(transform_text(
                        doc_id, whole[begin:bounds[i + 1]], [starts[c] - begin for c in mine],
                        [memo.get(marks[c], bytes(whole[starts[c]:ends[c]])) for c in mine],
                        seed, fim_percent, spm_percent))
                n, form, prefix, middle, text = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                     pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                     pa.array(text, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return job


def transform(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20,
              bits: int = 9, memo_bytes: int = 1 << 25) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every row of ``docs``.

    ``fim_percent`` of the documents are cut, ``spm_percent`` of those have the suffix first."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_job(seed, fim_percent, spm_percent, bits, memo_bytes), SCHEMA))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    part = F.split(output, "<[PSM]>", -1)      # before the first marker there is nothing
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))

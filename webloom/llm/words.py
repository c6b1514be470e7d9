"""Vectorised word segmentation and hashing of whole texts inside Arrow tasks.

Every helper works on one slice of an Arrow string column at a time.  Slices
hold about ``SLICE_BYTES`` of text (one document at least, however long), so a
worker's memory is bounded by the slice or its longest document, not by the
batch.  A null text has no words, the same as an empty one.

Words are maximal runs of bytes that a 256-entry table maps to non-zero; the
mapped bytes are what is hashed, so one table expresses both the word class
and the folding (``PLAIN``: split at space and \\t-\\r, unchanged; ``ASCII_LOWER``:
the same with A-Z lower-cased; ``LETTERS``: ASCII punctuation splits as well).
Hashes are polynomials over the bytes modulo 2^64 taken from prefix sums
(one multiply and one running sum per byte), then mixed.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18    # arrays of 8 bytes a byte follow from it, several at a time
_U = np.uint64


def _table(split: bytes, lower: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[list(split)] = 0
    t[0] = 0 if 0 in split else 255   # NUL is an ordinary word byte
    return t


_SPACES = bytes([32, 9, 10, 11, 12, 13])
_PUNCT = bytes(b for b in range(128) if not chr(b).isalnum())
PLAIN = _table(_SPACES, False)
ASCII_LOWER = _table(_SPACES, True)
LETTERS = _table(_PUNCT, True)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    h = h.astype(_U)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    @staticmethod
    def _upto(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, _U)
        out[0] = 1
        return np.multiply.accumulate(out)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n2 = max(n, 2 * len(self.up))
            self.up, self.down = self._upto(self.base, n2), self._upto(self.inv, n2)
        return self.up[:n], self.down[:n]


BYTES_A, BYTES_B = Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95)
WORDS_A, WORDS_B = Powers(0xC2B2AE3D27D4EB4F), Powers(0xA0761D6478BD642F)


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of value * base^position, with a leading zero."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values.astype(_U) * powers.upto(len(values))[0], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Mixed hash of each value sequence [start, end), position independent."""
    down = powers.upto(len(pre))[1]
    h = (pre[end] - pre[start]) * down[start]
    return mix(h + (end - start).astype(_U) * _U(0x8CB92BA72F3D8DD7))


@dataclass
class Words:
    """Words of the documents of one slice."""
    data: np.ndarray      # mapped bytes of the slice (0 = separator)
    raw: np.ndarray       # the bytes themselves
    offsets: np.ndarray   # byte offset of each document, n + 1
    start: np.ndarray     # byte offset of each word
    end: np.ndarray
    first: np.ndarray     # index of the first word of each document, n + 1

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, powers: Powers = BYTES_A) -> np.ndarray:
        return spans_hash(prefix(self.data, powers), self.start, self.end, powers)

    def starts_of(self, k: int) -> np.ndarray:
        """Word indexes at which a whole k-word window of one document starts."""
        if not len(self.start):
            return np.zeros(0, np.int64)
        ok = np.zeros(len(self.start) + 1, np.int32)
        n = self.counts
        has = n >= k
        np.add.at(ok, self.first[:-1][has], 1)
        np.add.at(ok, self.first[:-1][has] + n[has] - k + 1, -1)
        return np.flatnonzero(np.cumsum(ok[:-1]) > 0)

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1


def segment(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN) -> Words:
    data = table[raw]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = data != 0
    begins = inside[1:] & ~inside[:-1]        # n + 1 entries; [i]: a word begins at i
    ends = inside[:-1] & ~inside[1:]          # [i]: a word ends before i
    cut = offsets[(offsets > 0) & (offsets < n)]
    begins[cut] = inside[1:][cut]
    ends[cut] = inside[:-1][cut]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(data, raw, offsets, start, end, np.searchsorted(start, offsets))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of whole rows."""
    if not len(column):
        return
    data, off = string_buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

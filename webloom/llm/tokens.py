"""Token-ID output: whole texts to coded blocks of ids, and back (operator 9).

``write_blocks`` sorts the documents by doc_id over range partitions,
tokenises them and cuts each partition's ids, at document ends, into blocks of
about ``block_ids`` ids.  A block is one binary value in the format of
``idcoder`` preceded by a directory of its documents; blocks are written as
rows of Parquet files, so Spark's commit protocol covers lost executors.
``read_blocks`` decodes blocks in parallel; only the id totals of the range
partitions (one number each) are put together to number ids over all files.

Defined results: a null or empty text has the end id alone; rows that repeat a
doc_id, or have none (they come first), are separate documents ordered by their
text's hash; an empty table gives no rows; other columns are ignored.  A
document is never cut, so memory is bounded by a block or the longest document.
"""
from __future__ import annotations

import os
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from . import idcoder
from . import words as W
from .tables import materialise

END_ID = 2
_DIRECTORY = struct.Struct("<4sIII")   # magic, documents, bytes of the directory, crc32 of the directory
def byte_symbols() -> list[str]:
    """The byte-level alphabet: printable Latin-1 characters stand for
    themselves, the other bytes for 256, 257, ... in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b if b in printable else 256 + others.index(b)) for b in range(256)]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


_SEP, _LETTER, _MARK, _OTHER = 0, 1, 2, 3


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte, and the byte with ASCII case folded."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[33:127] = _MARK
    kind[list(b"'<0123456789")] = _OTHER      # contractions, special tokens, single digits
    kind[65:91] = kind[97:123] = _LETTER
    kind[[32, 9, 10, 11, 12, 13]] = _SEP
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return kind, fold


_KIND, _FOLD = _byte_tables()


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(folded bytes, begin, end, document, all letters?) of the pieces of a slice
    that can be tokenised one by one.

    The pre-tokeniser never joins across white space, and it cuts between
    letters and punctuation.  A word of unaccented and Latin-1 letters and of
    ASCII punctuation is cut there and its case folded, which is all that
    normalisation does to it; any other word (digits, apostrophes, special
    tokens, other scripts) is one piece, unchanged.
    """
    kind, data = _KIND[raw], _FOLD[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) if len(raw) else np.zeros(0, np.int64)
    after = raw[lead + 1]
    letter = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
    lead, after = lead[letter], after[letter]
    kind[lead] = kind[lead + 1] = _LETTER
    data[lead + 1] = after + np.where(after <= 0x9E, 0x20, 0).astype(np.uint8)
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind != _SEP
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begins[cut] = inside[1:][cut]
    ends[cut] = inside[:-1][cut]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    others = np.zeros(n + 1, np.int32)
    np.cumsum(kind == _OTHER, out=others[1:])
    whole = np.flatnonzero(others[last] > others[first])
    if len(whole):                                   # these stay as they are
        size = last[whole] - first[whole]
        at = np.repeat(first[whole] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        data[at] = raw[at]
        kind[at] = _OTHER
    inner = np.flatnonzero((kind[1:] != kind[:-1]) & inside[2:-1] & inside[1:-2]) + 1 if n > 1 else first[:0]
    inner = inner[~begins[inner]]
    begins[inner] = ends[inner] = True
    begin = np.flatnonzero(begins)
    return data, begin, np.flatnonzero(ends), np.searchsorted(offsets, begin, "right") - 1, kind[begin] == _LETTER


class UnitTable:
    """Ids of pieces, by a 64-bit hash of bytes and length, kept between the
    tasks of a worker.  Lookups are array operations on an open-addressed table; a piece is
    tokenised once for each ``limit`` pieces (the table then starts afresh, which bounds
    memory and changes nothing else)."""

    def __init__(self, path: str, slots: int = 1 << 21, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.slots, self.limit = Tokenizer.from_file(path), slots, limit
        self.merges, self.symbols = self.tokenizer.model.tokenize, "".join(byte_symbols())
        self.mark = self.tokenizer.token_to_id("<|endoftext|>")
        self._clear()

    def _clear(self) -> None:
        while self.slots < 2 * self.limit:
            self.slots *= 2
        self.keys, self.entry = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.size, self.first = np.zeros(self.limit, np.int32), np.zeros(self.limit, np.int64)
        self.pool, self.used, self.known = np.zeros(1 << 20, np.uint32), 0, 0

    def _tokenise(self, pieces: list[bytes], letters: list[bool]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        rest = []
        for i, (piece, only_letters) in enumerate(zip(pieces, letters)):
            if only_letters:                          # straight to the vocabulary's merges
                text = piece.decode("latin-1")
                out[i] = [t.id for t in self.merges(text if text.isascii() else text.translate(self.symbols))]
            elif b"<|" in piece:
                out[i] = self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
            else:
                rest.append(i)
        for at in range(0, len(rest), 500):       # together, kept apart by a special token
            some = rest[at:at + 500]
            ids = np.array(self.tokenizer.encode("<|endoftext|>".join(pieces[i].decode() for i in some),
                                                 add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(some) - 1:
                raise RuntimeError("the tokenizer joined or lost pieces")
            flat, begin = ids.tolist(), 0
            for i, stop in zip(some, [*cuts.tolist(), len(ids)]):
                out[i] = flat[begin:stop]
                begin = stop + 1
        return out

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(self.slots - 1)).astype(np.int64)

    def _add(self, h: np.ndarray, pieces: list[bytes], letters: list[bool]) -> np.ndarray:
        """Entries of new pieces (distinct hashes)."""
        ids = self._tokenise(pieces, letters)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used:self.used + len(flat)] = flat
        entries = np.arange(self.known, self.known + len(ids))
        self.size[entries], self.first[entries] = size, self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.known += len(ids)
        todo, slot = np.arange(len(h)), self._slot(h)
        while len(todo):                             # into the next free slot
            free = self.keys.take(slot) == 0
            self.keys[slot[free]] = h[todo[free]]
            in_place = self.keys.take(slot) == h[todo]       # where several want one slot, one has it
            self.entry[slot[in_place]] = entries[todo[in_place]]
            todo, slot = todo[~in_place], slot[~in_place] + 1 & self.slots - 1
        return entries

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entries of pieces, -1 for those not known."""
        slot = self._slot(h)
        key = self.keys.take(slot)
        found = np.where(key == h, self.entry.take(slot), -1)
        todo = np.flatnonzero((key != h) & (key != 0))
        slot = slot[todo]
        while len(todo):
            slot = slot + 1 & self.slots - 1
            key = self.keys.take(slot)
            same = key == h[todo]
            found[todo[same]] = self.entry.take(slot[same])
            on = ~same & (key != 0)
            todo, slot = todo[on], slot[on]
        return found

    def ids(self, raw: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a slice, ids for each text), the end id included."""
        data, begin, stop, doc, letters = units(raw, offsets)
        h = W.spans_hash(W.prefix(data, W.BYTES_A), begin, stop, W.BYTES_A) | np.uint64(1)
        entry = self._find(h)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            u, at, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            if self.known + len(u) > self.limit:
                self.limit = max(self.limit, len(u) * 4)
                self._clear()
                return self.ids(raw, offsets, end)
            text = data.tobytes()
            pieces = [text[p:q] for p, q in zip(begin[miss[at]].tolist(), stop[miss[at]].tolist())]
            entry[miss] = self._add(u, pieces, letters[miss[at]].tolist())[inverse]
        size, first = self.size[entry].astype(np.int64), self.first[entry]
        total, n = int(size.sum()), len(offsets) - 1
        before = np.cumsum(size) - size
        step = np.arange(total)
        out = np.full(total + n, end, np.uint32)
        out[step + np.repeat(doc, size)] = self.pool[np.repeat(first - before, size) + step]
        return out, np.bincount(doc, weights=size, minlength=n).astype(np.int64) + 1


_TABLES: dict[str, UnitTable] = {}


def unit_table(path: str) -> UnitTable:
    """One table for each worker process."""
    if path not in _TABLES:
        _TABLES[path] = UnitTable(path)
    return _TABLES[path]


def pack(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    directory = zlib.compress(np.array(counts, "<u4").tobytes() + known.tobytes()
                              + np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    return _DIRECTORY.pack(b"WTD1", len(counts), len(directory), zlib.crc32(directory)) + directory + idcoder.encode(ids)


def unpack(block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, ids for each document, all ids); ValueError if damaged."""
    magic, n, size, crc = _DIRECTORY.unpack_from(block)
    directory = block[_DIRECTORY.size:_DIRECTORY.size + size]
    if magic != b"WTD1" or zlib.crc32(directory) != crc:
        raise ValueError("damaged block directory")
    raw = zlib.decompress(directory)
    counts = np.frombuffer(raw, "<u4", n).astype(np.int64)
    known, doc = np.frombuffer(raw, np.uint8, n, 4 * n), np.frombuffer(raw, "<i8", n, 5 * n)
    return ([d if k else None for d, k in zip(doc.tolist(), known.tolist())], counts,
            idcoder.decode(block[_DIRECTORY.size + size:]))


def _encoder(path: str | None, block_ids: int):
    def job(batches):
        table = unit_table(path or default_tokenizer())
        part = TaskContext.get().partitionId()
        docs, counts, held, size, start, number = [], [], [], 0, 0, 0

        def block():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([size], pa.int64()), pa.array([len(docs)], pa.int32()),
                 pa.array([pack(docs, counts, np.concatenate(held))], pa.binary())],
                ["part", "block", "start", "n_ids", "n_docs", "data"])

        for b in batches:
            for lo, hi, raw, off in W.slices(b["text"]):
                ids, n = table.ids(raw, off, END_ID)
                names, cut = b["doc_id"].slice(lo, hi - lo).to_pylist(), np.cumsum(n)
                at = 0
                while at < hi - lo:        # as many documents as fill the block
                    done = int(cut[at - 1]) if at else 0
                    to = min(int(np.searchsorted(cut, done + block_ids - size)) + 1, hi - lo)
                    docs += names[at:to]
                    counts += n[at:to].tolist()
                    held.append(ids[done:int(cut[to - 1])])
                    size += len(held[-1])
                    at = to
                    if size >= block_ids:
                        yield block()
                        start, number = start + size, number + 1
                        docs, counts, held, size = [], [], [], 0
        if docs:
            yield block()
    return job


def write_blocks(docs: DataFrame, tokenizer: str | None = None, block_ids: int = 1 << 21,
                 partitions: int | None = None) -> DataFrame:
    """Write the documents as blocks, in ascending doc_id order (part, block),
    to the shared folder; returns the table of what was written."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(n, "doc_id", "th").sortWithinPartitions("doc_id", "th")
    return materialise(ordered.select("doc_id", "text").mapInArrow(
        _encoder(tokenizer, block_ids), "part int, block int, start long, n_ids long, n_docs int, data binary"),
        "token-blocks")


def _decode(batches):
    for b in batches:
        for base, data in zip(b["base"].to_pylist(), b["data"]):
            doc_ids, counts, ids = unpack(data.as_buffer().to_pybytes())
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[e - c:e]) for e, c in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(base + ends - counts), pa.array(counts),
                 pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Decode a block table: doc_id, start, n_tokens, ids_crc32 per document."""
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = SparkWindow.orderBy("part").rowsBetween(SparkWindow.unboundedPreceding, -1)
    # one row for each range partition of the writer
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return (blocks.join(F.broadcast(bases), "part")
            .select((F.col("first") + F.col("start")).alias("base"), "data")
            .mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_output(docs: DataFrame, **options) -> DataFrame:
    """Encode, write, and read the files back."""
    return read_blocks(write_blocks(docs, **options))

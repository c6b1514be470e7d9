"""Block codec for token ids: adaptive context mixing drives a range coder.

A block is self-contained: every model starts from its reset state, and the
header carries a CRC-32 of the decoded ids.  Its ids are cut into ``lanes``
of equal length that advance together, one id a step; each lane has a range
coder of its own, all lanes share one model, which learns a step's ids at
once.  Every step is therefore a few NumPy operations over all lanes.

Model.  The order-2 and order-1 contexts (the lane's last two ids, its last
one) each predict one id, with a confidence from 0 to 7.  The probability that
the order-2 prediction is right mixes, in the logistic domain with learned
weights, three experts: how often order 2 was right at this confidence, how
often it was at order 1's confidence (given whether both agree), and the
predicted id's order-0 frequency, in 16 levels.  What remains is shared between
the order-1 prediction and an escape to the adaptive order-0 frequencies.

The two confidences, agreement and level make 2,048 mixing contexts.  The
symbols' intervals are worked out once a step for each context and looked up by
the lanes; one count of (context, symbol) is all that learning needs.  It takes in every
id of every step, and changes the intervals every fourth step (at first every step).
All model arithmetic is on integers, so that any machine decodes what another one wrote.
"""
from __future__ import annotations

import struct
import zlib
from decimal import Decimal, getcontext

import numpy as np

MAGIC = b"WTB2"
_U = np.uint64
_HEAD = struct.Struct("<4sIIIII")   # magic, ids, lanes, crc32 of ids, vocabulary, bytes of lane sizes
_HASH2 = 18                         # log2 of the order-2 table
_REBUILD = 16                       # steps between rebuilds of the order-0 totals
_MOST = 1 << 20                     # bound of the order-0 total without the 1 that each id has
_TOGETHER = 4                       # steps that change the intervals together
_ESCAPE = 512                       # least share (of 65536) that the two predictions leave
_HALF, _LOW32 = _U(1 << 32), _U(0xFFFFFFFF)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """squash: x / 256 -> probability of 4096; stretch: its inverse."""
    getcontext().prec = 30
    squash = np.array([int(Decimal(4096) / (1 + (Decimal(-x) / 256).exp())) for x in range(-2047, 2048)], np.int64)
    squash = np.clip(squash, 1, 4095)
    stretch = np.searchsorted(squash, np.arange(4096)).astype(np.int64) - 2047
    return squash, np.clip(stretch, -2047, 2047)


_SQUASH, _STRETCH = _tables()


_LEVELS, _CELLS = 16, 128             # a cell: order-2 confidence, agreement, order-1 confidence
_CELL = np.arange(_CELLS)
_K2, _C1, _SET = _CELL >> 4, _CELL & 15, _CELL >> 3
_IN0 = (np.arange(_LEVELS, dtype=np.int64) * 128 - 2048 + 64)[:, None]      # a level's order-0 input
_SYMBOL = _LEVELS * _CELLS            # place of a symbol (escape, order 1, order 2) in a context: symbol, level, cell


class _Model:
    def __init__(self, vocabulary: int, slots: bool = False):
        # an entry: predicted id * 8 + confidence
        self.order2, self.order1 = np.zeros(1 << _HASH2, np.int64), np.zeros(vocabulary, np.int64)
        self.count, self.fresh, self.places = np.zeros(vocabulary, np.int64), [], []
        self.right2, self.seen2 = np.zeros(8, np.int64), np.zeros(8, np.int64)
        self.right1, self.seen1 = np.zeros(16, np.int64), np.zeros(16, np.int64)
        self.only1, self.missed = np.zeros(_CELLS, np.int64), np.zeros(_CELLS, np.int64)
        self.weights = np.full((3, 16), 22000, np.int64)     # of 65536
        self.begin, self.size = np.zeros((3, _LEVELS, _CELLS), np.int64), np.zeros((3, _LEVELS, _CELLS), np.int64)
        self.begins, self.sizes = self.begin.reshape(-1), self.size.reshape(-1)
        self.begins2, self.begins1 = self.begin[2].reshape(-1), self.begin[1].reshape(-1)
        self.name = np.arange(vocabulary, dtype=np.uint16 if vocabulary <= 1 << 16 else np.uint32) if slots else None
        self.step = 0
        self._mix()

    def predict(self, p1: np.ndarray, p2: np.ndarray) -> None:
        """``context``: level and cell of each lane."""
        if self.step % _REBUILD == 0 or self.step < 4:
            self._order0()
        self.p1, self.h2 = p1, (p1 * 40503 + p2 * 2654435 + (p2 >> 3)) & ((1 << _HASH2) - 1)
        self.e2, self.e1 = self.order2.take(self.h2, mode="clip"), self.order1.take(p1, mode="clip")
        self.q2, self.q1 = self.e2 >> 3, self.e1 >> 3
        self.k2, self.k1 = self.e2 & 7, self.e1 & 7
        self.context = self.level.take(self.q2, mode="clip")
        self.context += self.k2 << 4
        self.context += (self.q1 == self.q2).view(np.int8) << 3
        self.context += self.k1

    def _order0(self) -> None:
        if self.fresh:
            self.count += np.bincount(np.concatenate(self.fresh), minlength=len(self.count))
            self.fresh = []
        seen, less = int(self.count.sum()) << 4, 0
        while seen >> less > _MOST:
            less += 1
        freq = ((self.count << 4) >> less) + 1
        self.cum = np.zeros(len(freq) + 1, np.int64)
        np.cumsum(freq, out=self.cum[1:])
        self.total = int(self.cum[-1])
        st0 = _STRETCH.take(np.minimum(freq * 4096 // self.total, 4095))
        self.level = np.clip((st0 + 2048) >> 7, 0, _LEVELS - 1) * _CELLS
        if self.name is not None:                # the id that each number below the total stands for
            self.slot = np.repeat(self.name, freq)

    def _mix(self) -> None:
        """The intervals of all contexts from what the cells' predictions were worth."""
        self.st2 = _STRETCH[(self.right2 * 4096 + 512) // (self.seen2 + 1)][_K2]
        self.st1 = _STRETCH[(self.right1 * 4096 + 512) // (self.seen1 + 1)][_C1]
        w = self.weights[:, _SET]
        dot = w[2] * _IN0
        dot += w[0] * self.st2 + w[1] * self.st1 + (2047 << 16)
        dot >>= 16
        self.p = _SQUASH.take(dot, mode="clip")
        share1 = np.clip((self.only1 * 65536 + 8192) // (self.missed + 1), 256, 64000)
        share1[_C1 >= 8] = 0                                  # both predict the same id
        f2 = np.minimum(self.p << 4, 65536 - 2 * _ESCAPE, out=self.size[2])
        rest = np.subtract(65536, f2, out=self.begin[2])      # order 2 lies above this
        f1 = np.multiply(rest - _ESCAPE, share1, out=self.size[1])
        f1 >>= 16
        np.subtract(rest, f1, out=self.begin[1])              # the escape lies below this
        self.size[0] = self.begin[1]

    def learn(self, x: np.ndarray, hit1: np.ndarray, hit2: np.ndarray, place: np.ndarray) -> None:
        """The step's ids; ``place`` is the symbol's in the context."""
        self.order2[self.h2] = _next(self.e2, self.k2, hit2, x)
        self.order1[self.p1] = _next(self.e1, self.k1, hit1, x)
        self.fresh.append(x)
        self.places.append(place)
        self.step += 1
        if self.step % _TOGETHER == 0 or self.step < 16:
            self._take_in(np.concatenate(self.places))
            self.places = []

    def _take_in(self, places: np.ndarray) -> None:
        """What the predictions of the steps since the last time were worth."""
        count = np.bincount(places, minlength=3 * _SYMBOL).reshape(3, _LEVELS, _CELLS)
        by_cell = count.sum(1)
        hits, n = by_cell[2], by_cell.sum(0)
        n2, hits2 = n.reshape(8, 16), hits.reshape(8, 16)
        self.seen2 += n2.sum(1)
        self.right2 += hits2.sum(1)
        self.seen1 += n2.sum(0)
        self.right1 += hits2.sum(0)
        self.missed += n - hits
        self.only1 += by_cell[1]
        # weights: the mean gradient of the ids with one order-2 confidence and agreement
        error = (count[2] << 12) - self.p * count.sum(0)
        errors = error.sum(0)
        gradient = np.stack([errors * self.st2, errors * self.st1, (error * _IN0).sum(0)])
        self.weights += gradient.reshape(3, 16, 8).sum(2) // (np.maximum(n.reshape(16, 8).sum(1), 1) * 100)
        np.clip(self.weights, -1 << 18, 1 << 18, out=self.weights)
        self._mix()


#: Added to an entry's confidence k: after a miss (k becomes k // 2), after a hit.
_STEP = np.array([0, -1, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0])


def _next(entry: np.ndarray, k: np.ndarray, hit: np.ndarray, x: np.ndarray) -> np.ndarray:
    after = entry + _STEP.take(k + (hit.view(np.int8) << 3), mode="clip")
    new = np.flatnonzero((k == 0) > hit)             # a miss without confidence
    after[new] = (x.take(new) << 3) + 1
    return after


def lanes_for(n: int) -> int:
    return max(1, min(8192, n // 256))


def encode(ids: np.ndarray, vocabulary: int = 49408) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    if n and int(ids.max()) >= vocabulary:
        raise ValueError("id outside the vocabulary")
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.uint32)       # a step's ids are widened when their turn comes
    grid[:n] = ids
    grid = grid.reshape(lanes, steps).T.copy()
    model = _Model(vocabulary)
    # 16 bits leave at the top when the range falls below 2^32; carries are settled at the end
    low, rng = np.zeros(lanes, _U), np.full(lanes, 1 << 48, _U)
    owners, words = [], []

    def flush(which: np.ndarray) -> None:
        v = low.take(which)
        owners.append(which.astype(np.uint16))
        words.append((v >> _U(32)).astype(np.uint32))
        low[which] = (v & _LOW32) << _U(16)
        rng[which] = rng.take(which) << _U(16)

    p1 = p2 = np.zeros(lanes, np.int64)
    for t in range(steps):
        m = -(-(n - t) // steps)           # lanes that still have an id
        x, p1, p2 = grid[t, :m].astype(np.int64), p1[:m], p2[:m]
        model.predict(p1, p2)
        hit2, hit1 = x == model.q2, x == model.q1
        one, missed = hit1 > hit2, ~(hit1 | hit2)
        place = model.context + (hit2 * (2 * _SYMBOL) + one * _SYMBOL)
        r = rng[:m] >> _U(16)
        low[:m] += r * model.begins.take(place, mode="clip").view(_U)
        rng[:m] = r * model.sizes.take(place, mode="clip").view(_U)
        e = np.flatnonzero(missed)
        if len(e):
            xe = x.take(e)
            a, b = model.cum.take(xe), model.cum.take(xe + 1)
            r = rng.take(e) // _U(model.total)
            low[e] += r * a.view(_U)
            rng[e] = r * (b - a).view(_U)
        small = np.flatnonzero(rng[:m] < _HALF)
        while len(small):
            flush(small)
            small = small[rng.take(small) < _HALF]
        model.learn(x, hit1, hit2, place)
        p1, p2 = x, p1
    for _ in range(3):
        flush(np.arange(lanes))
    owner = np.concatenate(owners)
    counts = np.bincount(owner, minlength=lanes)
    out = np.concatenate(words)[np.argsort(owner, kind="stable")]
    while (carry := out >> 16).any():                # carries run towards the front
        out &= 0xFFFF
        out[:-1] += carry[1:]
    body = out.astype("<u2").tobytes()
    sizes = zlib.compress(counts.astype("<u4").tobytes())
    return _HEAD.pack(MAGIC, n, lanes, zlib.crc32(ids), vocabulary, len(sizes)) + sizes + body


def decode(block: bytes) -> np.ndarray:
    """Ids of a block; ValueError if it is damaged."""
    if len(block) < _HEAD.size:
        raise ValueError("not a token block")
    magic, n, lanes, crc, vocabulary, size = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a token block")
    try:
        counts = np.frombuffer(zlib.decompress(block[_HEAD.size:_HEAD.size + size]), "<u4").astype(np.int64)
        words = np.frombuffer(block, "<u2", offset=_HEAD.size + size)
    except (zlib.error, ValueError) as e:
        raise ValueError("damaged token block") from e
    if lanes != lanes_for(n) or len(counts) != lanes or int(counts.min()) < 3 or int(counts.sum()) != len(words):
        raise ValueError("damaged token block")
    steps = -(-n // lanes)
    at = np.cumsum(counts) - counts
    code = np.zeros(lanes, _U)
    for _ in range(3):
        code = (code << _U(16)) | words[at].astype(_U)
        at += 1
    rng = np.full(lanes, 1 << 48, _U)

    def refill(which: np.ndarray) -> None:
        to = at.take(which)
        code[which] = (code.take(which) << _U(16)) | words.take(to, mode="clip").astype(_U)
        at[which] = to + 1
        rng[which] = rng.take(which) << _U(16)

    model = _Model(vocabulary, slots=True)
    grid = np.zeros((steps, lanes), np.uint32)
    p1 = p2 = np.zeros(lanes, np.int64)
    for t in range(steps):
        m = -(-(n - t) // steps)
        p1, p2 = p1[:m], p2[:m]
        model.predict(p1, p2)
        r = rng[:m] >> _U(16)
        v = np.minimum(code[:m] // r, _U(65535)).view(np.int64)
        above1 = v >= model.begins1.take(model.context, mode="clip")
        two = v >= model.begins2.take(model.context, mode="clip")
        place = model.context + (above1 * _SYMBOL + two * _SYMBOL)
        code[:m] -= r * model.begins.take(place, mode="clip").view(_U)
        rng[:m] = r * model.sizes.take(place, mode="clip").view(_U)
        x = np.where(two, model.q2, model.q1)
        e = np.flatnonzero(~above1)
        if len(e):
            r, c = rng.take(e) // _U(model.total), code.take(e)
            got = model.slot.take(np.minimum(c // r, _U(model.total - 1)).view(np.int64)).astype(np.int64)
            a, b = model.cum.take(got), model.cum.take(got + 1)
            code[e] = c - r * a.view(_U)
            rng[e] = r * (b - a).view(_U)
            x[e] = got
        small = np.flatnonzero(rng[:m] < _HALF)
        while len(small):
            refill(small)
            small = small[rng.take(small) < _HALF]
        model.learn(x, x == model.q1, two, place)
        grid[t, :m] = x
        p1, p2 = x, p1
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype("<u4", copy=False)
    if zlib.crc32(ids) != crc:
        raise ValueError("checksum of a token block differs")
    return ids

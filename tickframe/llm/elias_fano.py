"""Elias-Fano coded monotone sequences over numpy buffers, and the flat layout that holds several of them in one mappable file."""
from __future__ import annotations

import struct

import numpy as np

U = np.uint64
ONES, HIGHS = U(0x0101010101010101), U(0x8080808080808080)
#: Place of the r-th set bit of a byte.
PLACE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)


def byte_sums(w: np.ndarray) -> np.ndarray:
    """Set bits of each word up to and with each of its bytes, a byte each."""
    w = w - ((w >> U(1)) & U(0x5555555555555555))
    w = (w & U(0x3333333333333333)) + ((w >> U(2)) & U(0x3333333333333333))
    return ((w + (w >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * ONES


def select_in(w: np.ndarray, sums: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th (from 0) set bit of each word, sums = byte_sums(w)."""
    over = (((r * ONES) | HIGHS) - sums) & HIGHS
    at = (((over >> U(7)) * ONES) >> U(56)) << U(3)
    left = r - (((sums << U(8)) >> at) & U(255))
    return at + PLACE[((w >> at) & U(255)).astype(np.int64), left.astype(np.int64)]


def _words(place: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Words that hold the values at ascending word places; values of one place do not overlap."""
    out = np.zeros(size, U)
    if len(place):
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        out[place[starts]] = np.add.reduceat(value, starts)
    return out


#: Values coded at a time, a multiple of 64.
BLOCK = 1 << 18


def encode(values: np.ndarray) -> list[np.ndarray]:
    """(head, low, high) of a non-decreasing sequence: floor(log2(last / n)) low bits of each value packed, the upper parts in unary."""
    n = len(values)
    last = int(values[-1]) if n else 0
    bits = max(0, (last // n).bit_length() - 1) if n else 0
    lows = np.zeros(n * bits // 64 + 2 if bits else 1, U)
    high = np.zeros(((last >> bits) + n) // 64 + 2, U)  # ends with zeros, so that every bucket is closed
    for at in range(0, n, BLOCK):
        x = values[at : at + BLOCK].astype(U)
        i = np.arange(len(x), dtype=U)
        if bits:  # a block's low bits begin at a word
            low = x & U((1 << bits) - 1)
            pos = i * U(bits)
            w, off = (pos >> U(6)).astype(np.int64), pos & U(63)
            mine = lows[at * bits // 64 :]
            some = _words(w, low << off, int(w[-1]) + 1)
            mine[: len(some)] |= some
            cross = np.flatnonzero(off + U(bits) > U(64))
            mine[w[cross] + 1] |= low[cross] >> (U(64) - off[cross])
        p = (x >> U(bits)) + i + U(at)
        w = (p >> U(6)).astype(np.int64)
        some = _words(w - w[0], U(1) << (p & U(63)), int(w[-1] - w[0]) + 1)
        high[w[0] : w[0] + len(some)] |= some
    return [np.array([n, bits], U), lows, high]


class EliasFano:
    """A sequence over its buffers, which are only looked at where needed; the counts of bits per word are made when it is opened."""

    def __init__(self, head, low, high):
        self.n, self.bits = int(head[0]), U(int(head[1]))
        self.low, self.high = low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones)))
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        before = self.ones if ones else self.zeros
        w = np.searchsorted(before, k, side="right") - 1
        word = self.high[w] if ones else ~self.high[w]
        return w * 64 + select_in(word, byte_sums(word), (k - before[w]).astype(U)).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        pos = i.astype(U) * self.bits
        w, off = (pos >> U(6)).astype(np.int64), pos & U(63)
        more = np.where(off > 0, self.low[w + 1] << (U(64) - np.maximum(off, U(1))), U(0))
        return ((self.low[w] >> off) | more) & U((1 << int(self.bits)) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at some indices."""
        return ((self._select(i, True) - i).astype(U) << self.bits) | self._low(i)

    def _search(self, x: np.ndarray):
        """(index of the first value not less than x in its bucket, end of the bucket, low bits wanted, is x beyond all buckets)."""
        x = x.astype(U)
        up = (x >> self.bits).astype(np.int64)
        beyond = up >= int(self.zeros[-1])
        up = np.where(beyond, 0, up)
        at = np.where(up > 0, self._select(np.maximum(up - 1, 0), False) + 1, 0)  # where the bucket's ones begin
        lo = at - up
        w, off = at >> 6, (at & 63).astype(U)
        rest = ~(self.high[w] >> off)
        run = np.bitwise_count((rest & (~rest + U(1))) - U(1)).astype(np.int64)
        end = lo + run
        over = np.flatnonzero(run >= 64 - off.astype(np.int64))  # the run goes on in the next word
        end[over] = self._select(up[over], False) - up[over]
        hi = end.copy()
        want = x & U((1 << int(self.bits)) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo, end, want, beyond

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not less than each x (n where there is none): the bucket of its upper part, then a binary search on low bits."""
        if not len(x):
            return np.zeros(0, np.int64)
        lo, _, _, beyond = self._search(x)
        return np.where(beyond, self.n, np.minimum(lo, self.n))

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x in a strictly ascending sequence, or -1."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        at, end, want, beyond = self._search(x)
        here = ~beyond & (at < end)
        here[here] = self._low(at[here]) == want[here]
        return np.where(here, at, -1)


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each at a multiple of eight bytes, behind a table of (type, length)."""
    head = struct.pack("<q", len(arrays)) + b"".join(struct.pack("<8sq", a.dtype.str.encode().ljust(8), len(a)) for a in arrays)
    body = b"".join(np.ascontiguousarray(a).tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0") for a in arrays)
    return head + body


def mapped(buffer) -> list[np.ndarray]:
    """The arrays of a packed buffer (bytes, an Arrow buffer or a memory map of a file), without copies."""
    view = memoryview(buffer)
    (count,) = struct.unpack_from("<q", view, 0)
    at, out = 8 + 16 * count, []
    for i in range(count):
        kind, n = struct.unpack_from("<8sq", view, 8 + 16 * i)
        dtype = np.dtype(kind.strip().decode())
        out.append(np.frombuffer(view, dtype, n, at))
        at += -(-n * dtype.itemsize // 8) * 8
    return out

"""Vectorised text kernels over Arrow string columns, for use inside mapInArrow tasks.

They work on a whole batch of texts at once: one byte buffer, offsets of the texts, offsets of the words.
Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which no multi-byte UTF-8 sequence contains.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 4 << 20


def slices(batches, column="text", limit=SLICE_BYTES):
    """Cut record batches so that each piece holds about `limit` bytes of `column`; one longer text stands alone."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        lo = 0
        for hi in [*cuts.tolist(), b.num_rows]:
            yield b.slice(lo, hi - lo)
            lo = hi
    pa.default_memory_pool().release_unused()  # a worker waits idle between tasks, beside the next stage's


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    raw = pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if raw else "")
    arr = arr.cast(pa.large_binary() if raw else pa.large_string())
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def strings(buf: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])


@dataclass
class Words:
    """Words of a batch: `start`/`end` bytes, `first[d]:first[d+1]` are the words of text d, `doc` their text."""

    buf: np.ndarray
    offs: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    solid: np.ndarray

    @property
    def n(self):
        return np.diff(self.first)

    @property
    def doc(self):
        return np.repeat(np.arange(len(self.offs) - 1), self.n)

    def encode(self) -> tuple[np.ndarray, pa.Array]:
        """Code of each word, and the distinct words."""
        offs = np.concatenate(([0], np.cumsum(self.end - self.start)))
        d = strings(self.buf[self.solid], offs).dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def words(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that the table `space` does not mark."""
    solid = ~space[buf]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    some = offs[:-1][offs[:-1] < offs[1:]]
    begin[some] = solid[some]
    last[some[1:] - 1] = solid[some[1:] - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return Words(buf, offs, start, end, np.searchsorted(start, offs), solid)


def per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask marks."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a fixed bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(uniq: pa.Array) -> np.ndarray:
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in uniq.to_pylist()), np.uint64, len(uniq))

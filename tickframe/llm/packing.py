"""Bounded-space online packing of documents into token sequences (operator 4).

Each partition of the scan tokenizes its documents, cuts them into full sequences and a remainder, and keeps at most OPEN_WINDOWS open
windows for remainders: best fit; when none fits and all are in use, the fullest is emitted.  Windows still open at a partition's end are
leftovers; they are few (at most OPEN_WINDOWS per partition), so groups of MERGED partitions are packed again, largest piece first, cutting a
piece where a window would else stay short.  Ids are those of the `tokenizers` file; pieces carry them as little-endian uint32.

A null text is empty (one token, the end id); repeated rows are documents of their own; very long texts are cut.  Sequence ids are unique and follow
from the partition's number, so that a task that runs again gives the same rows.  An empty table gives no rows.
"""
from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .common import written

WINDOW = 1024
OPEN_WINDOWS = 64
MERGED = 64
END_ID = 0
SPECIAL = b"<|endoftext|>"
#: Encoded segments that a worker remembers (a cache: it changes no result).
REMEMBERED = 300_000
#: Bytes of text encoded at once, and rows handed on at once, of 4 KB each: a worker's memory goes by them, and an executor has one per core.
SLICE_BYTES, SENT_ROWS = 1 << 20, 250


def segment_cuts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte offsets of segments.  The pre-tokenizer's pattern never lets a token run across them: from a non-space to a space, and from a
    letter to a punctuation sign; where the byte before is ASCII or the end of a Latin-1 letter, this is safe to tell."""
    ascii_letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    letter = ascii_letter.copy()
    letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0xBF) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    space = K.SPACE[buf]
    plain = (buf < 128) & ~space & (buf > 32)
    sign = plain & ~ascii_letter & ~((buf >= 48) & (buf <= 57))
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:-1] = (space[1:] & (plain | letter)[:-1]) | (sign[1:] & letter[:-1])
    data = buf.tobytes()
    at = data.find(SPECIAL)
    while at >= 0:  # the tokenizer takes this string whole
        cut[at + 1 : at + len(SPECIAL)] = False
        at = data.find(SPECIAL, at + 1)
    cut[offs] = True
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of whole batches; every distinct segment is encoded once."""

    def __init__(self, path: str, fast_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        if fast_path:
            import base64

            import tiktoken

            with open(fast_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, bytes] = {}

    def encode(self, seg: bytes) -> bytes:
        """The ids as little-endian uint32: as bytes they take a third of an array's memory."""
        # the ranks hold the same vocabulary; other alphabets and special strings go through the tokenizer itself
        text = seg.decode()
        if self.fast is not None and (not seg or max(seg) < 0xC4) and b"<|" not in seg:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def batch(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by END_ID, and the offsets of the texts."""
        buf, offs = K.flat(arr)
        cuts = segment_cuts(buf, offs) if len(buf) else np.zeros(1, np.int64)
        d = K.strings(buf, cuts).dictionary_encode()
        code = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        table = []
        for seg in d.dictionary.to_pylist():
            ids = self.known.get(seg)
            if ids is None:
                ids = self.encode(seg)
                if len(self.known) < REMEMBERED and len(seg) < 40:
                    self.known[seg] = ids
            table.append(ids)
        table.append(np.array([END_ID], "<u4").tobytes())
        size = np.array([len(x) // 4 for x in table])
        begin = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(table), "<u4")
        at = np.searchsorted(cuts[:-1], offs[1:])  # after the last segment of each text
        code = np.insert(code, at, len(table) - 1)
        n = size[code]
        ends = np.cumsum(n)
        ids = pool[np.repeat(begin[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        closing = at + np.arange(len(at))
        return ids, np.concatenate(([0], ends[closing]))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("left", pa.binary())])
DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, left binary"


def _sent(rows, flush=SENT_ROWS):
    while len(rows) >= flush:
        part, rows[:flush] = rows[:flush], []
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def _pack(path, fast_path, pattern, window, open_windows):
    def run(batches):
        enc = Encoder(path, fast_path, pattern)
        part = TaskContext.get().partitionId()
        seq = 0
        rows: list = []
        room: list = []  # (tokens left, number) of open windows, in order
        held: dict = {}

        def emit(number, kept):
            nonlocal seq
            at = 0
            for doc, start, ids, total in held.pop(number):
                data = ids.astype("<u4").tobytes()
                rows.append((doc, start, len(ids), total, (part << 32) + seq, at, *((None, data) if kept else (data, None))))
                at += len(ids)
            seq += 1

        number = 0
        for b in K.slices(batches, limit=SLICE_BYTES):
            ids, cut = enc.batch(b.column("text"))
            for doc, lo, hi in zip(b.column("doc_id").to_pylist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                total = hi - lo
                whole = total // window * window
                for s in range(0, whole, window):
                    held[number] = [(doc, s, ids[lo + s : lo + s + window], total)]
                    emit(number, False)
                    number += 1
                rest = total - whole
                if rest:
                    piece = (doc, whole, ids[lo + whole : hi].copy(), total)
                    i = bisect.bisect_left(room, (rest, -1))
                    if i < len(room):
                        left, w = room.pop(i)
                        held[w].append(piece)
                        if left == rest:
                            emit(w, False)
                        else:
                            bisect.insort(room, (left - rest, w))
                    else:
                        if len(room) >= open_windows:
                            emit(room.pop(0)[1], False)
                        held[number] = [piece]
                        bisect.insort(room, (window - rest, number))
                        number += 1
                yield from _sent(rows)
        for _, w in room:
            emit(w, True)
        yield from _sent(rows)
        if rows:
            yield from _sent(rows, len(rows))

    return run


def _merge(window):
    def run(batches):
        base = (1 << 62) + (TaskContext.get().partitionId() << 32)
        pieces = [x for b in batches for x in zip(*(b.column(k).to_pylist() for k in ("length", "doc_id", "start", "doc_tokens", "ids")), strict=True)]
        pieces.sort(key=lambda x: (x[0], -1 if x[1] is None else x[1], x[2], x[4]))
        sizes = [x[0] for x in pieces]
        rows: list = []
        seq = 0
        while pieces:
            at = 0
            while pieces and at < window:
                i = bisect.bisect_right(sizes, window - at) - 1  # the largest piece that fits, else a cut of the largest one
                n, doc, start, total, ids = pieces.pop(max(i, 0) if i >= 0 else -1)
                sizes.pop(max(i, 0) if i >= 0 else -1)
                take = min(n, window - at)
                rows.append((doc, start, take, total, base + seq, at, ids[: 4 * take], None))
                at += take
                if take < n:
                    j = bisect.bisect_left(sizes, n - take)
                    pieces.insert(j, (n - take, doc, start + take, total, ids[4 * take :]))
                    sizes.insert(j, n - take)
            seq += 1
            yield from _sent(rows)
        if rows:
            yield from _sent(rows, len(rows))

    return run


def pack(docs: DataFrame, tokenizer: str, fast: str | None = None, pattern: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """docs(doc_id, text) -> pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids."""
    table = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(tokenizer, fast, pattern, window, open_windows), DDL), "zstd")
    closed = table.where("left is null").drop("left")
    open_ = table.where("left is not null").select("doc_id", "start", "length", "doc_tokens", "sequence_id", F.col("left").alias("ids"))
    parts = open_.select(F.shiftright("sequence_id", 32).alias("p")).agg(F.max("p")).head()[0] or 0
    groups = parts // MERGED + 1
    merged = open_.repartition(groups, F.floor(F.shiftright("sequence_id", 32) / MERGED)).mapInArrow(_merge(window), DDL).drop("left")
    return closed.unionByName(merged)

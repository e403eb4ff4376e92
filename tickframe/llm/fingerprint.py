"""Homomorphic multiset hash of paragraphs (operator 6).

A text is the multiset of its paragraphs (lines with a word).  Each paragraph is hashed to a wide vector, and the text's fingerprint is the sum of these
vectors, lane by lane modulo a power of two: any order of the paragraphs gives the same sum, and a paragraph is put in or taken out by adding or
subtracting its vector (`combine`).  The vector has two parts:

* DENSE lanes modulo 2^32, filled from two independent 64-bit hashes of the whole paragraph, half of the lanes each: these decide equality;
* LEVELS x LANES lanes modulo 2^8, to which the paragraph's word pairs are thrown, level l with probability 2^-(l+1): these tell how much two texts
  share.  Lanes that differ at a level estimate the size of the multiset difference (as strata do), lanes in use the sizes of the texts.

likeness = 1 - difference / sum of sizes, clipped to 0..1; equal fingerprints have 1.  Null texts are empty; the empty text has the zero vector (two empty
texts have likeness 1).  The text's next one is that of the next row by doc_id (ties: by text; null ids first); the last row's is the first.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .common import shuffle_partitions

DENSE, LEVELS, LANES = 8, 14, 32
SALT, SALT2 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def hash_words_128(uniq: pa.Array) -> np.ndarray:
    """Two 64-bit halves of a 128-bit hash of each word."""
    import xxhash

    h = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(h(w) for w in uniq.to_pylist()), "<u8").reshape(-1, 2)


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint lanes of each text: dense (n, DENSE) uint32, strata (n, LEVELS * LANES) uint8."""
    buf, offs = K.flat(texts)
    docs = len(offs) - 1
    w = K.words(buf, offs)
    if not len(w.start):
        return np.zeros((docs, DENSE), np.uint32), np.zeros((docs, LEVELS * LANES), np.uint8)
    code, uniq = w.encode()
    both = hash_words_128(uniq)
    h, h2 = K.mix(both[:, 0])[code], K.mix(both[:, 1])[code]
    doc = w.doc
    # a paragraph begins at a text's first word, and after a line break
    breaks = np.concatenate(([0], np.cumsum(buf == 10)))[w.start]
    head = np.ones(len(h), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (breaks[1:] != breaks[:-1])
    first = np.flatnonzero(head)
    para = np.cumsum(head) - 1
    place = (np.arange(len(h)) - first[para]).astype(np.uint64)
    with np.errstate(over="ignore"):
        # paragraph hash: words with their places, so that word order counts inside a paragraph; blanks do not
        ph = [K.mix(np.add.reduceat(K.mix(x + place * salt), first)) for x, salt in ((h, SALT), (h2, SALT2))]
        dense = np.zeros((docs, DENSE), np.uint32)
        of = doc[first]
        start = np.searchsorted(of, np.arange(docs))
        some = np.flatnonzero(np.bincount(of, minlength=docs))
        for i in range(DENSE):
            lane = K.mix(ph[i % 2] + np.uint64(i + 1) * SALT) >> np.uint64(32)
            dense[some, i] = np.add.reduceat(lane, start[some]).astype(np.uint32)
        # word pairs inside paragraphs (a one-word paragraph: the word with itself)
        nxt = np.append(h[1:], h[-1:])
        single = head & np.append(head[1:], True)
        last = np.append(head[1:], True) & ~single
        e = K.mix(h * np.uint64(3) + np.where(single, h, nxt) + SALT)[~last]
        doc = doc[~last]
    # the level: zeros at the end of the hash, from its lowest set bit
    low = (e | np.uint64(1 << (LEVELS - 1))) & (~(e | np.uint64(1 << (LEVELS - 1))) + np.uint64(1))
    level = np.log2(low.astype(np.float64)).astype(np.int64)
    lane = ((e >> np.uint64(20)) % np.uint64(LANES)).astype(np.int64)
    value = ((e >> np.uint64(40)) & np.uint64(255)).astype(np.float64)
    value[value == 0] = 1
    width = LEVELS * LANES
    s = np.bincount((doc * LEVELS + level) * LANES + lane, weights=value, minlength=docs * width)
    return dense, (s.astype(np.int64) & 255).astype(np.uint8).reshape(docs, width)


def combine(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Lanes of two multisets put together (sign 1), or of the first without the second (sign -1), modulo the lanes' power."""
    return (a.astype(np.int64) + sign * b.astype(np.int64)).astype(a.dtype)


def _estimate(busy: np.ndarray) -> np.ndarray:
    """Elements from busy lanes per level (n, LEVELS): the lowest level that is not crowded, scaled up by its sampling rate."""
    with np.errstate(divide="ignore"):
        n = -LANES * np.log1p(-np.minimum(busy, LANES - 0.5) / LANES)
    # levels from l on hold 2^-l of all elements; sum them for less noise
    tail = np.cumsum(n[:, ::-1], 1)[:, ::-1] * (2.0 ** np.arange(LEVELS))
    fit = busy <= 0.75 * LANES
    fit[:, -1] = True
    level = np.argmax(np.logical_and.accumulate(fit[:, ::-1], 1)[:, ::-1], 1)
    return tail[np.arange(len(busy)), level]


def likeness(a, b) -> np.ndarray:
    (da, sa), (db, sb) = a, b
    shape = (len(sa), LEVELS, LANES)
    size = [_estimate((s.reshape(shape) != 0).sum(2)) for s in (sa, sb)]
    diff = _estimate((sa != sb).reshape(shape).sum(2))
    total = size[0] + size[1]
    out = np.where(total > 0, np.clip(1 - diff / np.maximum(total, 1e-9), 0, 1), 1.0)
    return np.where((da == db).all(1) & (sa == sb).all(1), 1.0, np.minimum(out, 0.999999))


def hexes(v) -> list[str]:
    d, s = v
    return [x.tobytes().hex() + y.tobytes().hex() for x, y in zip(d.astype("<u4"), s, strict=True)]


def _edited_rows(batches):
    """Rows sorted by (bucket, ahead, doc_id, text); `ahead` rows are the next bucket's first ones and only serve as next texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    last = None  # (bucket, doc_id, text) that waits for its next text
    done: list = []
    size = 0

    def out():
        ids, texts, nexts = zip(*done, strict=True)
        edited = [t[: len(t) - len(t) // 4] + x[: len(t) // 4] for t, x in zip(texts, nexts, strict=True)]
        a, b, c = (vectors(pa.array(x, pa.large_string())) for x in (texts, edited, nexts))
        cols = [list(ids), [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited], hexes(a), hexes(b), likeness(a, b), likeness(a, c)]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    for b in batches:
        for bucket, ahead, doc, text in zip(*(b.column(k).to_pylist() for k in ("bucket", "ahead", "doc_id", "text")), strict=True):
            text = text or ""
            if last is not None and last[0] == bucket:
                done.append((last[1], last[2], text))
                size += len(last[2]) + len(text)
                if size > K.SLICE_BYTES:
                    yield out()
                    done, size = [], 0
            last = None if ahead else (bucket, doc, text)
    if done:
        yield out()


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> fingerprint of each text, of its edited text, and their likenesses.  One shuffle moves each text once: rows go to ranges
    of doc_id, and each range also gets the first row of the next one.  Bounds come from approximate quantiles of the ids, one per partition."""
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("o", F.coalesce("doc_id", F.lit(lowest)))
    parts = shuffle_partitions(spark)
    ids = rows.select("o")
    bounds = sorted({int(x) for x in ids.agg(F.percentile_approx("o", [i / parts for i in range(1, parts)], 10 * parts).alias("q")).head()[0] or []}) if parts > 1 else []
    # two levels of bounds: the number of comparisons stays near the root of their number
    step = max(1, int(len(bounds) ** 0.5))
    outer = bounds[step - 1 :: step]
    groups = [bounds[i : i + step] for i in range(0, len(bounds) + 1, step)]
    o = F.col("o")
    if bounds:
        table = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
        coarse = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in outer]), lambda x: x < o)) if outer else F.lit(0)
        inner = F.size(F.filter(F.get(table, F.col("coarse")), lambda x: x < o))
        bucketed = lambda d: d.withColumn("coarse", coarse).withColumn("bucket", F.col("coarse") * step + F.when(inner >= 0, inner).otherwise(0)).drop("coarse")
    else:
        bucketed = lambda d: d.withColumn("bucket", F.lit(0))
    firsts = sorted((r.bucket, r.first) for r in bucketed(ids).groupBy("bucket").agg(F.min("o").alias("first")).collect())
    rows = bucketed(rows)
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    if before:
        ahead = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])[o]
        spots = F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("ahead")), F.when(ahead.isNotNull(), F.struct(ahead.alias("bucket"), F.lit(True).alias("ahead")))))
        rows = rows.select("doc_id", "o", "text", F.explode(spots).alias("s")).select("s.bucket", "s.ahead", "doc_id", "o", "text")
    else:
        rows = rows.select("bucket", F.lit(False).alias("ahead"), "doc_id", "o", "text")
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "ahead", "o", "text").select("bucket", "ahead", "doc_id", "text")
    return rows.mapInArrow(_edited_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

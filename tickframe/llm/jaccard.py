"""N-gram Jaccard join by vertical partitioning (operator 9).

Every text becomes its set of distinct 5-word shingles (64-bit hashes, stored as 6 fragment bits and 40 further bits).  The
n-gram order (rare before common, then by hash) is cut into fragments by the leading hash bits; partial overlaps of a pair are
counted fragment by fragment and summed.  No case is dropped at any size; the only error is that of hashing: n-grams are compared by 46 bits,
so two of the 10,000 n-grams of a text fall together with a chance of 10^-6 (10^8 / 2^47), which moves its overlaps by one in 10,000, and a pair of
unlike texts shares a n-gram by chance as rarely; classes are told apart by 128 bits and their size.

1. texts with equal sets form a class and take part once;
2. n-grams that stand in many prefixes are moved to the end of the order (any order is right, this one keeps groups small);
3. sets of sizes n and m link only if they share at least ceil(4/9 (n + m)) n-grams, so at their first shared n-gram of the order
   each has at least that many n-grams left; this puts it into both prefixes (n - ceil(0.8 n) + 1 first n-grams) and bounds its
   position in each; and their parity bitmaps differ in at most |A xor B| <= (n + m) / 9 bits.  Groups of classes that share a
   prefix n-gram are first joined as stars (each member with the one where that n-gram stands earliest), verified, and turned into components; only members of one group that still lie in different
   components are then paired.  A pair left out lies in one component already, so no link between different texts is lost and no
   group of copies is expanded into all its pairs;
4. components come from min-label propagation over the verified links.

Null, empty and blank texts have the empty set and link with nothing (component_id is their own doc_id; rows with a repeated doc_id are
treated as texts of one id: the least row id of a class is used).  Rows with a null doc_id keep component_id null-safe: the least
non-null id they reach, else null.  Extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .common import shuffle_partitions, written

FRAGMENT_BITS, LOW_BITS = 6, 40
TOKEN_BITS = FRAGMENT_BITS + LOW_BITS
SEGMENTS = 8
#: An n-gram that more than this many prefixes of one round hold goes to the end of the order.
HOT_PREFIXES = 6
#: The broadcast list of such n-grams holds at most this many (8 bytes each); beyond it the most common ones are listed.
HOT_LIMIT = 1_000_000
HOT_ROUNDS = 2
#: Ids up to this count are broadcast to filter the set table; beyond it a shuffled join does the same.
BROADCAST_IDS = 1_000_000
#: Bits of the parity maps that pairs of different components are compared by where they meet, and before their n-grams are.
MEET_BITS, SKETCH_BITS = 1024, 2048
P = np.uint64(0x9E3779B97F4A7C15)
#: Salts of the two halves of a class's key.
KEY_SALTS = (P, np.uint64(0xC2B2AE3D27D4EB4F))
#: Bytes of text or of n-gram sets worked on at once in a task.
SLICE_BYTES = 1 << 20
#: Prefix n-grams that one reduce step holds; the number of steps follows their number in the whole input.
PART_TOKENS = 1_000_000


def shingle_hashes(w: K.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle at each position, and the text it belongs to; shorter texts give one shingle of all their words."""
    codes, uniq = w.encode()
    h = K.mix(K.hash_words(uniq) ^ P)[codes] if len(uniq) else np.zeros(0, np.uint64)
    n, doc = w.n, w.doc
    with np.errstate(over="ignore"):
        pos = np.arange(len(h)) - w.first[doc] if len(h) else np.zeros(0, np.int64)
        acc = h.copy()
        for i in range(1, width):
            nxt = np.zeros_like(h)
            nxt[:-i] = h[i:]
            inside = pos + i < n[doc]
            acc = np.where(inside, acc * P + nxt, acc)
        keep = (pos + width <= n[doc]) | ((pos == 0) & (n[doc] < width))
        short = np.minimum(n[doc], width).astype(np.uint64)
        acc = K.mix(acc + short * np.uint64(0xD1B54A32D192ED03))
    return acc[keep], doc[keep]


def pack_set(tokens: np.ndarray) -> bytes:
    """Sorted tokens of TOKEN_BITS bits: counts per fragment, low 32 bits, next 8 bits."""
    counts = np.bincount((tokens >> np.uint64(LOW_BITS)).astype(np.int64), minlength=1 << FRAGMENT_BITS).astype(np.uint32)
    return counts.astype("<u4" if len(tokens) >= 1 << 16 else "<u2").tobytes() + tokens.astype("<u4").tobytes() + (tokens >> np.uint64(32)).astype(np.uint8).tobytes()


def unpack_set(blob: bytes) -> np.ndarray:
    f = 1 << FRAGMENT_BITS
    wide = 4 if len(blob) >= 5 * (1 << 16) + 4 * f else 2
    counts = np.frombuffer(blob, f"<u{wide}", f)
    n = (len(blob) - wide * f) // 5
    low = np.frombuffer(blob, "<u4", n, wide * f).astype(np.uint64)
    mid = np.frombuffer(blob, np.uint8, n, wide * f + 4 * n).astype(np.uint64)
    high = np.repeat(np.arange(f, dtype=np.uint64), counts)
    return (high << np.uint64(LOW_BITS)) | (mid << np.uint64(32)) | low


def set_key(grams: np.ndarray, salt: np.uint64) -> int:
    """64-bit hash of a set of n-grams; two salts together identify it."""
    with np.errstate(over="ignore"):
        return int(K.mix(np.array([K.mix(grams + salt).sum(dtype=np.uint64) + np.uint64(len(grams))]))[0])


def _sets(width):
    schema = pa.schema([("u", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("c", pa.int64()), ("c2", pa.int64()), ("grams", pa.binary())])

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for b in K.slices(batches, limit=SLICE_BYTES):
            given = "__row" in b.schema.names
            buf, offs = K.flat(b.column("text"))
            h, doc = shingle_hashes(K.words(K.LOWER[buf], offs), width)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            del buf, doc
            ns, keys, blobs = [], ([], []), []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                grams = np.unique(h[lo:hi])
                ns.append(len(grams))
                for own, salt in zip(keys, KEY_SALTS, strict=True):
                    own.append(set_key(grams, salt))
                blobs.append(pack_set(grams >> np.uint64(64 - TOKEN_BITS)) if len(grams) else None)
            u = b.column("__row").cast(pa.int64()) if given else pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            ids = [pa.array(np.array(own, np.uint64).view(np.int64)) for own in keys]
            yield pa.RecordBatch.from_arrays([u, b.column("doc_id").cast(pa.int64()), pa.array(ns, pa.int32()), *ids, pa.array(blobs, pa.binary())], schema=schema)

    return run, "u long, doc_id long, n int, c long, c2 long, grams binary"


def prefix(tokens: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 n-grams of the order: rare ones by hash, then the listed ones by level and hash."""
    listed, level = hot
    n = len(tokens)
    p = n - (4 * n + 4) // 5 + 1
    if not len(listed):
        return tokens[:p]
    at = np.minimum(np.searchsorted(listed, tokens), len(listed) - 1)
    rank = np.where(listed[at] == tokens, level[at], 0)
    return tokens[np.argsort(rank, kind="stable")[:p]]


def _prefixes(batches, hot):
    """Per batch: tokens of all prefixes with their class, its size and the token's position, each class once."""
    seen: set[int] = set()
    for b in K.slices(batches, "grams", SLICE_BYTES):
        toks, cls, size, place = [], [], [], []
        for c, n, g in zip(b.column("c").to_pylist(), b.column("n").to_pylist(), b.column("grams").to_pylist(), strict=True):
            if g is None or c in seen:
                continue
            if len(seen) < 200_000:  # only saves work: the reducers drop repeats too
                seen.add(c)
            t = prefix(unpack_set(g), hot)
            toks.append(t)
            cls.append(np.full(len(t), c, np.int64))
            size.append(np.full(len(t), n, np.int32))
            place.append(np.arange(len(t), dtype=np.int32))
        if toks:
            yield np.concatenate(toks), np.concatenate(cls), np.concatenate(size), np.concatenate(place)


def _in_order(held):
    t, c, s, i = (np.concatenate(x) for x in zip(*held, strict=True))
    o = np.lexsort((c, i, t))
    return t[o], c[o], s[o], i[o]


def _gathered(batches, hot, limit=400_000):
    """Prefix tokens gathered up to `limit` at a time, sorted by (token, position, class), each class once."""
    held, n = [], 0

    def out():
        t, c, s, i = _in_order(held)
        keep = np.ones(len(t), bool)
        keep[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        return t[keep], c[keep], s[keep], i[keep]

    for x in _prefixes(batches, hot):
        held.append(x)
        n += len(x[0])
        if n >= limit:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _narrow(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _small(x: np.ndarray) -> bytes:
    """Two bytes each if they are enough, else four."""
    return x.astype("<u2" if len(x) == 0 or x.max() < 1 << 16 else "<u4").tobytes()


def _sized(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype(np.int64)


def _dealt(u: np.ndarray, parts: int):
    """Slices of sorted tokens by part (token modulo parts), and their quotients, which need fewer bytes."""
    part = (u % np.uint64(parts)).astype(np.int64)
    o = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[o], np.arange(parts + 1)).tolist()
    rest = u // np.uint64(parts)
    width = (int(rest.max()).bit_length() + 7) // 8 if len(u) else 1
    return [(p, o[x:y], _narrow(rest[o[x:y]], width), width) for p, x, y in zip(range(parts), cut[:-1], cut[1:], strict=True) if y > x]


def _blobs(parts: int, hot):
    """Rows (part, tokens, counts): tokens of one gathered chunk and part, for counting."""
    schema = pa.schema([("part", pa.int32()), ("width", pa.int32()), ("t", pa.binary()), ("k", pa.binary())])

    def run(batches):
        for t, _, _, _ in _gathered(batches, hot.value):
            u, k = np.unique(t, return_counts=True)
            rows = [(p, width, t, np.minimum(k[o], 255).astype(np.uint8).tobytes()) for p, o, t, width in _dealt(u, parts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run, "part int, width int, t binary, k binary"


def _by_part(batches, columns):
    """Rows of a partition sorted by part, one list per part; rows without a part come singly as (None, row)."""
    at, held = None, []
    for b in batches:
        for row in zip(*(b.column(x).to_pylist() for x in columns), strict=True):
            if row[0] is None:
                yield None, row
                continue
            if row[0] != at and held:
                yield at, held
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield at, held


def _hot(parts: int):
    def run(batches):
        for p, rows in _by_part(batches, ("part", "width", "t", "k")):
            held = [(_wide(t, width) * np.uint64(parts) + np.uint64(p), np.frombuffer(k, np.uint8).astype(np.int64)) for width, t, k in rows]
            t, k = (np.concatenate(x) for x in zip(*held, strict=True))
            u, inv = np.unique(t, return_inverse=True)
            n = np.bincount(inv, weights=k).astype(np.int64)
            hot = n > HOT_PREFIXES
            yield pa.RecordBatch.from_arrays([pa.array(u[hot].astype(np.int64)), pa.array(n[hot])], names=["t", "n"])

    return run


def _dealt_rows(rows: DataFrame, parts: int, key) -> DataFrame:
    """Each part's rows together in one task, sorted so that the task holds one part at a time."""
    return rows.repartition(parts, key).sortWithinPartitions("part")


def _merged(hot, t: np.ndarray, level: np.ndarray):
    """The list with further n-grams (most common first) up to HOT_LIMIT; the higher level of one n-gram holds."""
    known = np.isin(t, hot[0])
    take = known | (np.cumsum(~known) <= HOT_LIMIT - len(hot[0]))
    every, levels = np.concatenate((hot[0], t[take])), np.concatenate((hot[1], level[take]))
    o = np.lexsort((-levels, every))
    every, levels = every[o], levels[o]
    first = np.ones(len(every), bool)
    first[1:] = every[1:] != every[:-1]
    return every[first], levels[first]


def _parts(sets: DataFrame) -> int:
    """Reduce steps for the prefixes of all sets (a fifth of their n-grams, and at least one of each)."""
    n = sets.agg(F.sum(F.col("n") / 5 + 1)).head()[0] or 0
    return max(shuffle_partitions(sets.sparkSession), int(n // PART_TOKENS) + 1)


def _hot_tokens(sets: DataFrame, parts: int):
    """Sorted n-grams to put last, and their levels (twice the binary log of how many prefixes hold them).  A few rounds, as
    moving some brings others into the prefixes."""
    spark = sets.sparkSession
    hot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _ in range(HOT_ROUNDS):
        fn, schema = _blobs(parts, spark.sparkContext.broadcast(hot))
        found = _dealt_rows(sets.mapInArrow(fn, schema), parts, "part").mapInArrow(_hot(parts), "t long, n long")
        rows = found.orderBy(F.desc("n"), "t").limit(HOT_LIMIT).toPandas()
        new = _merged(hot, rows["t"].to_numpy(np.int64).astype(np.uint64), (2 * np.log2(rows["n"].to_numpy(float))).astype(np.int64))
        grown, hot = len(new[0]) - len(hot[0]), new
        if grown < 100:
            break
    return spark.sparkContext.broadcast(hot)


def _first_stars(parts: int, hot):
    """Star pairs inside a gathered chunk (a null part), and one or two entries per distinct n-gram of the chunk for the reducers."""
    schema = pa.schema([("part", pa.int32()), ("width", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("s", pa.binary()), ("i", pa.binary())])

    def run(batches):
        for t, c, s, i in _gathered(batches, hot.value):
            passed, hidden, a, b = _stars(t, c, s, i, None, False)
            rows = [(None, 0, a.tobytes(), b.tobytes(), None, None)]
            u, uc, us, ui = t[passed], c[passed], s[passed], 2 * i[passed].astype(np.int64) + hidden[passed]
            rows += [(p, width, q, uc[o].astype("<i8").tobytes(), _small(us[o]), _small(ui[o])) for p, o, q, width in _dealt(u, parts)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run, "part int, width int, a binary, b binary, s binary, i binary"


def _stars(t, c, s, i, more, last: bool):
    """Distinct pairs (first entry of a token's group, another one) that may link, which entries the reducers still need, and
    which groups have members that they do not see.

    Two that cannot link but have company become pairs with themselves: they stay candidates for the others of a group.  A group of two in a
    chunk is passed on whole; larger ones are represented by their first entry."""
    head = np.ones(len(t), bool)
    head[1:] = t[1:] != t[:-1]
    start = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    size = np.diff(np.append(start, len(t)))
    if last:
        size = size + np.maximum.reduceat(more, start)
    lead = start[group][~head]
    a, b, na, nb = c[lead], c[~head], s[lead].astype(np.int64), s[~head].astype(np.int64)
    ok = 9 * np.minimum(na - i[lead], nb - i[~head]) >= 4 * (na + nb)
    company = ~ok & (size[group[~head]] >= 3)
    a, b = np.concatenate((a[ok], a[company], b[company])), np.concatenate((b[ok], a[company], b[company]))
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    o = np.lexsort((hi, lo))
    lo, hi = lo[o], hi[o]
    keep = np.ones(len(lo), bool)
    keep[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    passed = head.copy()
    passed[~head] = ~ok & ~company
    hidden = (size - np.bincount(group[passed], minlength=len(size))) > 0
    return passed, hidden[group].astype(np.int64), lo[keep].astype("<i8"), hi[keep].astype("<i8")


def _last_stars(parts: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for p, rows in _by_part(batches, ("part", "width", "a", "b", "s", "i")):
            if p is None:
                _, _, x, y, _, _ = rows
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8")), pa.array(np.frombuffer(y, "<i8"))], schema=schema)
                continue
            held = []
            for width, x, y, s, i in rows:
                c = np.frombuffer(y, "<i8")
                held.append((_wide(x, width) * np.uint64(parts) + np.uint64(p), c, _sized(s, len(c)), _sized(i, len(c))))
            t, c, s, i = _in_order(held)
            _, _, a, b = _stars(t, c, s, i >> 1, i & 1, True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return run


def _star_pairs(sets: DataFrame, hot, parts: int) -> DataFrame:
    fn, schema = _first_stars(parts, hot)
    rows = sets.mapInArrow(fn, schema)
    # chunk-local pairs (null part) are spread by their content, entries by their part
    return _dealt_rows(rows, parts, F.coalesce("part", F.hash("a"))).mapInArrow(_last_stars(parts), "a long, b long").distinct()


def _classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets, and their classes (c, u, first).  Two sets are one class if both halves of the key and the size agree; where only the first half does, the
    sets get class ids made of all three."""
    while True:
        both = [f(x).alias(f"{x}_{g}") for x in ("c2", "n") for g, f in (("lo", F.min), ("hi", F.max))]
        cls = written(sets.where("n > 0").groupBy("c").agg(F.min("u").alias("u"), F.min("doc_id").alias("first"), *both))
        clash = cls.where("c2_lo != c2_hi or n_lo != n_hi").select("c", F.lit(True).alias("clash"))
        if not clash.limit(1).count():
            return sets, cls.select("c", "u", "first")
        own = F.when(F.col("clash"), F.xxhash64("c", "c2", "n")).otherwise(F.col("c"))
        sets = written(sets.join(_small_side(written(clash)), "c", "left").withColumn("c", own).drop("clash"))


def _only(sets: DataFrame, cls: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of `sets` for each class in `ids` (column c)."""
    rows = written(cls.join(_small_side(written(ids)), "c", "left_semi").select("u"))
    return sets.join(_small_side(rows), "u", "left_semi").select("c", "n", "grams")


def _segments(batches):
    """One row per set and vertical fragment: its tokens there, as 8-byte words."""
    schema = pa.schema([("c", pa.int64()), ("n", pa.int32()), ("f", pa.int32()), ("t", pa.binary())])
    edge = (np.arange(1, SEGMENTS, dtype=np.uint64)) << np.uint64(TOKEN_BITS - SEGMENTS.bit_length() + 1)
    for b in K.slices(batches, "grams", SLICE_BYTES):
        c, n, f, t = [], [], [], []
        for x, m, g in zip(b.column("c").to_pylist(), b.column("n").to_pylist(), b.column("grams").to_pylist(), strict=True):
            tok = unpack_set(g)
            cut = [0, *np.searchsorted(tok, edge).tolist(), m]
            for i in range(SEGMENTS):
                c.append(x)
                n.append(m)
                f.append(i)
                t.append((tok[cut[i] : cut[i + 1]] & np.uint64((1 << (TOKEN_BITS - 3)) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(f, pa.int32()), pa.array(t, pa.binary())], schema=schema)


def _tokens48(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _partial(batches):
    """Partial overlap of each pair in one fragment; both sides are sorted and without repeats."""
    for b in K.slices(batches, "ta", SLICE_BYTES):
        over = []
        for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
            if x == y:
                over.append(len(x) // 6)
                continue
            z = np.concatenate((_tokens48(x), _tokens48(y)))
            z.sort()
            over.append(int(np.count_nonzero(z[1:] == z[:-1])))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("na"), b.column("nb"), pa.array(over, pa.int32())], names=["a", "b", "na", "nb", "o"])


SEGMENT = "c long, n int, f int, t binary"


def _small_side(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most BROADCAST_IDS rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()


def _linked(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Pairs (a, b) that truly link: partial overlaps per fragment, summed per pair."""
    left = segments.select(F.col("c").alias("a"), F.col("n").alias("na"), "f", F.col("t").alias("ta"))
    right = segments.select(F.col("c").alias("b"), F.col("n").alias("nb"), "f", F.col("t").alias("tb"))
    both = left.join(_small_side(pairs), "a").join(right, ["b", "f"]).select("a", "b", "na", "nb", "ta", "tb")
    total = both.mapInArrow(_partial, "a long, b long, na int, nb int, o int").groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(F.expr("100 * o >= 80 * (na + nb - o)")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(c, comp): least class id reachable over links (a, b).  Each round hooks to the least neighbouring label, then jumps to the label's own label; sides of checked
    size are broadcast."""
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = written(edges.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.col("a")).alias("comp")))
    few = label.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    side = F.broadcast if few else (lambda df: df)
    while True:
        near = edges.join(side(label.withColumnRenamed("c", "b")), "b").groupBy("a").agg(F.min("comp").alias("near"))
        up = label.select(F.col("c").alias("comp"), F.col("comp").alias("up"))
        new = near.withColumnRenamed("a", "c").join(side(label), "c").select("c", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        new = written(new.join(side(up), "comp", "left").select("c", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        label = new.select("c", "comp")
        if not new.where("old != comp").limit(1).count():
            return label


def parity(tokens: np.ndarray) -> np.ndarray:
    """256-bit map, as four numbers: of how many tokens with these last 8 bits, even or odd."""
    return np.packbits((np.bincount((tokens & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)


def _parities(batches):
    for b in K.slices(batches, "grams", SLICE_BYTES):
        maps = np.array([parity(unpack_set(g)) for g in b.column("grams").to_pylist()]).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([b.column("c"), b.column("n"), *(pa.array(x) for x in maps.T.copy())], names=["c", "n", "m0", "m1", "m2", "m3"])


def _plausible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs whose parity bitmaps allow a link: they differ in at most |A xor B| bits, and that is at most (n + m) / 9."""
    maps = _small_side(written(maps))
    one = maps.withColumnRenamed("c", "a")
    two = maps.select(F.col("c").alias("b"), F.col("n").alias("m"), *(F.col(f"m{q}").alias(f"w{q}") for q in range(4)))
    return pairs.where("a != b").join(one, "a").join(two, "b").where("9L * (bit_count(m0 ^ w0) + bit_count(m1 ^ w1) + bit_count(m2 ^ w2) + bit_count(m3 ^ w3)) <= n + m").select("a", "b")


def sketch(tokens: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity map of some bits, for sets that fill the small one."""
    at = (tokens & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _sketches(batches):
    for b in K.slices(batches, "grams", SLICE_BYTES):
        yield pa.RecordBatch.from_arrays([b.column("c"), b.column("n"), pa.array([sketch(unpack_set(g)) for g in b.column("grams").to_pylist()], pa.binary())], names=["c", "n", "s"])


def _near(batches):
    """Pairs whose sketches differ in at most (n + m) / 9 bits."""
    for b in K.slices(batches, "sa", SLICE_BYTES):
        one, two = (np.frombuffer(b"".join(b.column(x).to_pylist()), "<u8").reshape(b.num_rows, -1) for x in ("sa", "sb"))
        size = b.column("na").to_numpy().astype(np.int64) + b.column("nb").to_numpy()
        near = pa.array(9 * np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) <= size)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(near), b.column("b").filter(near)], names=["a", "b"])


def _sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose wide parity maps allow a link, as in `_plausible`: only these are counted fragment by fragment.  No link is lost."""
    s = written(sets.mapInArrow(_sketches, "c long, n int, s binary"))
    side = lambda x: s.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near, "a long, b long")


def _mixed_entries(hot):
    """Rows (t, p, c, n, i, comp): a prefix n-gram, the one before it in the same prefix (-1: none), its class, the class's size, the n-gram's position, and the component."""
    schema = pa.schema([("t", pa.int64()), ("p", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("i", pa.int32()), ("comp", pa.int64())])

    def run(batches):
        for b in K.slices(batches, "grams", SLICE_BYTES):
            toks, before, rows = [], [], []
            for i, g in enumerate(b.column("grams").to_pylist()):
                t = prefix(unpack_set(g), hot.value).astype(np.int64)
                toks.append(t)
                before.append(np.concatenate(([-1], t[:-1])))
                rows.append(np.full(len(t), i))
            if not toks:
                continue
            at, place = pa.array(np.concatenate(rows)), np.concatenate([np.arange(len(t), dtype=np.int32) for t in toks])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks)), pa.array(np.concatenate(before)), b.column("c").take(at), b.column("n").take(at), pa.array(place), b.column("comp").take(at)], schema=schema)

    return run, "t long, p long, c long, n int, i int, comp long"


#: Numbers of a map of MEET_BITS bits.
MEET = [f"m{q}" for q in range(MEET_BITS // 64)]


def _meeting_maps(batches):
    for b in K.slices(batches, "grams", SLICE_BYTES):
        maps = np.frombuffer(b"".join(sketch(unpack_set(g), MEET_BITS) for g in b.column("grams").to_pylist()), np.int64).reshape(b.num_rows, -1)
        yield pa.RecordBatch.from_arrays([b.column("c"), *(pa.array(x) for x in maps.T.copy())], names=["c", *MEET])


#: Two with the same n-gram before the shared one have met there already, where the other bounds let them through too (a group of these two alone is one that the stars have looked at).  Both have enough n-grams left
#: from the shared one on, and their parity maps differ in few enough bits.
MAY_LINK = "(i = 0 or p != q) and 9L * least(n - i, m - j) >= 4L * (n + m) and 9L * (" + " + ".join(f"bit_count({x} ^ other_{x})" for x in MEET) + ") <= n + m"


def _across(known: DataFrame, hot) -> DataFrame:
    """known(c, n, grams, comp) -> pairs (a, b) of different components that share a prefix n-gram and may link, once for each run of n-grams that stand in both prefixes one after the other."""
    entries = known.mapInArrow(*_mixed_entries(hot))
    spread = entries.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k"))
    mixed = written(spread.where("lo != hi and k > 2").select("t"))  # groups of two have been looked at by the stars
    maps = written(known.mapInArrow(_meeting_maps, "c long, " + ", ".join(f"{x} long" for x in MEET)))
    entries = entries.join(_small_side(mixed), "t", "left_semi").join(_small_side(maps), "c")
    names = (("p", "q"), ("c", "d"), ("n", "m"), ("i", "j"), ("comp", "other"), *((x, f"other_{x}") for x in MEET))
    met = entries.join(entries.select("t", *(F.col(x).alias(y) for x, y in names)), "t").where("c < d and comp != other and " + MAY_LINK)
    return met.select(F.col("c").alias("a"), F.col("d").alias("b"))


def jaccard_rows(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs(doc_id, text, __row if rows have unique ids) -> a row for each: doc_id, u (its __row), n, comp (its component's class, null for the empty set), component_id."""
    sets, cls = _classes(written(docs.select("doc_id", "text", *[c for c in docs.columns if c == "__row"]).mapInArrow(*_sets(width))))
    full = sets.where("n > 0")
    parts = _parts(full)
    hot = _hot_tokens(full.select("c", "n", "grams"), parts)
    pairs = written(_star_pairs(full.select("c", "n", "grams"), hot, parts))
    some = _only(full, cls, _ends(pairs))
    maps = some.mapInArrow(_parities, "c long, n int, m0 long, m1 long, m2 long, m3 long")
    first = written(_plausible(pairs, maps))
    links = written(_linked(first, _only(full, cls, _ends(first)).mapInArrow(_segments, SEGMENT)))
    label = components(links)
    known = some.join(label, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    met = written(_across(known, hot).distinct().join(first, ["a", "b"], "left_anti"))
    new = written(_sketched(met, _only(full, cls, _ends(met))))
    more = written(_linked(new, _only(full, cls, _ends(new)).mapInArrow(_segments, SEGMENT)))
    if more.limit(1).count():
        label = components(links.union(more))
    of = cls.join(label, "c", "left").select("c", "first", F.coalesce("comp", "c").alias("comp"))
    least = of.groupBy("comp").agg(F.min("first").alias("component_id"))
    known = of.join(least, "comp").select("c", "comp", "component_id")
    # texts without words have no class: they stand alone
    some = F.col("n") > 0
    return sets.select("doc_id", "u", "n", "c").join(known, "c", "left").select("doc_id", "u", "n", F.when(some, F.col("comp")).alias("comp"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id; see the module's text."""
    return jaccard_rows(docs.select("doc_id", "text"), width).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")

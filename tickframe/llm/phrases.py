"""Phrase collocation mining by SON partitioning (operator 13).

The corpus is parted into SHARDS shards, each a group of input partitions.  A phrase with SUPPORT occurrences in its language must reach its proportional share of them,
SUPPORT * (words of the shard) / (words of the language), in at least one shard.  So each shard is mined completely at that lowered support: its tasks count their phrases, Spark adds the
counts up per shard, and what is frequent in any shard, and by the sum of all shards, is a candidate.  A second look at all texts counts every candidate, and its parts, exactly.  No phrase is lost, however
the shards fall, and results do not depend on them.

Shards are mined level by level: words that reach SUPPORT first, then pairs of such words, then three to five words all of whose pairs are frequent in some shard.  What a
level hands to the next is a bitmap of BITS hash bits, whose size does not grow with the data: bits that fall together cost some needless counting and change nothing, as the final
counts go by the phrases themselves.

Rows: a null lang counts as `und` (together with a lang of that name); null and empty texts give no words; repeated rows count each time; texts are taken whole; doc_id and extra columns
are not used.  Ties of the score go by a, then by the phrase.  An empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from . import kernels as K
from .common import shuffle_partitions, written
from .jaccard import _small_side as small_side

SUPPORT, LONGEST, FIRST = 100, 5, 2000
SHARDS = 8
BITS = 1 << 27
#: Distinct phrases that a task holds before it hands its counts on, and bytes of text worked on at once.
TALLY, SLICE_BYTES = 2_000_000, 8 << 20
#: Spelled phrases that a task holds before it hands its counts on, and rows of a batch of them.
SPELLED, SPELLED_BATCH = 1_000_000, 50_000
SALTS = 64
#: Odd factor of a hash's second bit, which the product's upper bits give.
SECOND, SHIFT = 0x2545F491, 5
MUL = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(0xFFFFFFFF)

DELIMITER = np.zeros(256, bool)
DELIMITER[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
SPACE = DELIMITER.copy()
SPACE[[0x20, 0x09]] = True


class Parsed:
    """Words of a batch: hash, piece and language of each, and how to spell them."""

    def __init__(self, b):
        buf, offs = K.flat(b.column("text"))
        buf = K.LOWER[buf]
        w = K.words(buf, offs, SPACE)
        self.code, self.words = w.encode()
        langs = pc.fill_null(b.column("lang"), "und").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[w.doc]
        self.piece = np.concatenate(([0], np.cumsum(DELIMITER[buf])))[w.start] + w.doc if len(w.start) else np.zeros(0, np.int64)
        seeds = np.array([xxhash.xxh3_64_intdigest(x, seed=1) for x in self.langs], np.uint64)
        word = K.hash_words(self.words)[self.code] if len(self.code) else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            self.word = K.mix(word * MUL + seeds[self.lang]) if len(word) else word

    def hashes(self):
        """k, hash of the phrase of k words from each place on, and whether it lies in one piece; for k from 1 up."""
        with np.errstate(over="ignore"):
            h = K.mix(self.word)
            inside = np.ones(len(h), bool)
            for k in range(1, LONGEST + 1):
                if k > 1:
                    h = K.mix(h[:-1] * MUL + self.word[k - 1 :] + np.uint64(k))
                    inside = self.piece[: len(h)] == self.piece[k - 1 :]
                yield k, h, inside


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Are both bits of each hash set?"""
    at = h & np.uint64(BITS - 1)
    one = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    some = np.flatnonzero(one)
    at = ((h[some] & LOW) * np.uint64(SECOND) & LOW) >> np.uint64(SHIFT) & np.uint64(BITS - 1)
    one[some] = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return one


def mined(p: Parsed, bits, level: int):
    """Hashes and places of the phrases that the level counts: words; pairs of marked words; longer phrases of marked pairs."""
    if level == 1:
        _, h, _ = next(iter(p.hashes()))
        yield h, np.arange(len(h))
        return
    able = None
    for k, h, inside in p.hashes():
        if k == level - 1 or level == 2 and k == 1:
            able = marked(bits, h) & inside
        elif k >= level and (level > 2 or k == 2):
            able = able[:-1] & able[1:]
            at = np.flatnonzero(able & inside)
            yield h[at], at


def _tallied(sent, level: int):
    """Rows (key, lang, n): a task's counts of phrases, lang null; and its number of words per language.  A key is 32 bits of the unit (a shard's part of one language; none for single words) and
    32 bits of the phrase's hash: phrases that fall together can only seem more frequent than they are."""
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("n", pa.int64())])

    def rows(unit, h, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64) | unit), pa.nulls(len(h), pa.string()), pa.array(n)], schema=schema)

    def run(batches):
        shard = TaskContext.get().partitionId() % SHARDS
        unit = lambda lang: np.int64((xxhash.xxh32_intdigest(lang, seed=shard) >> 1) << 32 if level > 1 else 0)
        held: dict[str, list] = {}
        size, total = 0, {}

        def merged(parts):
            h, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            return h, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(h)).astype(np.int64)

        for b in K.slices(batches, limit=SLICE_BYTES):
            p = Parsed(b)
            for i, lang in enumerate(p.langs):
                total[lang] = total.get(lang, 0) + int((p.lang == i).sum())
            for h, at in mined(p, sent.value if sent is not None else None, level):
                of = p.lang[at]
                for i, lang in enumerate(p.langs):
                    mine = (h[of == i] if len(p.langs) > 1 else h) & LOW
                    if len(mine):
                        got = np.unique(mine, return_counts=True)
                        held.setdefault(lang, []).append(got)
                        size += len(got[0])
            if size > TALLY:
                held = {lang: [merged(parts)] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > TALLY // 2:
                    for lang, parts in held.items():
                        yield rows(unit(lang), *parts[0])
                    held, size = {}, 0
        for lang, parts in held.items():
            yield rows(unit(lang), *merged(parts))
        for lang, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([unit(lang)]), pa.array([lang], pa.string()), pa.array([n])], schema=schema)

    return run, "key long, lang string, n long"


def bitmap(hashes: DataFrame, known: np.ndarray | None = None):
    """Two bits of each hash (from the low 32 bits of column key), and those of a bitmap before: BITS / 8 bytes whatever their number.  Spark ors them; at most BITS / 64 rows come to the driver."""
    low = "(key & 4294967295)"
    at = hashes.select(F.explode(F.expr(f"array({low}, shiftright({low} * {SECOND}L & 4294967295, {SHIFT}))")).alias("at")).select(F.col("at").bitwiseAND(F.lit(BITS - 1)).alias("at"))
    some = at.select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64) if known is None else known.copy()
    out[some.column("w").to_numpy()] |= some.column("b").to_numpy().view(np.uint64)
    return out


def locally_frequent(docs: DataFrame, bits: np.ndarray, level: int, words: DataFrame) -> DataFrame:
    """The hashes of a level's phrases that reach their share of SUPPORT in some shard, and SUPPORT by the sum of all shards' counts: these are of all occurrences of such phrases, so that no phrase is lost."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    counts = written(docs.mapInArrow(*_tallied(sent, level)).groupBy("key", "lang").agg(F.sum("n").alias("n")))
    unit = F.shiftright("key", 32).alias("unit")
    units = counts.where("lang is not null").select(unit, "lang", F.col("n").alias("shard_words")).join(words, "lang")  # one row a shard and language
    large = lambda c: F.col(c).cast("decimal(20,0)")
    met = counts.where("lang is null").select(unit, F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key"), "n").join(units, "unit")
    some = written(met.where(large("n") * large("words") >= large("shard_words") * SUPPORT).select("lang", "key").distinct())
    total = met.join(small_side(some), ["lang", "key"], "left_semi").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return total.where(F.col("n") >= SUPPORT).select("key").distinct()


COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("n", pa.int64())])


def merged(held: list) -> pa.Table:
    """Batches of COUNTS as one table, a row for each phrase."""
    return pa.Table.from_batches(held, COUNTS).group_by(["lang", "phrase", "k"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(COUNTS.names).cast(COUNTS)


def _spelled(sent):
    """Rows (lang, phrase, k, n): a task's counts of marked phrases of one to LONGEST words, by the phrases themselves."""

    def run(batches):
        held, size = [], 0
        for b in K.slices(batches, limit=SLICE_BYTES):
            p = Parsed(b)
            for k, h, inside in p.hashes():
                at = np.flatnonzero(inside & marked(sent.value, h))
                if not len(at):
                    continue
                _, first, n = np.unique(h[at], return_index=True, return_counts=True)
                at = at[first]
                spelled = [p.words.take(pa.array(p.code[at + j])).cast(pa.large_string()) for j in range(k)]
                phrase = pc.binary_join_element_wise(*spelled, pa.scalar(" ", pa.large_string())).cast(pa.string())
                held.append(pa.RecordBatch.from_arrays([pa.array(p.langs, pa.string()).take(pa.array(p.lang[at])), phrase, pa.array(np.full(len(at), k, np.int32)), pa.array(n)], schema=COUNTS))
                size += len(at)
            if size > SPELLED:
                held = merged(held).to_batches(max_chunksize=SPELLED_BATCH)
                size = sum(x.num_rows for x in held)
                if size > SPELLED // 2:
                    yield from held
                    held, size = [], 0
        yield from merged(held).to_batches(max_chunksize=SPELLED_BATCH)

    return run, "lang string, phrase string, k int, n long"


def _dealt(sent, buckets: int):
    """Rows (bucket, counts): what `_spelled` counts, dealt by the phrases' hashes and packed, one row a bucket each time that a task hands its counts on."""
    rows, _ = _spelled(sent)

    def packed(held):
        zstd = pa.ipc.IpcWriteOptions(compression="zstd")
        t = pa.Table.from_batches(held, COUNTS)
        bucket = (K.hash_words(t.column("phrase")) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        t, bucket = t.take(pa.array(order)).combine_chunks(), bucket[order]
        ends = np.concatenate((np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        blobs = []
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, COUNTS, options=zstd) as out:
                out.write_table(t.slice(lo, hi - lo))
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[ends - 1]), pa.array(blobs, pa.binary())], names=["bucket", "counts"])

    def run(batches):
        held, size = [], 0
        for b in rows(batches):
            held.append(b)
            size += b.num_rows
            if size >= SPELLED // 2:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return run, "bucket int, counts binary"


def _frequent(support: int):
    """All counts of one bucket, of all tasks -> its phrases that reach the support: lang, phrase, k, f."""

    def run(table):
        held, size = [], 0
        for blob in table.column("counts"):
            got = pa.ipc.open_stream(blob.as_buffer()).read_all().to_batches()
            held += got
            size += sum(x.num_rows for x in got)
            if size > SPELLED:
                held = merged(held).to_batches()
                size = -sum(x.num_rows for x in held)  # as many again may come before the next merge
        t = merged(held)
        return t.filter(pc.greater_equal(t.column("n"), support)).rename_columns(["lang", "phrase", "k", "f"])

    return run, "lang string, phrase string, k int, f long"


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(lang, text) -> all phrases of up to LONGEST words with their exact count f >= SUPPORT (lang, phrase, k, f), and the number of words per language (lang, words)."""
    docs = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    counts = written(docs.mapInArrow(*_tallied(None, 1)).groupBy("key", "lang").agg(F.sum("n").alias("n")).where(f"lang is not null or n >= {SUPPORT}"))
    words = written(counts.where("lang is not null").select("lang", F.col("n").alias("words")))  # one row a language
    bits = bitmap(counts.where("lang is null"))
    pairs = written(locally_frequent(docs, bits, 2, words))
    longer = written(locally_frequent(docs, bitmap(pairs), 3, words))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(longer.unionByName(pairs), bits))
    exact = docs.mapInArrow(*_dealt(sent, shuffle_partitions(docs.sparkSession))).groupBy("bucket").applyInArrow(*_frequent(SUPPORT))
    return written(exact), words


def collocations(docs: DataFrame) -> DataFrame:
    """docs(lang, text) -> lang, rank, phrase, a, l, r, n, score: the FIRST phrases of each language by the score of their weakest cut, without those that a longer one covers."""
    f, words = frequent_phrases(docs)
    parts = f.select("lang", F.col("phrase").alias("part"), "f")
    long = f.where("k > 1").withColumn("w", F.split("phrase", " "))
    cut = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.select("lang", "phrase", "k", F.col("f").alias("a"), "cut", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("cut"))).alias("one"), F.concat_ws(" ", F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("two"))
    side = lambda name, n: parts.select("lang", F.col("part").alias(name), F.col("f").alias(n))
    cut = cut.join(side("one", "l"), ["lang", "one"]).join(side("two", "r"), ["lang", "two"]).join(words.select("lang", F.col("words").alias("n")), "lang")
    d = lambda c: F.col(c).cast("decimal(20,0)")
    cut = cut.withColumns({"top": F.lit(1000).cast("decimal(38,0)") * d("a") * d("n"), "under": d("l") * d("r")}).withColumn("score", F.expr("top div under"))
    weakest = cut.groupBy("lang", "phrase", "k", "a", "n").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("c"))
    # a longer phrase with as many occurrences has one of a single word more between it and the phrase, with as many too
    around = long.where("k > 2").select("lang", F.explode(F.array(F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k") - 1)), F.concat_ws(" ", F.slice("w", F.lit(2), F.col("k") - 1)))).alias("phrase"), "f")
    around = around.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = weakest.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    out = left.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))  # a language's phrases are first ranked in parts
    some = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= FIRST)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= FIRST)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

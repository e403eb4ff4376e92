"""Language identification by prediction by partial matching (operator 5).

One byte context tree per language, orders 0 to ORDER, escape method C without exclusion, statistics frozen after training.  Contexts never cross white
space: a word is coded as the bytes after its leading blank, closed by one blank, so a text's exact code length under a language is the sum over its
words, and every distinct word of a batch is coded once.  The language with the shortest code wins (ties: the lesser name); the score is its share of
2^-(length per word), so that it tells clear texts from doubtful ones at any length.

Training counts come from about MAX_DOCS distinct texts of each language, chosen by a hash of the text, and from all of a language that has fewer; ids play no part, so a language is learned however its
rows are numbered.  That bounds the model, which is broadcast.
Texts that are null or have no letter are `und` with score 0, as is everything when no document has a language.  Repeated rows get equal results.  Texts are coded whole,
however long; an empty table gives no rows; other columns are ignored, whatever their names.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K

ORDER = 4
MAX_DOCS = 600


def coded(uniq: pa.Array):
    """Bytes of all words between blanks, which of them are coded (all but the leading blank), how many precede in the word, and word starts."""
    size = np.array([len(x) for x in uniq.to_pylist()], np.int64) if len(uniq) else np.zeros(0, np.int64)
    data, _ = K.flat(uniq)
    begin = np.cumsum(size + 2) - (size + 2)
    buf = np.full(int((size + 2).sum()), 32, np.uint8)
    word = np.repeat(np.arange(len(size)), size + 2)
    place = np.arange(len(buf)) - begin[word]
    inner = (place > 0) & (place <= size[word])
    buf[inner] = data
    return buf, place, begin


def grams(buf, k):
    """The byte at each place with the k bytes before it, packed."""
    v = buf.astype(np.uint64)
    for j in range(1, k + 1):
        v[j:] |= buf[:-j].astype(np.uint64) << np.uint64(8 * j)
    return v


def _counts(batches):
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])
    for b in K.slices(batches):
        langs = np.array(b.column("lang").to_pylist(), object)
        data, offs = K.flat(b.column("text"))
        w = K.words(data, offs)
        code, uniq = w.encode()
        buf, place, begin = coded(uniq)
        word = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(buf))))
        for lang in sorted(set(langs.tolist())):
            n = np.bincount(code[(langs == lang)[w.doc]], minlength=len(uniq))[word]
            for k in range(ORDER + 1):
                here = (place > 0) & (place >= k) & (n > 0)
                u, inv = np.unique(grams(buf, k)[here], return_inverse=True)
                c = np.bincount(inv, weights=n[here], minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(np.full(len(u), k, np.int32)), pa.array(u.astype(np.int64)), pa.array(c)], schema=schema)


def find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


class Model:
    """Frozen code lengths in bits: for each order the seen grams with their cost under every language, and the seen contexts with the
    cost of escaping from them (0 where the language has not seen the context)."""

    def __init__(self, counts):
        self.langs = sorted(counts["lang"].unique())
        self.grams, self.costs, self.contexts, self.escapes = [], [], [], []
        lower = np.full((0, len(self.langs)), 8.0)
        for k in range(ORDER + 1):
            rows = counts[counts["k"] == k]
            keys = np.unique(rows["gram"].to_numpy().astype(np.uint64))
            ctx = np.unique(keys >> np.uint64(8))
            at = find(ctx, keys >> np.uint64(8))
            n = np.zeros((len(keys), len(self.langs)))
            n[find(keys, rows["gram"].to_numpy().astype(np.uint64)), rows["lang"].map(self.langs.index).to_numpy()] = rows["n"].to_numpy()
            total, kinds = np.zeros((len(ctx), len(self.langs))), np.zeros((len(ctx), len(self.langs)))
            np.add.at(total, at, n)
            np.add.at(kinds, at, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(n / (total + kinds)[at])
            if k:
                below = lower[find(self.grams[-1], keys & np.uint64((1 << (8 * k)) - 1))]
            else:
                below = np.full((len(keys), len(self.langs)), 8.0)
            lower = np.where(n > 0, seen, escape[at] + below)
            self.grams.append(keys)
            self.costs.append(lower)
            self.contexts.append(ctx)
            self.escapes.append(escape)

    def word_costs(self, uniq: pa.Array) -> np.ndarray:
        """Code length of each word under each language."""
        buf, place, begin = coded(uniq)
        cost = np.zeros((len(buf), len(self.langs)))
        left = np.flatnonzero(place > 0)
        for k in range(ORDER, -1, -1):
            able = place[left] >= k
            here = left[able]
            v = grams(buf, k)[here]
            at = find(self.grams[k], v)
            hit = at >= 0
            cost[here[hit]] += self.costs[k][at[hit]]
            miss = here[~hit]
            ctx = find(self.contexts[k], v[~hit] >> np.uint64(8))
            cost[miss[ctx >= 0]] += self.escapes[k][ctx[ctx >= 0]]
            left = np.concatenate((left[~able], miss))
        cost[left] += 8.0
        return np.add.reduceat(cost, begin, axis=0) if len(begin) else np.zeros((0, len(self.langs)))


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model | None:
    """docs(doc_id, text, lang), all of them usable for training."""
    known = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    rate = known.groupBy("lang", "h").agg(F.lit(1).alias("one")).groupBy("lang").agg((max_docs / F.count("*")).alias("rate"))  # one row a language
    some = known.join(F.broadcast(rate), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("rate") * (1 << 20))
    some = some.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")  # each text once, so copies neither swell the model nor fall out together
    counts = some.mapInArrow(_counts, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Model(counts) if len(counts) else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        m = Model.__new__(Model)
        vars(m).update(sent.value)
        for b in K.slices(batches, limit=2 * K.SLICE_BYTES):
            w = K.words(*K.flat(b.column("text")))
            code, uniq = w.encode()
            per = m.word_costs(uniq)[code]
            doc = w.doc
            cost = np.stack([np.bincount(doc, weights=per[:, i], minlength=b.num_rows) for i in range(len(m.langs))], 1)
            best = cost.argmin(1)
            words = np.maximum(w.n, 1)[:, None]
            score = 1 / np.exp2((cost.min(1, keepdims=True) - cost) / words).sum(1)
            ok = b.column("letter").to_numpy(zero_copy_only=False)
            lang = [m.langs[i] if y else "und" for i, y in zip(best.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(np.where(ok, score, 0.0))], schema=schema)

    return docs.select("doc_id", "text", letter).mapInArrow(run, "doc_id long, lang_pred string, score double")

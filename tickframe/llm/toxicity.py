"""Counterfactual-regularised toxicity classifier (operator 7).

Features are the words of a text (lower case, letters only) and the letter n-grams inside them, present or not.  Document frequencies over all labelled
training rows choose the FEATURES with the largest log-odds scores; identity terms are features whenever they occur.  A logistic regression
on them is fitted on at most MAX_ROWS labelled rows (a documented bound; chosen by a hash of their ids) with two penalties: a ridge, and
CONTRAST * (change of the score)^2 for each training sentence whose identity term, with its letter n-grams, is swapped for another one of its group or for
none.  So the scores of identity terms are drawn together and to zero, and a neutral mention of a group does not raise the score.  The terms are
listed for English, German, French and Spanish; terms of other languages are words like all others.

Null and empty texts get the model's score without features; without labelled rows of both kinds the score is the share of label 1 (0 without
rows).  Several labels of one doc_id count as toxic if any is 1; null labels are ignored.
"""
from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K

FEATURES = 3000
MAX_ROWS = 20_000
MIN_DOCS = 5
GRAM = (3, 4, 5)
RIDGE, CONTRAST, STEPS = 1.0, 2.0, 60
#: Bytes of text worked on at once, and words and features held before they are passed on.
SLICE_BYTES = 1 << 20
HELD_WORDS, HELD_FEATURES = 200_000, 300_000
#: Texts in a dense block of presence marks.
DENSE_ROWS = 256

#: Terms that name a group, by kind; only terms of one kind are swapped for each other.
IDENTITY = {
    "gender": "woman women man men girl girls boy boys female male frau frauen mann männer femme femmes homme hommes mujer mujeres hombre hombres".split(),
    "orientation": "gay lesbian bisexual transgender trans queer straight heterosexual homosexual schwul lesbisch homosexuel homosexuelle lesbienne lesbiana".split(),
    "religion": "muslim muslims christian christians jewish jew jews buddhist hindu catholic atheist moslem muslime christen juden musulman musulmans chrétien juif musulmán cristiano judío".split(),
    "origin": "black white asian african european latino hispanic arab immigrant immigrants refugee refugees einwanderer flüchtlinge immigré immigrés réfugiés inmigrante inmigrantes".split(),
    "ability": "disabled blind deaf autistic behindert aveugle sourd handicapé discapacitado ciego sordo".split(),
}
KIND = {w: k for k, ws in IDENTITY.items() for w in ws}


def word_features(word: bytes) -> list[str]:
    """Features of one word: itself and its inner letter n-grams."""
    w = word.decode().lower()
    if not w.isalpha():
        w = "".join(filter(str.isalpha, w))
    if not w:
        return []
    return ["w:" + w, *{w[i : i + n] for n in GRAM for i in range(len(w) - n + 1) if n < len(w)}]


def term_features(term: str) -> list[str]:
    """Features that a swap of an identity term changes: the word and its letter n-grams."""
    return word_features(term.encode())


def _pairs(b):
    """Distinct (text, word) pairs of a batch: text index, word code, distinct words."""
    w = K.words(*K.flat(b.column("text")))
    code, uniq = w.encode()
    key = np.unique(w.doc * max(len(uniq), 1) + code) if len(code) else np.zeros(0, np.int64)
    return key // max(len(uniq), 1), key % max(len(uniq), 1), uniq.to_pylist()


class _Features:
    """Feature numbers of words, worked out once per distinct word; with a vocabulary only its features count, else new ones get the next number."""

    def __init__(self, vocabulary: dict[str, int] | None = None):
        self.fixed, self.ids = vocabulary is not None, vocabulary if vocabulary is not None else {}
        self.forget()

    def forget(self):
        self.row: dict[bytes, int] = {}
        self.start, self.flat = array("q", [0]), array("q")

    def _row(self, word: bytes) -> int:
        i = self.row.get(word)
        if i is None:
            i = self.row[word] = len(self.row)
            if self.fixed:
                self.flat.extend([self.ids[f] for f in word_features(word) if f in self.ids])
            else:
                self.flat.extend([self.ids.setdefault(f, len(self.ids)) for f in word_features(word)])
            self.start.append(len(self.flat))
        return i

    def met(self, b) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs of a batch in order of texts; a feature that several words of a text share stands there several times."""
        doc, code, uniq = _pairs(b)
        if len(self.row) > HELD_WORDS:  # a cache: it changes no result
            self.forget()
        rows = np.fromiter(map(self._row, uniq), np.int64, len(uniq))
        start, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.flat, np.int64) if self.flat else np.zeros(0, np.int64)
        first, size = start[rows], start[rows + 1] - start[rows]
        some = size[code] > 0 if len(code) else np.zeros(0, bool)
        doc, code = doc[some], code[some]
        n = size[code] if len(code) else np.zeros(0, np.int64)
        at = np.arange(n.sum()) + np.repeat((first[code] if len(code) else n) - (np.cumsum(n) - n), n)
        return np.repeat(doc, n), flat[at]

    def of(self, b) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) pairs of a batch, in order."""
        doc, f = self.met(b)
        m = max(len(self.ids), 1)
        key = np.unique(doc * m + f)
        return key // m, key % m

    def sums(self, b, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each text's distinct features, some texts at a time."""
        doc, f = self.met(b)
        out = np.zeros(b.num_rows)
        for lo in range(0, b.num_rows if len(f) else 0, DENSE_ROWS):
            x = np.zeros((min(DENSE_ROWS, b.num_rows - lo), len(weights)))
            of = slice(*np.searchsorted(doc, (lo, lo + DENSE_ROWS)))
            x[doc[of] - lo, f[of]] = 1
            out[lo : lo + DENSE_ROWS] = x @ weights
        return out


def _document_frequencies(batches):
    schema = pa.schema([("feature", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])
    known, sums = _Features(), np.zeros((2, 0), np.int64)
    for b in K.slices(batches, limit=SLICE_BYTES):
        y = b.column("y").to_numpy(zero_copy_only=False)
        d, f = known.of(b)
        m = len(known.ids)
        sums = np.pad(sums, ((0, 0), (0, m - sums.shape[1]))) + [np.bincount(f[y[d] == k], minlength=m) for k in (1, 0)]
        if m > HELD_FEATURES:
            yield pa.RecordBatch.from_arrays([pa.array(list(known.ids), pa.string()), pa.array(sums[0]), pa.array(sums[1])], schema=schema)
            known, sums = _Features(), np.zeros((2, 0), np.int64)
    if known.ids:
        yield pa.RecordBatch.from_arrays([pa.array(list(known.ids), pa.string()), pa.array(sums[0]), pa.array(sums[1])], schema=schema)


def _swaps(vocabulary: dict[str, int], seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Penalty matrix of the swaps over the columns they touch: a sentence's identity term gives way to another of its kind, or to none."""
    kinds: dict[str, list[tuple[float, set]]] = {}
    for w, k in KIND.items():
        f = {vocabulary[x] for x in term_features(w) if x in vocabulary}
        if f:
            kinds.setdefault(k, []).append((float(seen[vocabulary["w:" + w]]) if "w:" + w in vocabulary else 0.0, f))
    cols = np.array(sorted({i for members in kinds.values() for _, f in members for i in f}), np.int64)
    place = {int(i): j for j, i in enumerate(cols)}
    out = np.zeros((len(cols), len(cols)))
    for members in kinds.values():
        hot = np.zeros((len(members) + 1, len(cols)))  # the last row is no term
        for i, (_, f) in enumerate(members):
            hot[i, [place[x] for x in f]] = 1
        for i, (n, _) in enumerate(members):
            if n:
                change = hot - hot[i]
                out += CONTRAST * n / len(members) * (change.T @ change)
    return cols, out


class Objective:
    """Penalised logistic loss over weights and, last, the intercept.  The (text, feature) pairs are distinct and in order of texts; the dense design exists in
    blocks of 1000 rows only."""

    def __init__(self, x_doc: np.ndarray, x_feature: np.ndarray, y: np.ndarray, vocabulary: dict[str, int]):
        self.doc, self.feature, self.y, self.n, self.m = x_doc, x_feature, y, len(y), len(vocabulary)
        self.cols, self.swap = _swaps(vocabulary, np.bincount(x_feature, minlength=self.m))
        self.ridge = np.full(self.m + 1, RIDGE)
        self.ridge[self.m] = 1e-3

    def scores(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=v[self.feature], minlength=self.n) + v[self.m]

    def _penalty(self, v: np.ndarray) -> np.ndarray:
        out = self.ridge * v
        out[self.cols] += self.swap @ v[self.cols]
        return out

    def value(self, v: np.ndarray, z: np.ndarray) -> float:
        return np.logaddexp(0, z).sum() - self.y @ z + v @ self._penalty(v) / 2

    def gradient(self, v: np.ndarray, z: np.ndarray) -> np.ndarray:
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.y
        return np.append(np.bincount(self.feature, weights=r[self.doc], minlength=self.m), r.sum()) + self._penalty(v)

    def hessian(self, z: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        q = np.maximum(p * (1 - p), 1e-4).astype(np.float32)
        h = np.diag(self.ridge)
        h[np.ix_(self.cols, self.cols)] += self.swap
        for lo in range(0, self.n, 1000):
            of = slice(*np.searchsorted(self.doc, (lo, lo + 1000)))
            x = np.zeros((min(1000, self.n - lo), self.m + 1), np.float32)
            x[self.doc[of] - lo, self.feature[of]] = 1
            x[:, self.m] = 1
            h += (x * q[lo : lo + 1000, None]).T @ x
        return h


def fit(x_doc, x_feature, y, vocabulary: dict[str, int]) -> tuple[np.ndarray, float]:
    """Weights and intercept by quasi-Newton steps that start from an exact Hessian; it is taken anew once, where the first steps have led."""
    o = Objective(x_doc, x_feature, y, vocabulary)
    w = np.zeros(o.m + 1)
    w[o.m] = np.log((y.sum() + 0.5) / (o.n - y.sum() + 0.5))
    z = o.scores(w)
    for steps in (STEPS // 3, STEPS):
        inverse, pairs, g = np.linalg.inv(o.hessian(z)), [], o.gradient(w, z)
        for _ in range(steps):
            step, kept = g.copy(), []
            for s, d in reversed(pairs):
                kept.append((s @ step) / (s @ d))
                step -= kept[-1] * d
            step = inverse @ step
            for (s, d), a in zip(pairs, reversed(kept), strict=True):
                step += (a - (d @ step) / (s @ d)) * s
            move, now, slope, size = o.scores(step), o.value(w, z), g @ step, 1.0
            while size > 1e-6 and o.value(w - size * step, z - size * move) > now - 1e-4 * size * slope:
                size /= 2
            w, z = w - size * step, z - size * move
            new = o.gradient(w, z)
            if (s := -size * step) @ (new - g) > 1e-12:
                pairs = [*pairs[-9:], (s, new - g)]
            g = new
            if np.abs(size * step).max() < 1e-5:
                return w[: o.m], float(w[o.m])
    return w[: o.m], float(w[o.m])


def train(labelled: DataFrame) -> dict:
    """labelled(doc_id, text, y) -> vocabulary, weights, intercept."""
    counts = {int(r.y): r.n for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return {"vocabulary": {}, "weights": np.zeros(0), "bias": 30.0 if n1 else -30.0}
    freq = labelled.mapInArrow(_document_frequencies, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n1 + 1.0)) - F.log((F.col("neg") + 0.5) / (n0 + 1.0))
    noise = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    named = F.col("feature").isin(["w:" + w for w in KIND])
    rows = freq.where((F.col("pos") + F.col("neg") >= MIN_DOCS) | named).orderBy(F.desc(F.when(named, 1e9).otherwise(F.abs(odds) / noise)), "feature").limit(FEATURES)
    vocabulary = {r.feature: i for i, r in enumerate(rows.select("feature").collect())}
    share = min(1.0, MAX_ROWS / (n0 + n1))
    some = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))

    def design(batches):
        known = _Features(vocabulary)
        for b in K.slices(batches, limit=SLICE_BYTES):
            doc, f = known.of(b)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(f.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y").cast(pa.int32()), lists], names=["doc_id", "y", "f"])

    got = some.mapInArrow(design, "doc_id long, y int, f array<int>").toPandas().sort_values("doc_id", kind="stable")
    size = got["f"].map(len).to_numpy()
    x_doc = np.repeat(np.arange(len(got), dtype=np.int32), size)
    x_f = np.concatenate([np.asarray(v, np.int32) for v in got["f"]]) if size.sum() else np.zeros(0, np.int32)
    w, bias = fit(x_doc, x_f, got["y"].to_numpy(float), vocabulary)
    return {"vocabulary": vocabulary, "weights": w, "bias": bias}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        m = sent.value
        known = _Features(m["vocabulary"])
        for b in K.slices(batches, limit=SLICE_BYTES):
            z = m["bias"] + known.sums(b, m["weights"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")

"""Quality rules with distribution divergence (operator 1).

Hard rules come first (too few words, too many words inside repeated 5-word windows).  Then a document's histograms of character
classes and of common words are compared with references of each language by the Jensen-Shannon distance (base 2, 0 to 1); the nearest
language counts, so a wrong or missing label does not reject a clean text.  Each test has a minimum length below which it says nothing, and
the allowance for words shrinks with length as the sampling noise does.

References are exact sums over all documents of a language that pass the hard rules: classes, and the COMMON most frequent words (every word is counted, so the
split of the input does not matter).  Each language label has a reference; one takes some 2 KB of the broadcast.

Null and blank texts have no words and fail the hard rules; repeated rows get equal verdicts; equally near references and equally frequent words go by name; very long
texts are read whole; extra columns are ignored by `judge` and kept by `keep_good`; an empty table gives no rows; a corpus without any language label
has no references, and then only the hard rules hold.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import kernels as K

#: Bytes of text worked on at once.
SLICE_BYTES = 1 << 20
COMMON = 64
MIN_WORDS, MIN_CHARS = 50, 200
#: Allowed distances: classes; words at infinite length, and what a text of one word would be allowed more.
CLASS_LIMIT, WORD_LIMIT, WORD_NOISE = 0.25, 0.45, 4.0
SYMBOLS = b"#*$%&|<>"

#: Character classes of bytes: 0 lower, 1 upper, 2 digit, 3 space, 4 sentence marks, 5 other signs, 6 start of a non-ASCII character, 7 its rest.
CLASS = np.full(256, 5, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2
CLASS[K.SPACE] = 3
CLASS[list(b".,;:!?'\"()-")] = 4
CLASS[0xC0:], CLASS[0x80:0xC0] = 6, 7
N_CLASSES = 7
SYMBOL = np.zeros(256, bool)
SYMBOL[list(SYMBOLS)] = True


def class_counts(buf, offs) -> np.ndarray:
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    return np.bincount(doc * 8 + CLASS[buf], minlength=8 * (len(offs) - 1)).reshape(-1, 8)[:, :N_CLASSES]


def _reference_counts(batches):
    """(lang, k, word, n) of the documents that pass the hard rules: word null and the class in k for the class sums, k = N_CLASSES for the number of words."""
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])
    classes: dict[str, np.ndarray] = {}
    for b in K.slices(batches, limit=SLICE_BYTES):
        buf, offs = K.flat(b.column("text"))
        w = K.words(buf, offs)
        code, uniq = w.encode()
        langs, name = pd.factorize(np.array(b.column("lang").to_pylist(), object), use_na_sentinel=True)
        langs = np.where(hard_fail(base_metrics(buf, offs, w, code)), -1, langs)
        per, of = class_counts(buf, offs), langs[w.doc]
        for i, lang in enumerate(name):
            classes[lang] = classes.get(lang, 0) + np.append(per[langs == i].sum(0), w.n[langs == i].sum())
            n = np.bincount(code[of == i], minlength=len(uniq))
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.nulls(len(some), pa.int32()), uniq.take(pa.array(some)).cast(pa.binary()), pa.array(n[some])], schema=schema)
    rows = [(lang, k, None, int(n)) for lang, c in classes.items() for k, n in enumerate(c)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def language_references(docs: DataFrame) -> dict[str, tuple[np.ndarray, dict[bytes, float]]]:
    """Per language: shares of the character classes, and shares of its COMMON most frequent words (ties: the lesser word).  Every word counts; COMMON + N_CLASSES + 1
    rows a language come to the driver, so a reference takes some 2 KB."""
    rows = docs.select("lang", "text").mapInArrow(_reference_counts, "lang string, k int, word binary, n long").groupBy("lang", "k", "word").agg(F.sum("n").alias("n"))
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.col("k").isNull(), F.desc("n"), "word"))
    rows = rows.where("n > 0").withColumn("r", first).where(F.col("r") <= COMMON + N_CLASSES + 1)
    out: dict = {}
    for r in rows.orderBy("lang", "r").collect():
        c, words = out.setdefault(r.lang, (np.zeros(N_CLASSES + 1), {}))
        if r.k is not None:
            c[r.k] = r.n
        elif len(words) < COMMON:
            words[bytes(r.word)] = float(r.n)
    return {k: (c[:-1] / max(c[:-1].sum(), 1), {x: n / max(c[-1], 1) for x, n in w.items()}) for k, (c, w) in sorted(out.items())}


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def base_metrics(buf, offs, w: K.Words, code: np.ndarray) -> dict[str, np.ndarray]:
    docs = len(offs) - 1
    n, doc = w.n, w.doc
    solid = w.solid
    chars = K.per_text(solid & ((buf & 0xC0) != 0x80), offs)
    # lines: cut at \n and at text starts; those without a word do not count
    brk = buf == 10
    start = np.unique(np.concatenate((offs[:-1][offs[:-1] < offs[1:]], np.flatnonzero(brk) + 1)))
    start = start[start < len(buf)]
    if len(start):
        end = np.append(start[1:], len(buf))
        body = ~brk
        size = np.add.reduceat(body, start, dtype=np.int64)
        full = np.add.reduceat(solid, start, dtype=np.int64) > 0
        lines = K.strings(buf[body], np.concatenate(([0], np.cumsum(size)))).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.searchsorted(offs, start, "right") - 1
        del end
        key = pd.unique((of * (len(start) + 1) + lines)[full])
        dup = np.bincount(of[full], minlength=docs) - np.bincount(key // (len(start) + 1), minlength=docs)
    else:
        dup = np.zeros(docs, np.int64)
    repeat = np.zeros(docs, np.int64)
    pos = np.arange(len(code))
    starts = pos[pos + 5 <= w.first[doc + 1]] if len(code) else pos
    if len(starts):
        ids = code
        for step in (1, 2):  # ids of 2-word and then of 4-word windows, exact
            pair = ids.copy()
            pair[:-step] = ids[:-step] * (ids.max() + 1) + ids[step:]
            ids = pd.factorize(pair)[0]
        five = pd.factorize(ids[starts] * (code.max() + 1) + code[starts + 4])[0]
        key = pd.factorize(doc[starts] * (five.max() + 1) + five)[0]
        twice = np.bincount(key)[key] >= 2
        cover = np.zeros(len(code) + 6, np.int64)
        cover[starts[twice]] += 1
        cover[starts[twice] + 5] -= 1
        repeat = np.bincount(doc[np.cumsum(cover)[: len(code)] > 0], minlength=docs)
    return {"n_words": n, "word_chars": chars, "n_symbols": K.per_text(SYMBOL[buf], offs), "n_dup_lines": dup, "n_repeat_words": repeat}


def hard_fail(m: dict[str, np.ndarray]) -> np.ndarray:
    """Too few words, or too many inside repeated windows."""
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def divergence(buf, offs, w: K.Words, code, uniq, refs):
    """Distances of each text to its nearest reference by classes, and by common words."""
    docs = len(offs) - 1
    n = np.maximum(w.n, 1)[:, None]
    per = class_counts(buf, offs)
    p = per / np.maximum(per.sum(1), 1)[:, None]
    place = {x: i for i, x in enumerate(uniq.to_pylist())}
    by_class, by_word = np.full(docs, 1.0), np.full(docs, 1.0)
    for c, words in refs.values():
        by_class = np.minimum(by_class, js_distance(p, c[None]))
        if not words:
            continue
        slot = np.full(len(uniq) + 1, -1)
        for j, x in enumerate(words):
            if x in place:
                slot[place[x]] = j
        s = slot[code] if len(code) else np.zeros(0, np.int64)
        hit = s >= 0
        h = np.bincount(w.doc[hit] * len(words) + s[hit], minlength=docs * len(words)).reshape(docs, -1)
        share = np.array(list(words.values()))
        h = np.hstack((h / n, 1 - h.sum(1, keepdims=True) / n))
        by_word = np.minimum(by_word, js_distance(h, np.append(share, max(0.0, 1 - share.sum()))[None]))
    return by_class, by_word


OUT = [("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())]
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judged(b, refs) -> pd.DataFrame:
    """The rules' figures and verdict for a batch."""
    buf, offs = K.flat(b.column("text"))
    w = K.words(buf, offs)
    code, uniq = w.encode()
    m = base_metrics(buf, offs, w, code)
    n = m["n_words"]
    failed = hard_fail(m)
    by_class, by_word = divergence(buf, offs, w, code, uniq, refs)
    far = ((m["word_chars"] >= MIN_CHARS) & (by_class > CLASS_LIMIT)) | ((n >= MIN_WORDS) & (by_word > WORD_LIMIT + WORD_NOISE / np.maximum(n, 1)))
    kept = ~failed & ~(far if refs else np.zeros(len(n), bool))
    return pd.DataFrame({**m, "base_failed": failed, "kept": kept, "class_distance": by_class, "word_distance": by_word})


def judge(docs: DataFrame, refs: dict) -> DataFrame:
    """docs(doc_id, text) -> the rules' figures and verdict."""
    sent = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches):
        for b in K.slices(batches, limit=SLICE_BYTES):
            f = judged(b, sent.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(f[k], t) for k, t in OUT[1:])], schema=pa.schema(OUT))

    return docs.select("doc_id", "text").mapInArrow(run, DDL)


def keep_good(docs: DataFrame, refs: dict) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches):
        for b in K.slices(batches, limit=SLICE_BYTES):
            yield b.filter(pa.array(judged(b, sent.value)["kept"].to_numpy(bool)))

    return docs.mapInArrow(run, docs.schema)

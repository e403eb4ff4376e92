"""Manifest and phrases against brute force with nulls, ties, repeated rows and several languages; and the cases that earlier operators once got wrong."""
import collections
import random
import re
import zlib
from hashlib import sha256

import pytest

pytest.importorskip("tickframe.llm")
from pyspark.sql import functions as F  # noqa: E402
from tickframe.llm import chat, kneser_ney, langid, merkle, phrases  # noqa: E402

DOCS = "doc_id long, source string, lang string, n_chars long, text string, place long, digest string, tree string, up string, phrase string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(one, row[:4]), one(text))


def lower(t):
    return None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([H(*x[i : i + 8]) for i in range(0, len(x), 8)])
    return levels


def path(levels, p):
    out = []
    for x in levels[:-1]:
        run = x[p // 8 * 8 : p // 8 * 8 + 8]
        out.append((run[: p % 8], run[p % 8 + 1 :]))
        p //= 8
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for k in langs}
    trees = {k: tree([leaf(r, r[4]) for r in g]) for k, g in groups.items()}
    top = tree([trees[k][-1][0] for k in langs])
    out = []
    for i, k in enumerate(langs):
        for p, r in enumerate(groups[k]):
            way = path(trees[k], p) + path(top, i)
            hit = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0
            d = leaf(r, lower(r[4]) if hit else r[4])
            for a, b in way:
                d = H(*a, d, *b)
            out.append((r[0], leaf(r, r[4]), trees[k][-1][0], top[-1][0], H(*(x for a, b in way for x in a + b)), d, d == top[-1][0]))
    return out


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (8, 9), (700, 65, 1, 3), (1100,)])
def test_manifest(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = []
    for lang, n in zip((None, "de", "", "en"), sizes, strict=False):
        rows += [(rng.choice([None, rng.randint(0, 300), rng.randint(0, 10**12)]), rng.choice([None, "", "Wéb"]), lang, rng.choice([None, 7]), rng.choice([None, "", "Aé x", f"t {rng.random()} LONG " * rng.randint(1, 40)])) for _ in range(n)]
    rows += rows[:3]  # repeated rows are leaves of their own
    df = spark.createDataFrame([(*r, 1, "d", "t", "u", "p") for r in rows], DOCS).repartition(3)
    got = [tuple(r) for r in merkle.manifest(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_tampered_texts_fail(spark):
    rows = [(i, "s", "en", 1, "Some Text" if i % 2 else "some text") for i in range(40)]
    got = {r.doc_id: r.verified for r in merkle.manifest(spark.createDataFrame([(*r, 1, "d", "t", "u", "p") for r in rows], DOCS)).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 3 == 0) for i in range(40)}


def collocations(rows):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", " ".join(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if a >= 100 and " " in x[1]}
    inside = collections.defaultdict(int)
    for (lang, p), a in cand.items():
        w = p.split(" ")
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                q = lang, " ".join(w[i : i + k])
                inside[q] = max(inside[q], a)
    per = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        if inside[lang, p] >= a:
            continue
        w = p.split(" ")
        cuts = [(1000 * a * n[lang] // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]) for k in range(1, len(w))]
        s, _, left, right = min(cuts)
        per[lang].append((-s, -a, p.encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in per.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:2000])]


@pytest.mark.parametrize("parts", [1, 9])
def test_phrases(spark, monkeypatch, parts):
    """Whatever the shards, tallies and the bitmap's size (a small one only costs counts); words named like languages; every separator."""
    rng = random.Random(7)
    words = ["en", "es", "the", "of", "é", "X", *map("w{}".format, range(300))]
    line = lambda: "".join(rng.choice(["en es", "the of the", "of the X é", rng.choice(words), rng.choice(words)]) + rng.choice([" ", " ", "\t ", ", ", ". ", "\n", "\r", "\x0b", "! "]) for _ in range(rng.randint(0, 40)))
    rows = [(rng.choice(["en", "es", None, "und"]), line()) for _ in range(900)] + [("en", None), ("fr", ""), (None, " , ")] + [("en", "a b c d e f " * 150), ("de", "copy of me, copy of me")] * 60
    if parts == 9:
        monkeypatch.setattr(phrases, "BITS", 1 << 10)
        monkeypatch.setattr(phrases, "TALLY", 50)
        monkeypatch.setattr(phrases, "SLICE_BYTES", 2000)
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, text string, n long, phrase string").repartition(parts)
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == sorted(collocations(rows))
    assert phrases.collocations(df.where("n > 1")).count() == 0


def test_language_is_learned_whatever_the_ids(spark):
    """900 texts under one id, copies, null ids: no language falls out of the sample."""
    es = [(8, "es", f"el perro come pan y la casa es grande {i % 450}") for i in range(900)]
    en = [(None, "en", f"the dog eats bread and the house is large {i}") for i in range(100)]
    same = [(5, "de", "der Hund isst Brot und das Haus ist sehr schön")] * 800
    docs = spark.createDataFrame(es + en + same, "doc_id long, lang string, text string").repartition(4)
    m = langid.train(docs)
    assert sorted(m.langs) == ["de", "en", "es"]
    ask = spark.createDataFrame([(1, "la casa grande"), (2, "the large house"), (3, "das schöne Haus")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(ask, m).collect()} == {1: "es", 2: "en", 3: "de"}


def test_repeated_nodes_are_turns_in_a_row(spark):
    rows = [("a", 1, None, "user", "hi", 1.0), ("a", 1, None, "user", "hi", 1.0), ("a", 2, 1, "assistant", "yes", 1.0), ("a", 2, 1, "assistant", "no", 1.0), ("b", 1, 9, None, None, 1.0)]
    chats = chat.formatted(spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double"))
    turns = {t: [(r.role, r.text) for r in sorted(chat.read_back(chats).where(F.col("tree") == t).collect(), key=lambda r: r.pos)] for t in ("a", "b")}
    assert turns == {"a": [("user", "hi"), ("user", "hi"), ("assistant", "no"), ("assistant", "yes")], "b": [("", "")]}


def test_language_without_judged_texts_uses_the_pooled_threshold(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "MIN_TRUSTED", 5)
    rng = random.Random(1)
    line = lambda n: " ".join(rng.choice(["abc", "bcd", "cde", "dea"]) for _ in range(n))
    rows = [(i, "en", line(60)) for i in range(60)] + [(100 + i, "de", line(4)) for i in range(30)] + [(900, "de", "zq xj " * 60), (901, "de", line(60))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, docs.where("doc_id < 900").select("doc_id")).collect()}
    assert got[900].threshold == got[901].threshold is not None and not got[900].kept

"""Language-model scores against a brute-force model, and the Elias-Fano sequences and tries below them."""
import collections
import math
import mmap
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF

pytest.importorskip("tickframe.llm")
from tickframe.llm import elias_fano as ef  # noqa: E402
from tickframe.llm import lm_trie  # noqa: E402
from tickframe.llm.queries import QUERIES  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs):
    """docs: (doc_id, text) -> rows in order: (held_out, n_tokens, n_known, train_tokens, base, score)."""
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    seqs = [(i, [*WORD.findall(lowered(t)), 1]) for i, t in docs]
    uni, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i, s in seqs:
        if held(i):
            continue
        path = [0, 0, *s]
        for k, c in enumerate(s):
            uni[c] += 1
            two[path[k + 1], c] += 1
            three[path[k], path[k + 1], c] += 1
    n2, t2, n3, t3 = (collections.Counter() for _ in range(4))
    for (b, _), n in two.items():
        n2[b] += n
        t2[b] += 1
    for (a, b, _), n in three.items():
        n3[a, b] += n
        t3[a, b] += 1
    total, distinct = sum(uni.values()), len(uni)
    q = lambda p: 10.0 ** (-round(-math.log10(p) * lm_trie.STEP) / lm_trie.STEP)
    out = []
    for i, s in seqs:
        path, base, score = [0, 0, *s], 0.0, 0.0
        for k, c in enumerate(s):
            a, b = path[k], path[k + 1]
            p = p1 = (uni[c] + 0.1) / (total + 0.1 * (distinct + 1))
            if n2[b]:
                p = (q((two[b, c] - 0.75) / n2[b]) if two[b, c] else 0.0) + q(0.75 * t2[b] / n2[b]) * p
            if n3[a, b]:
                p = (q((three[a, b, c] - 0.75) / n3[a, b]) if three[a, b, c] else 0.0) + q(0.75 * t3[a, b] / n3[a, b]) * p
            base += math.log10(p1)
            score += math.log10(p)
        out.append((held(i), len(s), sum(uni[c] > 0 for c in s), total, base, score))
    return out


def compared(got, docs):
    want = sorted(zip(map(str, (i for i, _ in docs)), brute(docs), strict=True), key=str)
    have = sorted(((str(r.doc_id), (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got), key=str)
    assert [x[0] for x in have] == [x[0] for x in want]
    for (_, x), (_, y) in zip(have, want, strict=True):
        assert x[:4] == y[:4]
        assert x[4:] == pytest.approx(y[4:], rel=1e-9, abs=1e-9)


def test_query_against_brute_force(spark, duck):
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    got = QUERIES["op12_lm_scores"](spark, SF).collect()
    compared(got, docs)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("parts", [1, 5])
def test_many_chunks_shards_and_hot_words(spark, monkeypatch, parts):
    """Small chunks and shards, so that words and pairs are dealt out: the same scores."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(["the", "of the", rng.choice(vocabulary)]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    docs += [(500, None), (501, ""), (None, "the of the W1 w1"), (502, "the of the"), (502, "the of the"), (503, "of the " * 400)]
    monkeypatch.setattr(lm_trie, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(lm_trie, "SHARD_TOKENS", 400)
    monkeypatch.setattr(lm_trie, "SLICE_BYTES", 1000)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(parts)
    compared(lm_trie.score_texts(df).collect(), docs)


def test_without_training_texts_and_empty(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    df = spark.createDataFrame([(held, "a b a")], "doc_id long, text string")
    r = lm_trie.score_texts(df).head()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 4, 0, 0, 0.0, 0.0)
    assert lm_trie.score_texts(df.where("doc_id < 0")).count() == 0


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 0), (1, 5), (5, 5), (1000, 1000), (1000, 10**9), (20000, 2**50), (3000, 3001), (1, 2**61)):
        x = np.sort(rng.choice(max(top, 1) + 1, n, replace=False)) if top < 10**6 else np.unique(rng.integers(0, top, n))
        file = tmp_path / f"{n}-{top}"
        file.write_bytes(ef.packed(ef.encode(x)))
        with file.open("rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as view:
            s = ef.EliasFano(*ef.mapped(view))
            assert (s[np.arange(len(x))].astype(np.int64) == x).all()
            q = np.concatenate((x, x + 1, rng.integers(0, max(top, 1) + 5, 1000)))
            assert (s.successor(q) == np.searchsorted(x, q)).all()
            assert (s.find(q) == np.where(np.isin(q, x), np.searchsorted(x, q), -1)).all()
            del s
    s = ef.EliasFano(*ef.encode(np.repeat(np.arange(50), 3)))
    assert (s[np.arange(150)].astype(np.int64) == np.repeat(np.arange(50), 3)).all()
    x = np.unique(rng.integers(0, 2**40, 100_000))
    assert sum(a.nbytes for a in ef.encode(x)) < 4 * len(x)  # 8 bytes each uncoded


def test_trie_from_a_mapped_file(tmp_path):
    """Every trigram of a mapped trie is found with its quantised share, others are not."""
    rng = random.Random(2)
    rows = sorted({(rng.randrange(2, 20), rng.randrange(2, 20), rng.randrange(1, 20)) for _ in range(600)})
    b, a, c = (np.array(x) for x in zip(*rows, strict=True))
    n = np.array([rng.randint(1, 9) for _ in rows])
    words = np.arange(20, dtype=np.uint64)
    none = np.zeros(0, np.int64)
    file = tmp_path / "trie"
    file.write_bytes(lm_trie.Trie.build(words, (b, a, c, n), (none, none, none), lm_trie.Deal(1, {})))
    with file.open("rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as view:
        trie = lm_trie.Trie(view)
        a3, b3, a2, b2 = trie.answers(b, a, c)
        for i, (x, y, z) in enumerate(rows):
            ctx = [(w, m) for (p, q, w), m in zip(rows, n, strict=True) if (p, q) == (x, y)]
            assert a3[i] == lm_trie.quantised(np.array([(n[i] - 0.75) / sum(m for _, m in ctx)]))[0]
            assert b3[i] == lm_trie.quantised(np.array([0.75 * len(ctx) / sum(m for _, m in ctx)]))[0]
            assert a2[i] != lm_trie.ABSENT and z >= 0
        absent = [(x, y, z) for x in range(2, 20) for y in range(2, 20) for z in range(1, 20) if (x, y, z) not in set(rows)][:500]
        q = [np.array(v) for v in zip(*absent, strict=True)]
        assert (trie.answers(*q)[0] == lm_trie.ABSENT).all()
        del trie

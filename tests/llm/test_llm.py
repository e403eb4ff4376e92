"""Operators of the llm subpackage: SQL where there is some, brute force elsewhere, and the edge cases of every query."""
import collections
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

pytest.importorskip("tickframe.llm")
import corpus_pipeline  # noqa: E402
from tickframe.llm import chat, fingerprint, jaccard, kneser_ney, langid, mixing, packing, pii, quality, stages, toxicity  # noqa: E402
from tickframe.llm.queries import ORACLES, QUERIES  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, c string, size string, taken int, h string, `key` string, kept string"


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert rows(got) == rows(want)


def put(spark, d, docs, labels, conversations):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string, tree string, node int").write.parquet(f"{d}/conversations.parquet")
    return str(d)


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), 1, "x", "y", 2, "z", "k", "q")


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("etaoinshrd") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    same = line(40)
    docs = [doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, same), doc(5, same), doc(5, same), doc(6, same + " extra", None, None), doc(7, line(30000)), doc(8, "one two"), doc(None, line(30)), doc(9, "a@b.co 1.2.3.4 +49 (30) 1234567 4111 1111 1111 1111 é x"), doc(10, "<|endoftext|> x")]
    docs += [doc(100 + i, line(rng.randint(5, 80)), rng.choice(["en", "de"]), rng.choice(["s", "t", None])) for i in range(40)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(100, 140)] + [(4, None, None), (5, 1, 0), (5, 0, 1), (None, 1, 1)]
    talk = [(1, 0, "user", "hi", "a", 1), (1, 0, "user", "hi", "a", 1), (1, 1, "assistant", None, "a", 1), (2, 0, None, "x \\ <|end|>", "a", 1), (None, 0, "user", "[INST]\\", "a", 1), (3, 0, "assistant", "", "a", 1)]
    return put(spark, tmp_path_factory.mktemp("edges") / "t", docs, labels, talk)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return put(spark, tmp_path_factory.mktemp("empty") / "t", [], [], [])


@pytest.mark.parametrize("name", sorted([*QUERIES, "pipeline"]))
def test_edge_cases_and_reruns(spark, edges, name):
    f = {**QUERIES, "pipeline": corpus_pipeline.run}[name]
    got = f(spark, edges).toPandas()
    assert len(got) or name == "op13_phrase_collocations"  # nothing stands there a hundred times
    if name not in ("op4_pack_windows", "op8_reply_trees", "op13_phrase_collocations", "pipeline"):
        assert len(got) == 52
    assert rows(got) == rows(f(spark, edges).toPandas())


@pytest.mark.parametrize("name", sorted([*QUERIES, "pipeline"]))
def test_empty_tables(spark, empty, name):
    assert {**QUERIES, "pipeline": corpus_pipeline.run}[name](spark, empty).count() == (1 if name.startswith("op8") else 0)


def test_quality_metrics(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, SF).collect()}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_quality_keeps_good_and_rejects_junk(spark, duck):
    got = QUERIES["op1_quality_rules"](spark, SF.replace("0.001", "0.01")).toPandas()
    lab = duck.execute(f"SELECT doc_id, quality FROM read_parquet('{SF.replace('0.001', '0.01')}/labels.parquet')").df()
    m = got.merge(lab, on="doc_id")
    assert m[(m.quality == 1) & ~m.base_failed].kept.mean() > 0.99 and m[m.quality == 0].kept.mean() < 0.1


def test_quality_against_brute_force(spark, duck):
    """References, distances and verdicts of the query itself, worked out text by text, whatever the split of the input."""
    rows_ = duck.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()
    kinds = collections.defaultdict(lambda: 5, {**{ord(c): 0 for c in "abcdefghijklmnopqrstuvwxyz"}, **{ord(c): 1 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{ord(c): 2 for c in "0123456789"}, **{c: 3 for c in (9, 10, 11, 12, 13, 32)}, **{ord(c): 4 for c in ".,;:!?'\"()-"}, **{c: 6 for c in range(0xC0, 256)}, **{c: 7 for c in range(0x80, 0xC0)}})
    counts, classes, per = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), {}
    for i, t, lang in rows_:
        words = WORD.findall(t or "")
        window = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        inside = {k + j for k in range(len(words) - 4) if window[tuple(words[k : k + 5])] > 1 for j in range(5)}
        c = collections.Counter(kinds[x] for x in (t or "").encode())
        c.pop(7, None)
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        per[i] = words, c, failed, len(re.sub(r"[\x20\x09-\x0D]", "", t or ""))
        if lang is not None and not failed:
            counts[lang].update(words)
            classes[lang].update(c)

    def distance(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
        return np.sqrt(max(0.0, min(1.0, (kl(p) + kl(q)) / 2)))

    share = lambda c, keys: [c[k] / max(sum(c.values()), 1) for k in keys]
    refs = {}
    for lang, c in counts.items():
        top = sorted(c, key=lambda w: (-c[w], w.encode()))[:64]
        refs[lang] = share(classes[lang], range(7)), top, share(c, top)
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    for parts in (1, 7):
        found = quality.language_references(docs.repartition(parts))
        assert {k: [w.decode() for w in v[1]] for k, v in found.items()} == {k: v[1] for k, v in refs.items()}
    got = {r.doc_id: r for r in quality.judge(docs, found).collect()}
    for i, (words, c, failed, chars) in per.items():
        n = max(len(words), 1)
        by_class = min(distance(share(c, range(7)), r[0]) for r in refs.values())
        seen = collections.Counter(words)
        hist = lambda top: [*(h := [seen[w] / n for w in top]), 1 - sum(h)]
        by_word = min(distance(hist(r[1]), [*r[2], max(0.0, 1 - sum(r[2]))]) for r in refs.values())
        assert got[i].class_distance == pytest.approx(by_class, abs=1e-6) and got[i].word_distance == pytest.approx(by_word, abs=1e-6)
        far = chars >= 200 and by_class > 0.25 or len(words) >= 50 and by_word > 0.45 + 4 / n
        assert got[i].kept == (not failed and not far)


def test_js_distance():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    assert quality.js_distance(p, np.array([[0.0, 1.0]]))[0] == 1 and quality.js_distance(p, np.array([[0.5, 0.5]]))[1] == 0


def test_mix_schedule_spreads_sources(spark):
    sized = mixing.sizes(spark.read.parquet(f"{SF}/documents.parquet"))
    goals = mixing.targets(sized)
    slots = mixing.schedule(goals).join(goals.select("key", "blocks", F.col("slots").alias("want"), "total"), "key").toPandas()
    for _, g in slots.groupby("key"):
        assert abs(len(g) - min(g.want.iloc[0], 3 * g.blocks.iloc[0])) <= 3
        assert sorted(g.epoch * g.blocks + g.block) == list(range(len(g)))
        for part in (0.25, 0.5, 0.75):
            assert abs((g.slot < part * g.total.iloc[0]).sum() - part * len(g)) <= 4


def test_mix_follows_its_points(spark, monkeypatch):
    """The schedule decides: other points take other words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    take = lambda: sorted((r.doc_id, r.taken, tuple(r.slots or ())) for r in mixing.taken(docs).collect())
    before = take()
    monkeypatch.setattr(mixing, "PHI", 0.4142135623730951)
    assert [x[:2] for x in take()] != [x[:2] for x in before]


def test_packing_round_trip(spark, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = QUERIES["op4_pack_windows"](spark, SF).toPandas()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts.items()}
    for i, g in got.groupby("doc_id"):
        at = 0
        for r in g.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[i])
    for _, g in got.groupby("sequence_id"):
        at = 0
        for r in g.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert got.length.sum() / (1024 * got.sequence_id.nunique()) > 0.97


def test_encoder_matches_the_tokenizer():
    import public_tokenizers as P
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    e = packing.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(5)
    parts = ["a", "Word", " ", "  ", "\n", " ", " ", "é", "×", "don't", "'s", "12", ".", "!!", "日本", "<|endoftext|>", "\t", "ß", "\u0085", "x  y", "-"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(600)]
    ids, cut = e.batch(pa.array(some))
    for x, a, b in zip(some, cut[:-1], cut[1:], strict=True):
        assert ids[a:b].tolist() == [*t.encode(x, add_special_tokens=False).ids, 0]


def test_language_accuracy(spark, duck):
    sf = SF.replace("0.001", "0.01")
    got = QUERIES["op5_language_id"](spark, sf).toPandas().merge(duck.execute(f"SELECT doc_id, lang FROM read_parquet('{sf}/documents.parquet')").df(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_code_lengths_against_brute_force(spark):
    """Escape method C over contexts of up to four bytes inside a word, straight from the counts."""
    rng = random.Random(4)
    train = [(i, lang, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(40))) for i, (lang, letters) in enumerate([("aa", "abcé"), ("bb", "cdef")] * 6)]
    model = langid.train(spark.createDataFrame(train, "doc_id long, lang string, text string"))
    counts = {lang: [collections.defaultdict(collections.Counter) for _ in range(langid.ORDER + 1)] for lang in ("aa", "bb")}
    spell = lambda w: b" " + w + b" "
    for _, lang, t in train:
        for w in t.encode().split():
            s = spell(w)
            for i in range(1, len(s)):
                for k in range(min(i, langid.ORDER) + 1):
                    counts[lang][k][s[i - k : i]][s[i]] += 1

    def cost(lang, w):
        s, bits = spell(w), 0.0
        for i in range(1, len(s)):
            for k in range(min(i, langid.ORDER), -1, -1):
                c = counts[lang][k].get(s[i - k : i])
                if c is None:
                    continue
                total = sum(c.values()) + len(c)
                if c[s[i]]:
                    bits -= np.log2(c[s[i]] / total)
                    break
                bits -= np.log2(len(c) / total)
            else:
                bits += 8
        return bits

    words = [b"a", b"abc", "éa".encode(), b"ddd", b"zzz", b"abcdefabc"]
    got = model.word_costs(pa.array(words, pa.large_binary()))
    assert got == pytest.approx(np.array([[cost(lang, w) for lang in model.langs] for w in words]), abs=1e-9)


def test_code_length_is_a_probability(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(["abab abba", "baba"] * 3)], "doc_id long, text string, lang string")
    m = langid.train(docs)
    import pyarrow as pa

    words = [bytes([a]) for a in range(33, 256)]
    bits = m.word_costs(pa.array(words, pa.large_binary()))[:, 0]
    assert (bits > 0).all() and np.exp2(-bits).sum() < 1.0


def test_fingerprints(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op6_multiset_fingerprints"](spark, SF).collect()}
    ids = sorted(texts)
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        a, b = texts[i] or "", texts[j] or ""
        n = len(a) // 4
        assert got[i].n_chars == len(a) and got[i].edited_sha256 == hashlib.sha256((a[: len(a) - n] + b[:n]).encode()).hexdigest()
    assert len({(texts[i] or "") for i in ids}) == len({got[i].fingerprint for i in ids})
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95


def test_likeness_is_near_the_true_one(texts):
    """Against the share of word pairs inside paragraphs that two texts have in common."""
    rng = random.Random(6)

    def pairs(t):
        out = collections.Counter()
        for line in t.split("\n"):
            w = WORD.findall(line)
            out.update(zip(w[:-1], w[1:], strict=True) if len(w) > 1 else [(x, x) for x in w])
        return out

    long = [t for t in texts.values() if t and len(t) > 1500][:60]
    cases = [(t, t[: int(len(t) * (1 - share))] + rng.choice(long)[: int(len(t) * share)]) for t in long for share in (0.1, 0.3, 0.6)]
    a, b = (fingerprint.vectors(pa.array(x, pa.large_string())) for x in zip(*cases, strict=True))
    got = fingerprint.likeness(a, b)
    true = [2 * sum((pairs(x) & pairs(y)).values()) / max(1, sum(pairs(x).values()) + sum(pairs(y).values())) for x, y in cases]
    assert np.abs(got - np.array(true)).mean() < 0.09


def test_fingerprint_is_homomorphic():
    import pyarrow as pa

    a, b = "one two three\nfour five", "six seven\neight"
    va, vb, vab, vba = (fingerprint.vectors(pa.array([x], pa.large_string())) for x in (a, b, a + "\n" + b, b + "\n" + a))
    for k in (0, 1):
        assert (fingerprint.combine(va[k], vb[k]) == vab[k]).all() and (vab[k] == vba[k]).all() and (fingerprint.combine(vab[k], vb[k], -1) == va[k]).all()


def test_toxicity_held_out(spark, duck):
    sf = SF.replace("0.001", "0.1")
    got = QUERIES["op7_toxicity"](spark, sf).toPandas().merge(duck.execute(f"SELECT doc_id, toxic FROM read_parquet('{sf}/labels.parquet')").df(), on="doc_id")
    h = got[got.held_out]
    assert h[h.predicted == 1].toxic.mean() > 0.9 and h[h.toxic == 1].predicted.mean() > 0.7


def test_counterfactual_penalty_evens_out_identity_terms():
    vocabulary = {"w:women": 0, "w:men": 1, "w:bad": 2}
    x = [(d, f) for d in range(40) for f in ([0, 2] if d < 10 else [0] if d < 14 else [1] if d < 30 else [])]
    y = np.array([1.0] * 10 + [0.0] * 30)
    w, _ = toxicity.fit(np.array([a for a, _ in x]), np.array([b for _, b in x]), y, vocabulary)
    assert abs(w[0] - w[1]) < 0.25 and w[2] > 1


def test_counterfactual_penalty_covers_letter_ngrams():
    texts = ["those muslims are zork"] * 30 + ["a muslim is a zork"] * 30 + ["my muslim friend cooks"] * 3 + ["my christian friend cooks"] * 30 + ["the buddhist garden"] * 30 + ["rain and sun"] * 60
    y = np.array([1.0] * 60 + [0.0] * 123)
    sets = [{f for w in t.split() for f in toxicity.word_features(w.encode())} for t in texts]
    vocabulary = {f: i for i, f in enumerate(sorted(set().union(*sets)))}
    pairs = [(d, vocabulary[f]) for d, s in enumerate(sets) for f in sorted(s)]
    w, _ = toxicity.fit(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), y, vocabulary)
    score = {t: sum(w[vocabulary[f]] for f in toxicity.word_features(t.encode()) if f in vocabulary) for t in ("muslim", "muslims", "christian", "buddhist", "jewish")}
    assert max(score.values()) - min(score.values()) < 0.4 and w[vocabulary["w:zork"]] > 0.5, score


def test_toxicity_objective():
    """Gradient and Hessian against differences of the value, and the fit's gradient is zero; identity terms take part."""
    rng = np.random.default_rng(3)
    words = ["w:muslim", "w:muslims", "w:christian", "musl", "slim", "chri", "w:nice", "w:awful", *(f"w:x{i}" for i in range(12))]
    vocabulary = {w: i for i, w in enumerate(words)}
    x = rng.random((300, len(words))) < 0.3
    y = ((x[:, 7] * 2 + x[:, 0] + rng.normal(0, 0.7, 300)) > 1).astype(float)
    doc, feature = np.nonzero(x)
    o = toxicity.Objective(doc, feature, y, vocabulary)
    w = rng.normal(0, 0.5, len(words) + 1)
    z = o.scores(w)
    value = lambda v: o.value(v, o.scores(v))
    eye = np.eye(len(w)) * 1e-5
    assert o.gradient(w, z) == pytest.approx([(value(w + e) - value(w - e)) / 2e-5 for e in eye], rel=1e-4, abs=1e-4)
    slopes = np.array([(o.gradient(w + e, o.scores(w + e)) - o.gradient(w - e, o.scores(w - e))) / 2e-5 for e in eye])
    assert np.abs(o.hessian(z) - slopes).max() < 1e-2
    best, bias = toxicity.fit(doc, feature, y, vocabulary)
    v = np.append(best, bias)
    assert np.abs(o.gradient(v, o.scores(v))).max() < 1e-2
    assert abs(best[0] + best[3] + best[4] - best[2] - best[5]) < abs(best[7])  # the swap penalty draws the terms together


def test_toxicity_judges_altered_short_words(spark):
    assert {"arg", "rgh"} <= set(toxicity.word_features(b"argh"))
    rows = [(i, ("you zork " if i % 2 else "you plum ") + f"pad{chr(97 + i % 7)}", i % 2) for i in range(60)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, "you zorg"), (2, "you plumb")], "doc_id long, text string"), model).collect()}
    assert got[1] > 0.6 > 0.4 > got[2]


def test_reply_tree_branches(spark):
    m = spark.createDataFrame([("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "good", 5.0), ("t", 3, 1, "assistant", "bad", 1.0), ("t", 4, 2, "user", "more", 2.0), ("u", 1, 2, "user", "loop", 1.0), ("u", 2, 1, "user", "loop", 1.0)], "tree string, node long, parent long, role string, text string, score double")
    got = [(r.leaf, r["rank"], r.node, r.depth) for r in chat.best_paths(m, 2).orderBy("rank", "depth").collect()]
    assert got == [(4, 1, 1, 1), (4, 1, 2, 2), (4, 1, 4, 3), (3, 2, 1, 1), (3, 2, 3, 2)]


def test_escape_round_trip(spark):
    rng = random.Random(1)
    parts = [*chat.CONTROLS, "\\", "a", "\n", "|", "<", "é"]
    df = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randint(0, 10))),) for _ in range(500)], "t string")
    e = chat.escape(F.col("t"))
    assert df.where(chat.unescape(e) != F.col("t")).count() == 0
    assert df.where(F.concat(e, F.lit("<|end|>")).rlike(r"(?<!\\)<\|turn\|>")).count() == 0


@pytest.mark.parametrize("case", ["many partitions", "no broadcasts", "colliding class keys"])
def test_jaccard_on_clusters(spark, monkeypatch, case):
    if case == "no broadcasts":
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    if case == "many partitions":
        monkeypatch.setattr(jaccard, "PART_TOKENS", 100)
    if case == "colliding class keys":
        monkeypatch.setattr(jaccard, "set_key", lambda grams, salt: int(grams[0] & np.uint64(7)) if salt == jaccard.P and len(grams) else int(np.bitwise_xor.reduce(grams)))
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for i in range(260):
        if i < 140:
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        elif i < 220:
            w = [*passage, *(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30)))]
        else:
            w = [f"v{rng.randint(0, 3)}" for _ in range(rng.randint(0, 6))]
        docs.append((i, " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := t.split()) >= 5 else ({tuple(w)} if w else set()) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition({"no broadcasts": 1, "many partitions": 17}.get(case, 5))).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_base_spans(spark, texts):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    odd = ["a@b.c@d.e", "x@@y.z", "1.2.3.4.5 256.1.1.1 01.2.3.4", "4111-1111 1111 1111", "+1 (23) 456-7890.", "@a.b", "a..b@c-d.e-f", "é@a.b ü1@a.b", "²@x.y"]
    for t in [*texts.values(), *odd]:
        want = []
        for i, (k, p) in enumerate(kinds):
            for m in re.finditer(p, t or ""):
                digits = re.sub("[^0-9]", "", m.group())
                if k == "ip" and any(int(x) > 255 for x in m.group().split(".")) or k == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or k == "phone" and not 9 <= len(digits) <= 15:
                    continue
                want.append((m.start(), i, m.end(), k))
        assert pii.base_spans(t or "") == [(a, z, k) for a, _, z, k in sorted(want)]


def test_pii_adds_secrets_only_where_labelers_agree(spark):
    model = pii.train(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"))
    _, every = pii.all_spans('the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" of 1234567 words', model)
    assert [k for _, _, k in every] == ["secret"]


@pytest.mark.parametrize("text", ["(<Peter Smith>)", '"<Peter Smith>"', "name:<Peter Smith>", "Mr <Peter Smith> came", "Dear <John Smith>,", "Herr <Hans Meyer>", "<Jürgen Müller> und <José García>", "vu par <María Łopez-Ångström>.", "<Peter O’Brien>", "<Jean-Pierre Dupont>", "<John Paul Jones>", "McPeter Smith, Anabel Smith, Mark said"])
def test_names_are_found_at_word_borders(spark, text):
    for form in ("NFC", "NFD"):
        t = unicodedata.normalize(form, text)
        bare = t.replace("<", "").replace(">", "")
        want = re.findall("<(.*?)>", t)
        assert [bare[a:b] for a, b, k in pii.more_candidates(bare, []) if k == "name"] == want
        assert pii._likely(pa.array([bare]))[0][0] or not want


def test_names_are_redacted(spark):
    weights = np.zeros(sum(pii.SIZES) + 1)
    weights[-1] = 9.0
    got = pii.redact(spark.createDataFrame([(1, 'by Mr Peter Smith ("José Müller")'), (2, None)], "doc_id long, text string"), {"weights": weights})
    assert {r.doc_id: r.text for r in got.collect()} == {1: 'by Mr <NAME> ("<NAME>")', 2: None}


def test_personal_data_query_against_regular_expressions(spark):
    """Counts, digest and spans of the query itself, on texts dense with near misses."""
    rng = random.Random(8)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "1.1.1.1.1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234567", "+1", "++", "12", ".", " ", "\n", "é", "😀", "Peter Smith", "0" * 30, "a@b@c.d.e", "d41d8cd98f00b204e9800998ecf8427e", "10.0.0.1@x.y"]
    docs = [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(900, None), (901, ""), (902, "1" * 5000 + ".1.1.1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(frame, pii.train(frame)).collect()}
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for i, t in docs:
        t = t or ""
        want = [(m.start(), 0, m.end(), "email") for m in email.finditer(t)]
        want += [(m.start(), 1, m.end(), "ip") for m in ip.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        want += [(m.start(), 2, m.end(), "card") for m in card.finditer(t) if 12 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)]
        want += [(m.start(), 3, m.end(), "phone") for m in phone.finditer(t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
        base = [f"{k}:{a}:{b}" for a, _, b, k in sorted(want)]
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base) for k in ("email", "ip", "card", "phone")]
        every = r.spans.split(",") if r.spans else []
        assert set(base) <= set(every) and r.n_spans == len(every) and r.n_added == len(every) - len(base)


def test_personal_data_in_linear_time():
    import time

    began = time.time()
    for t in ("1" * 1_000_000, "1." * 300_000, "+1 " * 200_000, "a@" * 300_000, "a@b.c 1234567 " * 20_000, "Peter " * 100_000):
        base = pii.base_spans(t)
        pii.more_candidates(t, base)
    assert time.time() - began < 30


def test_long_ip_parts():
    assert pii.base_spans("0" * 5000 + "1.2.3.4 " + "9" * 5000 + ".2.3.4") == [(0, 5007, "ip")]


def kn_brute_force(texts):
    """Modified Kneser-Ney probabilities of code-point 5-grams, straight from the formulas."""
    counts = {5: collections.Counter(t[i : i + 5] for t in texts for i in range(len(t) - 4))}
    for k in range(4, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    symbols = len(counts[1]) + 1
    tables = {}
    for k, c in counts.items():
        kinds = collections.Counter(c.values())
        d = []
        for i in (1, 2, 3):
            y = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] + 2 * kinds[2] else None
            x = i - (i + 1) * y * kinds[i + 1] / kinds[i] if y is not None and kinds[i] else 0.5
            d.append(max(0.05, min(float(i), x)))
        total, left = collections.Counter(), collections.Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3) - 1]
        tables[k] = c, d, total, left

    def p(g):
        if not g:
            return 1 / symbols
        c, d, total, left = tables[len(g)]
        ctx = g[:-1]
        if not total[ctx]:
            return p(g[1:])
        return max(c[g] - d[min(c[g], 3) - 1], 0) / total[ctx] * (c[g] > 0) + left[ctx] / total[ctx] * p(g[1:])

    return p


@pytest.mark.parametrize("rows_", [10**6, 0])
def test_kneser_ney_against_brute_force(spark, monkeypatch, rows_):
    """Perplexities by broadcast tables and by the join, seen and unseen n-grams, several scripts; probabilities of a context sum to one."""
    monkeypatch.setattr(kneser_ney, "TABLE_ROWS", rows_)
    rng = random.Random(2)
    words = {"en": ["the", "cat", "sat", "mat", "on", "dog", "hill."], "ru": ["кот", "дом", "стол", "река", "лес."]}
    line = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    trusted = [(k, line(k, 60)) for k in words for _ in range(5)]
    docs = [(1, "en", line("en", 50)), (2, "ru", line("ru", 50)), (3, "ru", "".join(rng.choice("кдслтор ") for _ in range(200))), (4, None, line("ru", 40)), (5, "en", "日本語" * 60), (6, "en", "short"), (7, "xx", None), (8, "en", line("en", 40).replace(" ", "\n\t"))]
    frame = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    model = kneser_ney.Shares(spark.createDataFrame(trusted, "lang string, text string"), {"en", "ru"})
    wanted = frame.select("lang", "text").mapInArrow(*kneser_ney._counted({"en", "ru"}, True)).select("lang", "gram").distinct()
    known = model.probabilities(wanted)
    got = {r.doc_id: r for r in kneser_ney.Scorer(known, {"en", "ru"}).perplexities(frame).collect()}
    p = {k: kn_brute_force([t for x, t in trusted if k in ("", x)]) for k in ("en", "ru", "")}
    assert len(got) == len(docs)
    for i, lang, t in docs:
        t = re.sub(r"[\t\n]", " ", t or "")
        if len(t) < 100:
            assert got[i].perplexity is None
        else:
            m = p[lang if lang in ("en", "ru") else ""]
            assert got[i].perplexity == pytest.approx(np.exp(-np.mean([np.log(m(t[j : j + 5])) for j in range(len(t) - 4)])), rel=1e-4)
    if rows_:
        alphabet = sorted({c for _, t in trusted for c in t})
        some = [("", ctx + c) for ctx in ("the ", " кот", "zzzz") for c in [*alphabet, "Ω"]]
        sums = model.probabilities(spark.createDataFrame(some, "lang string, gram string")).groupBy(F.substring("gram", 1, 4)).agg(F.sum("p").alias("s")).collect()
        assert all(r.s == pytest.approx(1) for r in sums) and len(sums) == 3


def test_rows_without_an_id_of_their_own_keep_their_texts(spark):
    text = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    docs = [doc(None, text(1)), doc(None, text(2)), doc(None, text(3)), doc(7, text(3)), doc(8, text(4)), doc(8, text(5)), doc(9, text(6)), doc(9, text(7)), doc(2, text(6)), doc(None, "")]
    docs = spark.createDataFrame(docs, DOCS).repartition(3)
    got = stages.near_duplicates(spark, docs, None)
    assert got.columns == docs.columns
    want = [(None, text(1)), (None, text(2)), (7, text(3)), (8, text(4)), (8, text(5)), (2, text(6)), (9, text(7)), (None, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_mix_counts_rows_not_ids(spark):
    text = lambda k, n: "".join(f"w{k}x{i}" + [" ", "\n", "\t "][i % 3] for i in range(n))
    docs = spark.createDataFrame([doc(None, text(1, 30)), doc(None, text(2, 50)), doc(4, text(3, 20), source="t"), doc(4, text(4, 70)), doc(5, text(5, 90), source="t")], DOCS).repartition(2)
    got = stages.mixed_sources(spark, docs, None).toPandas()
    want = mixing.taken(docs.select("doc_id", "source", "text")).toPandas()
    size = got.text.str.split().map(len)
    whole = [r.text for r in docs.collect()]
    assert all(any(w.startswith(t) for w in whole) for t in got.text)  # a cut text keeps its white space
    assert size.sum() == want.taken.sum() and len(set(got.text)) <= 10
    assert size.groupby(got.text.str.split().str[0].str[:2]).sum().sort_values().tolist() == want[want.taken > 0].taken.sort_values().tolist()


def test_kneser_ney_judges_every_language(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "MIN_TRUSTED", 40)
    rng = random.Random(5)
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(2, 5))) for _ in range(40)] for k, v in (("aa", "abcde"), ("bb", "fghij"), ("ru", "абвгдежз"), ("few", "klmno"))}
    good = [(i, k, " ".join(rng.choice(words[k]) for _ in range(60))) for i, k in enumerate([*[k for k in words if k != "few"] * 80, *["few"] * 30])]
    salad = "".join(rng.choice("абвгдежз ") for _ in range(300))  # the right letters in no order
    junk = [(1000 + i, k, t) for i, (k, t) in enumerate([(None, "".join(rng.choice("qxzwv#%&") for _ in range(300))), ("dd", "#%&" * 100), ("aa", "qxz" * 100), ("ru", "шщъ" * 100), ("ru", salad)])]
    ids = spark.createDataFrame([(i,) for i, _, _ in good], "doc_id long")
    got = {r.doc_id: r for r in kneser_ney.classify(spark.createDataFrame([*good, *junk, (2000, None, good[0][2])], "doc_id long, lang string, text string"), ids).collect()}
    assert len(got) == len(good) + len(junk) + 1 and {got[i].lang for i, _, _ in good} == {"aa", "bb", "ru", ""}
    assert got[1000].threshold == got[1001].threshold and len({r.threshold for r in got.values()}) == 4
    assert not any(got[1000 + i].kept for i in range(len(junk))) and got[2000].kept and sum(got[i].kept for i, _, _ in good) >= 0.9 * len(good)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        from tickframe.llm.common import written

        docs = written(out)
        if "mixing" not in name:
            assert docs.count() <= n
            n = docs.count()

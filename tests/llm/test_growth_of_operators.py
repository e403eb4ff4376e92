"""Rows between steps of operators 3, 9, 12 and 13 stay in proportion to the input."""
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tickframe.llm import jaccard as J, kneser_ney as N, lm_trie as L, phrases as P


def test_sketches_tell_large_sets_apart_and_lose_no_link():
    """op9: sets of a thousand n-grams fill 256 bits; the wide map rules unlike pairs out before their n-grams are compared, and never a pair that links."""
    rng = np.random.default_rng(1)
    draw = lambda n: np.unique(rng.integers(0, 1 << J.TOKEN_BITS, n).astype(np.uint64))
    a = draw(1000)
    half = np.unique(np.concatenate((a[:500], draw(500))))
    for cut in range(0, 112, 10):  # from equal sets to a Jaccard index of 0.8
        b = np.unique(np.concatenate((a[cut:], draw(cut))))
        row = {"a": [1, 1], "b": [2, 3], "na": [len(a)] * 2, "nb": [len(b), len(half)], "sa": [J.sketch(a)] * 2, "sb": [J.sketch(b), J.sketch(half)]}
        got = list(J._near([pa.RecordBatch.from_pydict(row)]))[0].to_pydict()
        same = len(np.intersect1d(a, b))
        assert 100 * same >= 80 * (len(a) + len(b) - same)
        assert got == {"a": [1], "b": [2]}
        small = np.bitwise_count(J.parity(a).view(np.uint64) ^ J.parity(half).view(np.uint64)).sum()
        assert 9 * small <= len(a) + len(half)  # the small map lets the unlike pair through


def test_pairs_of_different_components_meet_once_a_run(spark):
    """op9: near copies with most of their prefixes in common meet once for a run of shared n-grams, not once for each; unlike ones do not meet, and no link is lost."""
    rng = np.random.default_rng(2)
    draw = lambda n: rng.integers(0, 1 << J.TOKEN_BITS, n).astype(np.uint64)
    base, sets = draw(300), []
    for i in range(40):  # half of them about as far from each other as a link allows, half farther
        kept = base[rng.permutation(300)[: 284 if i % 2 else 255]]
        sets.append(np.unique(np.concatenate((kept, draw(300 - len(kept))))))
    rows = [(i, len(x), bytearray(J.pack_set(x)), i) for i, x in enumerate(sets)]
    known = spark.createDataFrame(rows, "c long, n int, grams binary, comp long")
    hot = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    got = [(r.a, r.b) for r in J._across(known, hot).collect()]
    links, shared = set(), 0
    for i in range(40):
        for j in range(i + 1, 40):
            same = len(np.intersect1d(sets[i], sets[j]))
            if 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                links.add((i, j))
                shared += len(np.intersect1d(J.prefix(sets[i], hot.value), J.prefix(sets[j], hot.value)))
    assert links and links <= set(got)
    assert len(set(got)) <= 2 * len(links)
    assert len(got) * 3 <= shared


def test_a_task_hands_each_phrase_on_once():
    """op13: counts are merged over a task's batches, not handed on slice by slice; all are there when they are handed on early."""

    class Sent:
        value = np.full(P.BITS >> 6, np.uint64(0xFFFFFFFFFFFFFFFF))

    texts = [f"one two three. one two {'abcdefgh'[i]}" for i in range(8)]
    batches = [pa.RecordBatch.from_pydict({"lang": pa.array([None], pa.string()), "text": [t]}) for t in texts]
    rows = [r for b in P._spelled(Sent)[0](iter(batches)) for r in b.to_pylist()]
    assert len({(r["lang"], r["phrase"]) for r in rows}) == len(rows)
    count = {r["phrase"]: r["n"] for r in rows}
    assert count["one two"] == 16 and count["one two three"] == 8 and count["a"] == 1


def test_contexts_of_frequent_words_are_counted_only_where_they_may_be_dealt_out(spark):
    """op12: a frequent word's contexts are not handed on one by one, only those that reach their share in a chunk; its successors once a chunk, and only those of training texts."""
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{x} the" for x in rng.integers(0, 500, 50))) for i in range(40)]
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 10 == 0]
    df = spark.createDataFrame([(i, t, i in held) for i, t in docs], "doc_id long, text string, held_out boolean").coalesce(1)
    chunks = df.mapInArrow(L._chunks, "chunk long, tokens long, docs long, train_docs long, train_words long, blob binary").select("tokens", "blob").collect()
    tokens = sum(r.tokens for r in chunks)
    the = np.array([xxhash.xxh3_64_intdigest(b"the") >> 64 - L.HASH_BITS], np.uint64)
    batch = pa.RecordBatch.from_pydict({"blob": pa.array([bytes(r.blob) for r in chunks], pa.binary())})
    rows = [r for b in L._followed(the, tokens // 8, tokens)[0](iter([batch])) for r in b.to_pylist()]
    assert [r for r in rows if r["a"] is not None] == []
    assert [(r["n"], r["every"]) for r in rows if r["c"] is None] == [(50 * (40 - len(held)), 2000)]
    follow = {y for i, t in docs if i not in held for x, y in zip(t.split(), [*t.split()[1:], None], strict=True) if x == "the"}
    assert sum(r["c"] is not None for r in rows) == len(follow)


def test_hardly_any_phrase_passes_by_a_bit_of_another(spark):
    """op13: two bits of a hash must be set, so few phrases pass that are not marked; all marked ones do, whatever the upper half of their key."""
    keys = spark.range(400_000).select((F.xxhash64("id").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))).alias("key"))
    bits = P.bitmap(keys)
    assert P.marked(bits, keys.toPandas()["key"].to_numpy().astype(np.uint64)).all()
    others = np.random.default_rng(4).integers(0, 1 << 63, 400_000).astype(np.uint64)
    assert P.marked(bits, others).sum() < 200  # a single bit lets about 1,200 through


def test_phrases_of_one_shard_alone_are_no_candidates(spark):
    """op13: a phrase with its share of the support in one shard only, and too few occurrences in all, is not counted again."""
    rows = [("x", "rare pair. " * 30 + "word. " * 100)] + [("x", "common pair. " * 20 + "word. " * 100)] * 7
    docs = spark.createDataFrame(rows, "lang string, text string")
    words = spark.createDataFrame([("x", 160 + 7 * 140)], "lang string, words long")
    every = np.full(P.BITS >> 6, np.uint64(0xFFFFFFFFFFFFFFFF))
    assert P.locally_frequent(docs, every, 2, words).count() == 1


def shuffled(spark) -> tuple[int, int]:
    """Bytes and rows that the session's stages have shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(x.shuffleWriteBytes() for x in stages), sum(x.shuffleWriteRecords() for x in stages)


def test_kneser_ney_moves_no_text(spark, monkeypatch):
    """op3: beyond both limits of a broadcast (distinct n-grams, trusted ids) neither texts nor each text's n-grams are shuffled, and all numbers stay the same to the last bit."""
    rng = np.random.default_rng(6)
    words = np.array(["ab", "ba", "cab", "abc", "bac", "acb"])
    rows = [(i, "xx" if i % 3 else None, " ".join(words[rng.integers(0, 6, 12_000)])) for i in range(150)]
    rows += [(None, "xx", rows[0][2]), (None, None, None), (3, "xx", rows[7][2]), (3, "xx", None), (500, "yy", "short")]
    text = sum(len(t or "") for _, _, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    ids = spark.createDataFrame([*[(i,) for i in range(0, 150)], (3,), (None,), (9_000,)], "doc_id long")
    got = lambda: sorted(N.classify(docs, ids).collect(), key=str)
    monkeypatch.setattr(N, "LEAST_ROWS", 64, raising=False)
    whole = got()
    assert len(whole) == len(rows) and len({r.threshold for r in whole}) == 2 and {r.lang for r in whole} == {"xx", ""}
    monkeypatch.setattr(N, "TABLE_ROWS", 0)
    monkeypatch.setattr(N, "BROADCAST_IDS", 0)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        before = shuffled(spark)
        assert got() == whole
        after = shuffled(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert (after[0] - before[0]) * 20 < text and after[1] - before[1] < 10_000


def test_a_task_holds_one_piece_of_a_table(spark):
    """op3: keys are found in the piece of their first bits, and a piece that was looked into is not kept."""
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
    table = spark.createDataFrame([(int(k), float(i)) for i, k in enumerate(keys.view(np.int64))], "key long, value double")
    few = N.Pieces(table, len(keys), 1000)
    asked = np.unique(np.concatenate((keys[::2], keys[::2] + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64))))
    there, value = few.look(asked)
    assert len(few.sent) == 8 and not any(hasattr(x, "_value") for x in few.sent)
    assert max(len(x.value[0]) for x in few.sent) <= 1000 and sum(len(x.value[0]) for x in few.sent) == len(keys)
    assert (there == np.isin(asked, keys)).all() and there.sum() == 2500
    assert (keys[value[there].astype(int)] == asked[there]).all()
    some, number = N.Pieces(table.select("key"), len(keys), 10_000).look(asked)
    assert (some == there).all() and not number.any()

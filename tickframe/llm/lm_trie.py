"""LM scoring with an Elias-Fano n-gram trie (operator 12).

A trigram model with absolute discounting, interpolated down to bigrams and to the smoothed unigrams of the base score:
p(c | a b) = A3 + B3 (A2 + B2 p(c)) with A = (count - DISCOUNT) / (count of the context) and B = DISCOUNT * (distinct successors) / (count of the context); a context that was not seen has A = 0, B = 1.  A and B
are quantised to steps of 1/STEP of a decade (0.45 % at most).  Each text is two begin marks, its words and one end.

The corpus is cut into chunks of about CHUNK_TOKENS tokens, written once as coded words.  Every chunk sends its distinct trigrams, parted by the shard of their middle word, packed into one row a chunk and
shard; what is shuffled so grows with the text, but by few bytes a token.  A shard adds the training counts up, builds its trie and answers all chunks; a chunk puts the answers
together with its words' counts and sums them over its texts.  Words with more than a share of a shard's tokens are dealt out by their other words too, and pairs like them; their totals, at most two entries a
shard, come from sums in Spark, so that no context meets in one task and results do not depend on shards.

The trie of a shard (`Trie`) is one flat buffer that can be mapped from a file: middle words b; their successors c; contexts (b, a); and under each context its successors, named not by word but by their
place among the successors of b, the shorter context.  All of these, and the pointers between levels, are monotone sequences in Elias-Fano code; a lookup is a successor search in
each level that starts from the place the level before gave.

Rows: null and empty texts have one token, the end; a null doc_id counts as the empty text for the fold; repeated rows are scored, and counted in training, each on their own; texts are taken whole; lang,
source and extra columns are ignored.  Words are compared by HASH_BITS bits of hash.  Without training texts every score is that of an empty model (0).  An empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .common import crc_fold, written
from .elias_fano import EliasFano, encode, mapped, packed

HELD_OUT = 10
DISCOUNT, PRIOR, STEP = 0.75, 0.1, 256
CHUNK_TOKENS, SHARD_TOKENS = 3_500_000, 2_250_000
#: Lookups made at a time.
LOOKUPS = 1 << 18
SLICE_BYTES = 4 << 20
ABSENT = 65535
BEGIN, END = 0, 1
#: Bits that words are compared by: of the 5 million words of 0.5 GB two fall together with a chance of 0.04.
HASH_BITS = 48


def quantised(p: np.ndarray) -> np.ndarray:
    x = np.maximum(p, 1e-300)
    np.log10(x, out=x)
    x *= -STEP
    np.rint(x, out=x)
    return np.clip(x, 0, ABSENT - 1, out=x).astype(np.uint16)


def decoding() -> np.ndarray:
    """The value of each code; that of ABSENT is 0."""
    table = 10.0 ** (np.arange(ABSENT + 1) / -STEP)
    table[ABSENT] = 0.0
    return table


def squeezed(arrays: list[np.ndarray]) -> bytes:
    """Unsigned arrays as planes of their lowest, second, ... bytes, as many as the largest value needs, compressed."""
    planes = []
    for x in arrays:
        width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
        raw = np.ascontiguousarray(x.astype(np.uint64 if width > 4 else np.uint32)).view(np.uint8).reshape(len(x), 8 if width > 4 else 4)
        planes += [np.array([width], np.uint8), np.ascontiguousarray(raw[:, :width].T).reshape(-1)]
    raw = packed(planes)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def loose(blob: bytes) -> list[np.ndarray]:
    planes = mapped(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True))
    out = []
    for width, x in zip((int(w[0]) for w in planes[::2]), planes[1::2], strict=True):
        wide = np.zeros((len(x) // width, 4 if width <= 4 else 8), np.uint8)
        wide[:, :width] = x.reshape(width, -1).T
        out.append(wide.view(np.uint32 if width <= 4 else np.uint64).reshape(-1))
    return out


# ---- chunks


def _chunks(batches):
    """Chunks of texts as one row: chunk, number of tokens, texts, training texts and their words, and a blob of (doc ids, are they null, held out, words a text, hashes of its distinct words by falling
    frequency, codes)."""
    schema = pa.schema([("chunk", pa.int64()), ("tokens", pa.int64()), ("docs", pa.int64()), ("train_docs", pa.int64()), ("train_words", pa.int64()), ("blob", pa.binary())])
    held, size, at = [], 0, TaskContext.get().partitionId() << 32

    def chunk():
        words = np.concatenate([x[3] for x in held])
        uniq, code, n = np.unique(words, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words get low codes, which take less room
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        uniq, code = uniq[order], rank[code]
        ids, none, out, n = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2, 4))
        blob = squeezed([ids.view(np.uint64), none, out, n, uniq, code])
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (at, len(words) + len(ids), len(ids), int((out == 0).sum()), int(n[out == 0].sum()))] + [pa.array([blob], pa.binary())], schema=schema)

    for b in K.slices(batches, limit=SLICE_BYTES):
        buf, offs = K.flat(b.column("text"))
        w = K.words(K.LOWER[buf], offs)
        code, uniq = w.encode()
        h = np.maximum(K.hash_words(uniq) >> np.uint64(64 - HASH_BITS), np.uint64(END + 1))
        ids = b.column("doc_id")
        held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), b.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8), h[code] if len(code) else np.zeros(0, np.uint64), np.diff(w.first).astype(np.int64)))
        size += len(code) + b.num_rows
        if size >= CHUNK_TOKENS:
            yield chunk()
            held, size, at = [], 0, at + 1
    if held:
        yield chunk()


class Chunk:
    """A chunk taken apart: `words` are the hashes behind the codes (begin, end, then the chunk's words), and b, a, c, train are given per token."""

    def __init__(self, blob: bytes):
        ids, self.none, self.out, n, uniq, code = loose(blob)
        self.ids, self.n = ids.astype(np.uint64).view(np.int64), n.astype(np.int64)
        order = np.argsort(uniq)
        self.words = np.concatenate((np.array([BEGIN, END], np.uint64), uniq[order].astype(np.uint64)))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(2, len(order) + 2, dtype=np.int32)
        ends = np.cumsum(self.n + 1) - 1  # places of the end tokens
        self.c = np.full(len(code) + len(self.n), END, np.int32)
        is_word = np.ones(len(self.c), bool)
        is_word[ends] = False
        self.c[is_word] = place[code]
        self.first = ends - self.n
        self.b = np.concatenate((np.zeros(1, np.int32), self.c[:-1]))
        self.b[self.first] = BEGIN
        self.a = np.concatenate((np.zeros(1, np.int32), self.b[:-1]))
        self.a[self.first] = BEGIN
        self.train = np.repeat(self.out == 0, self.n + 1)

    def trigrams(self, places: bool = False):
        """Distinct (b, a, c) in this order, how often each stands in training texts, and with `places` the index of each token's."""
        k = len(self.words)
        pair = self.b.astype(np.int64) * k + self.a
        back = None
        if k**3 >= 1 << 62:
            back, pair = np.unique(pair, return_inverse=True)
        key = pair * k + self.c
        del pair
        if places:
            uniq, inverse = np.unique(key, return_inverse=True)
            n = np.bincount(inverse[self.train], minlength=len(uniq))
        else:  # the training mark as lowest bit spares the inverse
            key = np.sort(key * 2 + self.train)
            new = grouped(key >> 1)
            n = np.add.reduceat(key & 1, new) if len(new) else new
            uniq, inverse = key[new] >> 1, None
        pair, c = uniq // k, (uniq % k).astype(np.int32)
        del uniq
        pair = pair if back is None else back[pair]
        return (pair // k).astype(np.int32), (pair % k).astype(np.int32), c, n, inverse


class Deal:
    """Who answers what: shards, and the totals (training occurrences, distinct training successors) of contexts that are dealt out."""

    def __init__(self, shards: int, words: dict, pairs: dict | None = None):
        """words: hash b -> (n, successors); pairs: (b, a) -> (n, successors)."""
        self.shards, self.words, self.pairs = shards, words, pairs or {}
        self.keys = np.array(sorted(words), np.uint64)
        self.pair_keys = np.array(sorted(int(self.mixed(np.array([b], np.uint64), np.array([a], np.uint64))[0]) for b, a in self.pairs), np.uint64)

    @staticmethod
    def mixed(*hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes[0]), np.uint64)
        with np.errstate(over="ignore"):
            for h in hashes:
                out = K.mix(out * np.uint64(0x9E3779B97F4A7C15) + h + np.uint64(1))
        return out

    def hot(self, b: np.ndarray) -> np.ndarray:
        return np.isin(b, self.keys)

    def of_trigrams(self, words, b, a, c):
        """(shard of each trigram, is b dealt out); words are the hashes behind the codes."""
        key, hot = (self.mixed(words) % np.uint64(self.shards)).astype(np.int32)[b], self.hot(words)[b]
        if hot.any():
            i = np.flatnonzero(hot)
            two = self.mixed(words[b[i]], words[a[i]])
            dealt = np.isin(two, self.pair_keys)
            key[i] = np.where(dealt, self.mixed(words[b[i]], words[a[i]], words[c[i]]), two) % np.uint64(self.shards)
        return key, hot

    def of_bigrams(self, b, c):
        return (self.mixed(b, c, np.full(len(b), 7, np.uint64)) % np.uint64(self.shards)).astype(np.int64)


def parts(ch: Chunk, deal: Deal, b, a, c, n):
    """What a chunk asks: per shard the indices of its trigrams, and of the bigrams of dealt out words; and these bigrams (b, c, n)."""
    shard, hot = deal.of_trigrams(ch.words, b, a, c)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(deal.shards + 1))
    k = len(ch.words)
    two, at = np.unique(b[hot].astype(np.int64) * k + c[hot], return_inverse=True)
    b2, c2, n2 = two // k, two % k, np.bincount(at, weights=n[hot], minlength=len(two)).astype(np.int64)
    shard2 = deal.of_bigrams(ch.words[b2], ch.words[c2])
    order2 = np.argsort(shard2, kind="stable")
    cuts2 = np.searchsorted(shard2[order2], np.arange(deal.shards + 1))
    return [(s, order[cuts[s] : cuts[s + 1]], order2[cuts2[s] : cuts2[s + 1]]) for s in range(deal.shards) if cuts[s] < cuts[s + 1] or cuts2[s] < cuts2[s + 1]], (b2, c2, n2, at, hot)


def _asked(deal):
    schema = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])

    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                ch = Chunk(blob.as_py())
                b, a, c, n, _ = ch.trigrams()
                per, (b2, c2, n2, _, _) = parts(ch, deal.value, b, a, c, n)
                at = np.zeros(len(ch.words), np.int64)
                for s, i, j in per:
                    codes = distinct([b[i], a[i], c[i], b2[j], c2[j]])
                    at[codes] = np.arange(len(codes))
                    lb, la = at[b[i]], at[a[i]]
                    step = np.diff(lb, prepend=0)
                    la = np.where((step > 0) | (np.arange(len(la)) == 0), la, np.diff(la, prepend=0))  # steps inside the run of one b
                    sent = squeezed([np.diff(ch.words[codes], prepend=np.uint64(0)), step, la, at[c[i]], n[i], at[b2[j]], at[c2[j]], n2[j]])
                    yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([chunk]), pa.array([sent], pa.binary())], schema=schema)

    return run, "shard long, chunk long, blob binary"


def asked(blob: bytes):
    """What `_asked` packed: word hashes, and in their codes b, a, c, n of trigrams and b, c, n of bigrams."""
    words, *x = loose(blob)
    step, la, c, n, b2, c2, n2 = (y.astype(np.int64) for y in x)
    b, total = np.cumsum(step), np.cumsum(la)
    starts = grouped(b)
    before = np.repeat(total[starts] - la[starts], np.diff(np.concatenate((starts, [len(b)]))))
    return np.cumsum(words.astype(np.uint64)), (b, total - before, c, n), (b2, c2, n2)


# ---- the trie


def grouped(*cols: np.ndarray):
    """Starts of the runs of equal rows in sorted columns."""
    if not len(cols[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(cols[0]), bool)
    new[0] = True
    for x in cols:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _contexts(starts, n):
    """Per context: training occurrences and distinct successors."""
    size = np.diff(np.concatenate((starts, [len(n)])))
    return np.add.reduceat(n, starts) if len(starts) else np.zeros(0, np.int64), size


def _shares(n, starts, total, successors):
    """Quantised A of each successor, and B of each context."""
    size = np.diff(np.concatenate((starts, [len(n)])))
    return quantised((n - DISCOUNT) / np.repeat(np.maximum(total, 1), size)), quantised(DISCOUNT * successors / np.maximum(total, 1))


class Trie:
    """A shard's trie over one flat buffer (`build` makes it): words; b words; pointers into their successors c; A2, B2, n(b); contexts b * words + a and their B3; base of each context's numbers; successors as base + place among
    those of b, and A3."""

    def __init__(self, buffer):
        x = mapped(buffer)
        ef = lambda i: EliasFano(*x[i : i + 3])
        self.words, self.b2, self.a2, self.seen, self.b3, self.a3 = x[:6]
        self.heads, self.starts, self.next, self.contexts, self.base, self.last = (ef(i) for i in range(6, 24, 3))

    @classmethod
    def build(cls, words: np.ndarray, tri, bi, deal: Deal) -> bytes:
        """words: sorted hashes; tri = (b, a, c, n) and bi = (b, c, n) of dealt out words, in their codes, sorted, distinct, n > 0."""
        b, a, c, n = tri
        k = np.int64(max(len(words), 1))
        hot = deal.hot(words)
        # level of successors: those below contexts, and those that this shard answers for words that are dealt out
        own = ~hot[b] if len(b) else np.zeros(0, bool)
        keys = np.concatenate((b * k + c, bi[0] * k + bi[1]))
        count = np.concatenate((np.where(own, n, 0), bi[2]))
        two, at = np.unique(keys, return_inverse=True)
        n2 = np.bincount(at, weights=count, minlength=len(two)).astype(np.int64)
        b2 = two // k
        starts = grouped(b2)
        heads = b2[starts]
        total, successors = _contexts(starts, n2)
        for i in np.flatnonzero(hot[heads]) if len(heads) else ():
            total[i], successors[i] = deal.words[int(words[heads[i]])]
        a2, back2 = _shares(n2, starts, total, successors)
        a2 = np.where(n2 > 0, a2, ABSENT).astype(np.uint16)
        # contexts and what follows them
        ctx = grouped(b, a)
        total3, successors3 = _contexts(ctx, n)
        if deal.pairs:
            h = deal.mixed(words[b[ctx]], words[a[ctx]]) if len(ctx) else np.zeros(0, np.uint64)
            for i in np.flatnonzero(np.isin(h, deal.pair_keys)):
                total3[i], successors3[i] = deal.pairs[int(words[b[ctx[i]]]), int(words[a[ctx[i]]])]
        a3, back3 = _shares(n, ctx, total3, successors3)
        of = np.searchsorted(heads, b[ctx]) if len(ctx) else np.zeros(0, np.int64)
        width = np.diff(np.concatenate((starts, [len(two)])))
        base = np.concatenate(([0], np.cumsum(width[of])))
        size = np.diff(np.concatenate((ctx, [len(n)])))
        place = np.searchsorted(two, b * k + c) - np.repeat(starts[of], size) if len(b) else np.zeros(0, np.int64)
        last = np.repeat(base[:-1], size) + place
        head = np.arange(len(heads))
        levels = [heads, np.concatenate((starts, [len(two)])), np.repeat(head, width) * k + two % k, b[ctx] * k + a[ctx], base, last]
        return packed([words, back2, a2, np.where(hot[heads], 0, total) if len(heads) else total, back3, a3, *[y for x in levels for y in encode(x)]])

    def answers(self, b, a, c):
        """Codes (A3, B3, A2, B2) of trigrams in codes of `words` (-1: not a word of the trie), quickest where equal b and (b, a) follow each other: the level of b gives where its successors start, c's place there goes on to the context's numbers."""
        none = np.full(len(b), ABSENT, np.uint16)
        a3, b3, a2, b2 = none, np.zeros(len(b), np.uint16), none.copy(), np.zeros(len(b), np.uint16)
        k = np.int64(max(len(self.words), 1))

        def along(starts, *values):
            return [np.repeat(v, np.diff(np.concatenate((starts, [len(b)])))) for v in values]

        runs = grouped(b)  # each b is looked up once a run
        head = np.where(b[runs] >= 0, self.heads.find(np.maximum(b[runs], 0)), -1)
        begin = np.zeros(len(runs), np.int64)
        begin[head >= 0] = self.starts[head[head >= 0]].astype(np.int64)
        i, begin = along(runs, head, begin)
        ok = i >= 0
        b2[ok] = self.b2[i[ok]]
        some = np.flatnonzero(ok & (c >= 0))
        at = self.next.find(i[some] * k + c[some])
        some, at = some[at >= 0], at[at >= 0]
        a2[some] = self.a2[at]
        place = np.full(len(b), -1)
        place[some] = at - begin[some]
        runs = grouped(b, a)  # and each context once
        node = np.where((b[runs] >= 0) & (a[runs] >= 0), self.contexts.find(np.maximum(b[runs], 0) * k + np.maximum(a[runs], 0)), -1)
        base = np.zeros(len(runs), np.int64)
        base[node >= 0] = self.base[node[node >= 0]].astype(np.int64)
        node, base = along(runs, node, base)
        ok = node >= 0
        b3[ok] = self.b3[node[ok]]
        some = np.flatnonzero(ok & (place >= 0))
        at = self.last.find(base[some] + place[some])
        a3[some[at >= 0]] = self.a3[at[at >= 0]]
        return a3, b3, a2, b2

    def occurrences(self, b):
        """Training occurrences of words (0 where they are dealt out or unknown)."""
        runs = grouped(b)
        i = self.heads.find(np.maximum(b[runs], 0))
        n = np.where((i >= 0) & (b[runs] >= 0), self.seen[np.maximum(i, 0)] if len(self.seen) else 0, 0)
        return np.repeat(n, np.diff(np.concatenate((runs, [len(b)]))))


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct values of some arrays, sorted."""
    x = np.sort(np.concatenate(parts))
    return x[grouped(x)]


def _merged(key: np.ndarray, n: np.ndarray):
    """Sorted distinct keys with their counts added up, and the index of each key given."""
    uniq, at = np.unique(key, return_inverse=True)
    return uniq, np.bincount(at, weights=n, minlength=len(uniq)).astype(np.int64), at.astype(np.int32)


def _answered(deal):
    """A shard's requests -> its answers, one row a chunk: n of each b, and the codes of its trigrams and bigrams."""
    schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("blob", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        words = distinct([asked(x.as_py())[0] for x in table.column("blob")])
        k, pairs = len(words), np.zeros(0, np.int64)
        if k**3 >= 1 << 63:  # contexts are numbered then, so that a trigram fits 63 bits
            for x in table.column("blob"):
                w, (b, a, *_), _ = asked(x.as_py())
                to = np.searchsorted(words, w)
                pairs = distinct([pairs, to[b] * k + to[a]])
        keys, n3, keys2, n2 = [], [], [], []
        for x in table.column("blob"):
            w, (b, a, c, n), (d, e, m) = asked(x.as_py())
            to = np.searchsorted(words, w)
            pair = to[b] * k + to[a]
            keys.append((pair if not pairs.size else np.searchsorted(pairs, pair)) * k + to[c])
            n3.append(n.astype(np.int32))
            keys2.append(to[d] * k + to[e])
            n2.append(m.astype(np.int32))
        sizes = [(len(x), len(y)) for x, y in zip(keys, keys2, strict=True)]
        tri, n3, at3 = _merged(np.concatenate(keys), np.concatenate(n3))
        bi, n2, at2 = _merged(np.concatenate(keys2), np.concatenate(n2))
        del keys, keys2
        k = np.int64(k)

        def spelled(key):
            pair, c = key // k, (key % k).astype(np.int32)
            pair = pairs[pair] if pairs.size else pair
            return (pair // k).astype(np.int32), (pair % k).astype(np.int32), c

        d, e = bi // k, bi % k
        known, has = n3 > 0, n2 > 0
        trie = Trie(Trie.build(words, (*spelled(tri[known]), n3[known]), (d[has], e[has], n2[has]), deal.value))
        del known, n3
        hot = deal.value.hot(words)
        codes, seen = np.zeros((4, len(tri)), np.uint16), np.zeros(len(tri), np.int64)
        for lo in range(0, len(tri), LOOKUPS):
            at = slice(lo, lo + LOOKUPS)
            b, a, c = spelled(tri[at])
            codes[:, at] = trie.answers(b, a, c)
            codes[2, at][hot[b]], codes[3, at][hot[b]] = ABSENT, 0
            seen[at] = trie.occurrences(b)
        _, _, e2, f2 = trie.answers(d, np.full(len(d), -1), e)
        out, i, j = [], 0, 0
        for m3, m2 in sizes:
            at, q = at3[i : i + m3], at2[j : j + m2]
            b, a, _ = spelled(tri[at])
            first, ctx = grouped(b), grouped(b, a)  # one count and B2 a word b of the request, one B3 a context
            out.append(squeezed([seen[at[first]], codes[0][at], codes[1][at[ctx]], codes[2][at], codes[3][at[first]], e2[q], f2[q]]))
            i, j = i + m3, j + m2
        return pa.Table.from_arrays([table.column("chunk"), table.column("shard"), pa.array(out, pa.binary())], schema=schema)

    return run, "chunk long, shard long, blob binary"


def _summed(deal, total: int, distinct: int, train_docs: int):
    """A chunk and its answers -> rows of its texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ch = Chunk(left.column("blob")[0].as_py())
        b, a, c, n, inverse = ch.trigrams(places=True)
        per, (b2, _, _, at, hot) = parts(ch, deal.value, b, a, c, n)
        blobs = dict(zip(right.column("shard").to_pylist(), right.column("blob"), strict=True))
        codes = np.zeros((4, len(b)), np.uint16)
        two = np.zeros((2, len(b2)), np.uint16)
        seen = np.zeros(len(ch.words), np.int64)
        for s, i, j in per:
            m, a3, b3, a2, f2, *x = loose(blobs[s].as_py())
            first, ctx = grouped(b[i]), grouped(b[i], a[i])
            along = lambda v, at: np.repeat(v, np.diff(np.concatenate((at, [len(i)]))))  # noqa: E731, B023
            seen[b[i[first]]] = m
            codes[:, i] = a3, along(b3, ctx), a2, along(f2, first)
            two[:, j] = x
        codes[2:, hot] = two[:, at]
        dealt = np.flatnonzero(deal.value.hot(ch.words))
        seen[dealt] = [deal.value.words[int(h)][0] for h in ch.words[dealt]]
        seen[BEGIN], seen[END] = 0, train_docs
        p1 = (seen + PRIOR) / (total + PRIOR * (distinct + 1))
        of = decoding()
        p = of[codes[0]] + of[codes[1]] * (of[codes[2]] + of[codes[3]] * p1[c])
        sums = lambda x: np.add.reduceat(x, ch.first) if len(ch.first) else np.zeros(0)
        ids = pa.array(ch.ids, mask=ch.none.astype(bool))
        rows = [ids, pa.array(ch.out == 1), pa.array(ch.n + 1), pa.array(sums((seen[ch.c] > 0).astype(np.int64))), pa.array(np.full(len(ch.n), total)), pa.array(sums(np.log10(p1)[ch.c])), pa.array(sums(np.log10(p)[inverse]))]
        return pa.Table.from_arrays(rows, schema=schema)

    return run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# ---- words and pairs that are dealt out


def _share(limit: int, chunk: int, tokens: int) -> int:
    """Least count in some chunk of what reaches `limit` in all tokens: its proportional share, rounded up."""
    return -(-limit * chunk // max(tokens, 1))


def _vocabulary(limit: int, tokens: int):
    """Rows (h, known, often) of a chunk's distinct words: does it stand in training texts, and does it reach its share of `limit`; h is the begin mark's for its contexts."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                ch = Chunk(blob.as_py())
                known = np.bincount(ch.b[ch.train], minlength=len(ch.words)) > 0
                often = np.bincount(ch.b, minlength=len(ch.words)) >= _share(limit, len(ch.b), tokens)
                some = known | often
                yield pa.RecordBatch.from_arrays([pa.array(ch.words[some].view(np.int64)), pa.array(known[some]), pa.array(often[some])], names=["h", "known", "often"])

    return run, "h long, known boolean, often boolean"


def _followed(keys: np.ndarray, limit: int, tokens: int, pairs: np.ndarray | None = None):
    """Rows (b, a, c, n, every) of some words b, n and every counting training and all occurrences: without `pairs` the words' own (a and c null), their distinct training successors (a null, no counts), and the contexts
    (b, a) that reach their share of `limit` in the chunk (c null, no counts); with them the trigrams of these contexts."""
    schema = pa.schema([(x, pa.int64()) for x in ("b", "a", "c", "n", "every")])

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                ch = Chunk(blob.as_py())
                k, h = len(ch.words), lambda x: pa.array(ch.words[x].view(np.int64))  # noqa: B023
                none = lambda x: pa.nulls(len(x), pa.int64())
                keep = np.isin(ch.words, keys)[ch.b]
                if pairs is not None:
                    keep[keep] = np.isin(Deal.mixed(ch.words[ch.b[keep]], ch.words[ch.a[keep]]), pairs)
                    for a in np.unique(ch.a[keep]):
                        here = keep & (ch.a == a)
                        two, at = np.unique(ch.b[here].astype(np.int64) * k + ch.c[here], return_inverse=True)
                        n, every = np.bincount(at[ch.train[here]], minlength=len(two)), np.bincount(at, minlength=len(two))
                        yield pa.RecordBatch.from_arrays([h(two // k), h(np.full(len(two), a)), h(two % k), pa.array(n), pa.array(every)], schema=schema)
                    continue
                n, every = np.bincount(ch.b[keep & ch.train], minlength=k), np.bincount(ch.b[keep], minlength=k)
                b = np.flatnonzero(every)
                yield pa.RecordBatch.from_arrays([h(b), none(b), none(b), pa.array(n[b]), pa.array(every[b])], schema=schema)
                known = keep & ch.train
                two = np.unique(ch.b[known].astype(np.int64) * k + ch.c[known])
                yield pa.RecordBatch.from_arrays([h(two // k), none(two), h(two % k), none(two), none(two)], schema=schema)
                two, m = np.unique(ch.b[keep].astype(np.int64) * k + ch.a[keep], return_counts=True)
                two = two[m >= _share(limit, len(ch.b), tokens)]
                yield pa.RecordBatch.from_arrays([h(two // k), h(two % k), none(two), none(two), none(two)], schema=schema)

    return run, "b long, a long, c long, n long, every long"


def _unsigned(x: int) -> int:
    return x & 0xFFFFFFFFFFFFFFFF


def dealt(chunks: DataFrame, shards: int, tokens: int) -> tuple[Deal, int]:
    """(the deal, distinct training words); words and pairs with more than 1 / (2 shards) of all tokens, so at most two a shard each, are dealt out.  Such a word or pair has its share of that in some chunk, so only
    those that do (at most 2 shards a chunk) are counted over all chunks."""
    limit = max(tokens // (2 * shards), 1) if shards > 1 else tokens + 1
    words = chunks.select("blob").mapInArrow(*_vocabulary(limit, tokens)).groupBy("h").agg(F.bool_or("known").alias("known"), F.bool_or("often").alias("often"))
    row = words.agg(F.count_if((F.col("h") != BEGIN) & F.col("known")).alias("distinct"), F.collect_list(F.when(F.col("often"), F.col("h"))).alias("often")).head()
    if not row.often:
        return Deal(shards, {}), row.distinct
    keys = np.array(sorted(_unsigned(h) for h in row.often), np.uint64)
    found = written(chunks.select("blob").mapInArrow(*_followed(keys, limit, tokens)).groupBy("b", "a", "c").agg(F.sum("n").alias("n"), F.sum("every").alias("every")))
    hot = {_unsigned(r.b): r.n for r in found.where((F.col("a").isNull() & F.col("c").isNull()) & (F.col("every") >= limit)).collect()}
    if not hot:
        return Deal(shards, {}), row.distinct
    follow = {_unsigned(r.b): r["count"] for r in found.where("c is not null").groupBy("b").count().collect()}  # a row a word
    hot = {h: (n, follow.get(h, 0)) for h, n in hot.items()}
    pairs = {(_unsigned(r.b), _unsigned(r.a)): (0, 0) for r in found.where("a is not null").collect() if _unsigned(r.b) in hot}
    if not pairs:
        return Deal(shards, hot), row.distinct
    probe = Deal(shards, hot, pairs)
    deeper = chunks.select("blob").mapInArrow(*_followed(probe.keys, limit, tokens, probe.pair_keys)).groupBy("b", "a", "c").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))
    deeper = deeper.groupBy("b", "a").agg(F.count_if(F.col("n") > 0).alias("k"), F.sum("n").alias("n"), F.sum("every").alias("every")).where(F.col("every") >= limit)
    return Deal(shards, hot, {(_unsigned(r.b), _unsigned(r.a)): (r.n, r.k) for r in deeper.collect()}), row.distinct


def score_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row a document."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_fold("doc_id", HELD_OUT) == 0).alias("held_out"))
    chunks = written(rows.mapInArrow(_chunks, "chunk long, tokens long, docs long, train_docs long, train_words long, blob binary"), "none")
    size = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("train_docs"), F.lit(0)).alias("train"), F.coalesce(F.sum("train_words"), F.lit(0)).alias("words")).head()
    shards = max(1, -(-size.tokens // SHARD_TOKENS))
    deal, distinct = dealt(chunks, shards, size.tokens)
    sent = sc.broadcast(deal)  # at most four entries a shard
    requests = chunks.select("chunk", "blob").mapInArrow(*_asked(sent))
    answers = requests.groupBy("shard").applyInArrow(*_answered(sent))
    final = _summed(sent, size.words + size.train, distinct + (size.train > 0), size.train)
    return chunks.select("chunk", "blob").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(*final)

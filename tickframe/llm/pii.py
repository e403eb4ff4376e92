"""Personal data by weak supervision (operator 10).

Candidate spans come from formats (e-mail, IP, card, phone; further: long strings with digits, long digit groups, a gazetteer first name before a capitalised
word).  Four labelers vote on each (1 personal, 0 not, 2 abstains): format, gazetteer, context words before the span, shape.  Counts of the vote patterns of
all candidates but those of the base kinds go through expectation-maximisation (two classes, votes independent given the class), which estimates each labeler's reliability and the share of
personal spans; the posterior of each pattern then is the soft label for a logistic span classifier on surface features.  Spans that the
format labelers of the four base kinds define stay whatever the classifier says; it adds those of the other kinds with a score of THRESHOLD or more.

Only patterns with their counts (bounded by the finite feature sets) come to the driver; all documents count.  Null and empty texts have no spans; offsets
are code points, end exclusive; spans that begin together come in the order of KINDS; repeated rows get equal results; whole texts are searched however
long, in time proportional to their length; an empty table gives no rows; columns other than doc_id and text are ignored by `spans` and kept by `redact`.
"""
from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import kernels as K

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "number", "name")
THRESHOLD = 0.5
CONTEXT_CHARS = 32

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: A match always begins a run of digits (it ends with a whole run), so the look-behind changes no match and keeps the search linear.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
DIGITS = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
STRING = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
HEX = re.compile(r"[0-9a-fA-F]+\Z")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}\Z")

#: Frequent first names, openings of issued keys, and context words for and against personal data.
NAMES = set("James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kevin Brian Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Michelle Laura Anna Emma Olivia Sophie Julia Peter Hans Klaus Jürgen Wolfgang Andreas Stefan Markus Sabine Ursula Monika Petra Heike Katrin Pierre Jean Michel Philippe Nicolas François Marie Nathalie Isabelle Sylvie Hélène José Antonio Manuel Francisco Carlos Miguel María Carmen Ana Pilar Lucía Javier Giovanni Marco Giulia Francesca João Luís Rui Inês Jan Piotr Katarzyna Agnieszka Ivan Dmitri Sergei Olga Natalia Ahmed Mohammed Muhammad Fatima Aisha Omar Hassan Ali Yusuf Mehmet Ayşe Emre Rahul Priya Amit Sunita Arjun Deepak Wei Ming Li Yuki Hiroshi Kenji Sakura Minh Linh Kwame Amara Chidi Ngozi Sven Lars Ingrid Björn Mikko Nikos Eleni".split())
#: A name: listed first names (each may go on with a hyphen), then a capitalised word with lower-case letters, in any alphabet with capitals; letters may be
#: followed by combining marks.  It begins with the list, so that the search skips to its initials; `_names` checks the border before it.
_UPPER = "[" + "".join(c for c in map(chr, range(0xD800)) if c.isupper() or c.istitle()) + "]"
_LOWER = "[" + "".join(c for c in map(chr, range(0xD800)) if c.islower()) + "]"
_MARK = "[\u0300-\u036f]*"
_CAPITALISED = f"{_UPPER}{_MARK}(?:['’]{_UPPER}{_MARK})?{_LOWER}(?:[^\\W\\d_]|[\u0300-\u036f])*"
_FIRST = "(?:" + "|".join(sorted(NAMES | {unicodedata.normalize("NFD", x) for x in NAMES})) + ")"
_GIVEN = f"{_FIRST}(?:-{_CAPITALISED})*"
NAME = re.compile(f"{_GIVEN}(?: {_GIVEN})* {_CAPITALISED}(?:-{_CAPITALISED})*")
KEY_STARTS = ("sk-", "pk-", "ghp_", "gho_", "xox", "AKIA", "AIza", "eyJ")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "60", "65", "35", "62")
FOR = re.compile(r"token|secret|passw|api.?key|\bkey\b|auth|bearer|credential|phone|\btel\b|mobile|\bcall\b|fax|ssn|social|iban|account|konto|cuenta|compte|card|visa|contact|name|mr\b|mrs\b|herr|frau|señor|madame|born|mail", re.I)
AGAINST = re.compile(r"version|\bpage\b|isbn|issn|doi|figure|table|chapter|order|build|commit|sha|md5|checksum|\bid\b|http|hash|license", re.I)


def luhn(d: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(d)):
        n = ord(c) - 48
        s += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return s % 10 == 0


def _names(t: str):
    """Leftmost non-overlapping names that begin at the border of a word."""
    m = NAME.search(t)
    while m:
        before = t[m.start() - 1 : m.start()]
        free = not (before.isalpha() or "\u0300" <= before <= "\u036f")
        if free:
            yield m.span()
        m = NAME.search(t, m.end() if free else m.start() + 1)


def _octet(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) <= 3 and int(x or 0) <= 255


def base_spans(t: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind; matches that fail their test are dropped."""
    out = []
    end, at = 0, t.find("@")
    while at >= 0:
        begin = at
        while begin > end and (t[begin - 1].isascii() and (t[begin - 1].isalnum() or t[begin - 1] in "._%+-")):
            begin -= 1
        if begin < at and (m := DOMAIN.match(t, at + 1)):
            out.append((begin, m.end(), "email"))
            end = m.end()
            at = t.find("@", end)
        else:
            at = t.find("@", at + 1)
    out += [(*m.span(), "ip") for m in IP.finditer(t) if all(map(_octet, m.group().split(".")))]
    for m in DIGITS.finditer(t):
        d = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def more_candidates(t: str, taken) -> list[tuple[int, int, str]]:
    """Spans of the other kinds that overlap no base span."""
    found = [(*m.span(), "secret") for m in STRING.finditer(t) if any(c.isdigit() for c in m.group()) and any(c.isalpha() for c in m.group())]
    for m in DIGITS.finditer(t):
        if 7 <= sum(c.isdigit() for c in m.group()) <= 24:
            found.append((*m.span(), "number"))
    found += [(*x, "name") for x in _names(t)]
    out: list = []
    at, end = 0, -1  # spans taken from here on, and where those before and the accepted ones end
    taken = sorted(taken)
    for x in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]))):
        while at < len(taken) and taken[at][0] <= x[0]:
            end = max(end, taken[at][1])
            at += 1
        if x[0] >= end and (at == len(taken) or x[1] <= taken[at][0]):
            out.append(x)
            end = x[1]
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def votes(t: str, a: int, b: int, kind: str) -> tuple[int, int, int, int]:
    """Format, gazetteer, context, shape: 1 personal, 0 not, 2 abstains."""
    s = t[a:b]
    digits = "".join(c for c in s if c.isdigit())
    before = t[max(0, a - CONTEXT_CHARS) : a]
    context = 1 if FOR.search(before) else 0 if AGAINST.search(before) else 2
    if kind in BASE:
        return 1, 1 if kind == "card" and digits.startswith(ISSUERS) or kind in ("email", "ip") else 2, context, 1
    if kind == "secret":
        rx = 1 if HEX.match(s) and len(s) in (32, 40, 64) or len(s) >= 24 else 0
        return rx, 1 if s.startswith(KEY_STARTS) else 2, context, 1 if entropy(s) >= 3 and len(digits) >= 4 else 0
    if kind == "number":
        rx = 1 if SSN.match(s) else 0
        return rx, 1 if len(digits) in (15, 16) and digits.startswith(ISSUERS) else 2, context, 0 if len(set(digits)) < 4 or len(digits) < 9 else 2
    return 2, 1, context, 2


def features(t: str, a: int, b: int, kind: str) -> tuple[int, ...]:
    """Surface features of a span, each a small integer."""
    s = t[a:b]
    share = sum(c.isdigit() for c in s) / len(s)
    before = t[max(0, a - CONTEXT_CHARS) : a]
    return KINDS.index(kind), min(len(s) // 8, 8), int(4 * share), min(int(entropy(s)), 5), int(before.rstrip()[-1:] in {'"', "'", "=", ":"}), int(bool(FOR.search(before))), int(bool(AGAINST.search(before)))


#: Bytes of text that a task holds as Python strings at once.
SLICE_BYTES = 1 << 20
#: Number of values of each feature.
SIZES = (len(KINDS), 9, 5, 6, 2, 2, 2)


def _likely(arr) -> tuple[np.ndarray, list]:
    """Texts that may hold any candidate: with a digit, an @, or a listed first name before a space or hyphen, wherever it stands."""
    buf, offs = K.flat(arr)
    some = K.per_text(((buf >= 48) & (buf <= 57)) | (buf == 64), offs) > 0
    some |= pc.fill_null(pc.match_substring_regex(arr, _FIRST + "[ -]"), False).to_numpy(zero_copy_only=False)
    return some, arr.to_pylist()


def _patterns(batches):
    schema = pa.schema([("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32())), ("n", pa.int64())])
    seen: Counter = Counter()
    for b in K.slices(batches, limit=SLICE_BYTES):
        some, texts = _likely(b.column("text"))
        for i in np.flatnonzero(some).tolist():
            t = texts[i]
            base = base_spans(t)
            for x in [*base, *more_candidates(t, base)]:
                seen[votes(t, *x), features(t, *x)] += 1
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([list(v) for v, _ in seen], schema[0].type), pa.array([list(f) for _, f in seen], schema[1].type), pa.array(list(seen.values()))], schema=schema)


def em(patterns: np.ndarray, n: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each vote pattern, P(vote | class) per labeler, and the share of personal spans."""
    p = np.empty((patterns.shape[1], 2, 3))
    p[:, 1], p[:, 0] = (0.1, 0.6, 0.3), (0.6, 0.1, 0.3)  # class 1: votes 0, 1, abstain
    share = 0.5
    for _ in range(steps):
        like = np.ones((len(n), 2)) * (1 - share, share)
        for j in range(patterns.shape[1]):
            like *= p[j][:, patterns[:, j]].T
        post = like[:, 1] / np.maximum(like.sum(1), 1e-300)
        share = float(np.clip((post * n).sum() / max(n.sum(), 1), 0.01, 0.99))
        for j in range(patterns.shape[1]):
            for c, q in ((1, post), (0, 1 - post)):
                k = np.bincount(patterns[:, j], weights=q * n, minlength=3) + (0.5 if c == 0 else 0.5)
                p[j, c] = k / k.sum()
    return post, p, share


def _hot(f: np.ndarray) -> np.ndarray:
    x = np.concatenate([np.eye(s)[f[:, j]] for j, s in enumerate(SIZES)], 1)
    return np.hstack((x, np.ones((len(f), 1))))


def train(docs: DataFrame) -> dict:
    """docs(text) -> weights of the span classifier, with the labelers' estimated reliabilities."""
    rows = docs.select("text").mapInArrow(_patterns, "votes array<int>, features array<int>, n long").groupBy("votes", "features").agg(F.sum("n").alias("n")).orderBy("votes", "features").collect()
    if not rows:
        return {"weights": None, "reliability": None, "share": 0.0}
    v, f, n = np.array([r.votes for r in rows]), np.array([r.features for r in rows]), np.array([r.n for r in rows], float)
    open_ = f[:, 0] >= len(BASE)  # the base kinds stay in any case and would drown the others
    if not open_.any():
        return {"weights": None, "reliability": None, "share": 0.0}
    v, f, n = v[open_], f[open_], n[open_]
    pattern, at = np.unique(v, axis=0, return_inverse=True)
    post, reliability, share = em(pattern, np.bincount(at.ravel(), weights=n))
    y, x, w = post[at.ravel()], _hot(f), np.zeros(sum(SIZES) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + w
        h = (x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return {"weights": w, "reliability": reliability, "share": share}


def all_spans(t: str, model: dict) -> tuple[list, list]:
    """Base spans, and all spans."""
    base = base_spans(t)
    if model["weights"] is None:
        return base, base
    more = more_candidates(t, base)
    if more:
        z = _hot(np.array([features(t, *x) for x in more])) @ model["weights"]
        more = [x for x, s in zip(more, z, strict=True) if s >= math.log(THRESHOLD / (1 - THRESHOLD))]
    return base, sorted([*base, *more], key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def spans(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text) -> doc_id, counts of the base kinds, digest of the base spans, all spans as text kind:start:end (comma-joined), how many the
    classifier added and how many there are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in K.slices(batches, limit=SLICE_BYTES):
            some, texts = _likely(b.column("text"))
            base, every, n = [""] * b.num_rows, [""] * b.num_rows, np.zeros((b.num_rows, 6), np.int64)
            for i in np.flatnonzero(some).tolist():
                x, y = all_spans(texts[i], sent.value)
                base[i], every[i] = joined(x), joined(y)
                for _, _, k in x:
                    n[i, BASE.index(k)] += 1
                n[i, 4:] = len(y) - len(x), len(y)
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(n[:, j]) for j in range(4)), pa.array(digest), pa.array(every), pa.array(n[:, 4]), pa.array(n[:, 5])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redact(docs: DataFrame, model: dict) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets (overlapping spans: one replacement, by the first kind)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        for b in K.slices(batches, limit=SLICE_BYTES):
            some, texts = _likely(b.column("text"))
            for i in np.flatnonzero(some).tolist():
                t, out, at = texts[i], [], 0
                for a, z, k in all_spans(t, sent.value)[1]:
                    if a >= at:
                        out += [t[at:a], f"<{k.upper()}>"]
                    at = max(at, z)
                texts[i] = "".join([*out, t[at:]]) if out else t
            yield b.set_column(place, b.schema.field(place), pa.array(texts, b.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)

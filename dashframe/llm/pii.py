"""Personal data by fixed patterns and a skip-chain CRF (operator 10).

Base spans are the valid matches of four patterns (:func:`base_spans`).  The
model labels every word of a text that has a digit or an at sign: such words
form a chain with learned features and transitions, and words that repeat or
resemble each other (same digits, same last seven digits, same address) share a
potential that favours equal labels, however far apart they stand.  Inference
alternates exact forward-backward on the chains with loopy messages over the
skip edges.  A word that no base span touches and whose label is an entity with
probability ``SURE`` or more is added; base spans always stay.

Each word is linked with the last one of its kind only, so the edges are as
many as the words.  Training: the base spans of at most ``SAMPLE`` documents
(with the smallest hash of their id, of at most ``SAMPLE_CHARS`` characters)
label their words; the driver holds only these.

Defined cases: NULL text is the empty text, which has no span; repeated rows
give repeated rows; offsets are code points, ends exclusive; no other column is
read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dashframe.llm.common import lowest, slices
from dashframe.llm.crf import forward_backward, train

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 1500
SAMPLE_CHARS = 20_000
FEATURES = 1 << 14
ROUNDS = 6
SURE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match starts at the first digit of its run and ends at the last of its own,
# so the look-behind only spares the later starts within a run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of the address pattern: what may stand before an at
    sign has none itself, so each at sign is tried once, with all of the run
    before it that no earlier match took."""
    end = 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            end = m.end()
            yield a, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


class Words:
    """The words of a text that the model labels."""

    def __init__(self, text: str):
        every = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        self.spans, self.features, self.keys = [], [], []
        for i, (a, b) in enumerate(every):
            w = text[a:b]
            if "@" not in w and not _DIGIT.search(w):
                continue
            self.spans.append((a, b))
            before = text[slice(*every[i - 1])][-24:].lower() if i else "^"
            after = text[slice(*every[i + 1])][:24].lower() if i + 1 < len(every) else "$"
            self.features.append(_features(w, before, after))
            self.keys.append(_keys(w))


def _shape(word: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "9", word[:48])))


def _features(word: str, before: str, after: str) -> np.ndarray:
    digits = _NOT_DIGIT.sub("", word)
    lengths = re.sub(r"[0-9]+", lambda m: str(min(9, len(m[0]))), word[:48])
    parts = word.strip(".,;:()").split(".")
    names = ["bias", f"s{_shape(word)}", f"l{_shape(lengths) if len(lengths) < 24 else ''}{lengths[:24]}",
             f"n{min(len(digits), 20)}", f"@{'@' in word}", f"+{word[:1] == '+'}", f"b{before}",
             f"a{after}", f"bs{_shape(before)}", f"as{_shape(after)}",
             f"luhn{12 <= len(digits) <= 19 and luhn(digits)}",
             f"ip{len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts)}"]
    return np.array([xxhash.xxh32_intdigest(n) % FEATURES for n in names], np.int64)


def _keys(word: str) -> list[str]:
    """Words with a key in common are linked."""
    digits = _NOT_DIGIT.sub("", word)
    keys = []
    if "@" in word:
        keys.append("@" + word.strip(".,;:()<>").lower())
    if len(digits) >= 4:
        keys.append("=" + digits)
    if len(digits) >= 7:
        keys.append("~" + digits[-7:])
    return keys


def skip_edges(keys: list[list[str]]) -> list[tuple[int, int]]:
    last: dict[str, int] = {}
    edges = set()
    for i, own in enumerate(keys):
        for k in own:
            if k in last:
                edges.add((last[k], i))
            last[k] = i
    return sorted(edges)


def weak_labels(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """0, or 1 + the kind of the first base span that touches a word."""
    out, open_spans, j = [], [], 0
    for a, b in spans:
        while j < len(base) and base[j][0] < b:
            open_spans.append(base[j])
            j += 1
        open_spans = [x for x in open_spans if x[2] > a]
        out.append(1 + open_spans[0][1] if open_spans else 0)
    return out


class Model:
    def __init__(self, weight, transition, agree):
        self.weight, self.transition, self.agree = weight, transition, agree

    def marginals(self, docs: list[Words]) -> np.ndarray:
        """Label probabilities of the words of all documents, one after the
        other, by loopy message passing."""
        lengths = np.array([len(d.spans) for d in docs], np.int64)
        flat = [f for d in docs for f in d.features]
        if not flat:
            return np.empty((0, len(KINDS) + 1))
        emission = self.weight[np.stack(flat)].sum(axis=1)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        edges = [(s + i, s + j) for d, s in zip(docs, starts) for i, j in skip_edges(d.keys)]
        marginal = forward_backward(emission, self.transition, lengths)
        if not edges or self.agree <= 0:
            return marginal
        one = np.array(edges, np.int64)
        source = np.concatenate([one[:, 0], one[:, 1]])
        target = np.concatenate([one[:, 1], one[:, 0]])
        back = np.concatenate([np.arange(len(one)) + len(one), np.arange(len(one))])
        labels = emission.shape[1]
        bond = np.exp(self.agree * np.eye(labels))
        message = np.full((len(source), labels), 1 / labels)
        for _ in range(ROUNDS):
            cavity = marginal[source] / np.maximum(message[back], 1e-12)
            fresh = cavity @ bond
            fresh /= fresh.sum(axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * fresh
            node = emission.copy()
            np.add.at(node, target, np.log(message))
            marginal = forward_backward(node, self.transition, lengths)
        return marginal


def fit(texts: list[str]) -> Model | None:
    docs = [Words(t) for t in texts]
    labels = [weak_labels(d.spans, base_spans(t)) for d, t in zip(docs, texts)]
    pairs = [(d, y) for d, y in zip(docs, labels) if d.spans]
    if not pairs:
        return None
    gold = np.array([k for _, y in pairs for k in y])
    lengths = np.array([len(y) for _, y in pairs])
    words = [f for d, _ in pairs for f in d.features]
    n = len(KINDS) + 1
    weight, transition = train(words, np.arange(len(words)), gold, lengths, FEATURES, n, decay=1e-4)
    same = [y[i] == y[j] for d, y in pairs for i, j in skip_edges(d.keys)]
    share = np.bincount(gold, minlength=n) / len(gold)
    chance = min(0.99, float((share ** 2).sum()))
    agree = (sum(same) + 1) / (len(same) + 2)
    bond = np.log(agree / (1 - agree)) - np.log(chance / (1 - chance))
    return Model(weight, transition, float(np.clip(bond, 0.0, 4.0)))


def added_spans(words: Words, marginal: np.ndarray, base: list[tuple[int, int, int]]):
    """Spans of the words that the model is sure of and no base span touches;
    neighbours of one kind make one span."""
    out: list[tuple[int, int, int]] = []
    touched = weak_labels(words.spans, base)
    for (a, b), p, t in zip(words.spans, marginal, touched):
        k = int(p[1:].argmax())
        if t or p[1 + k] < SURE:
            continue
        if out and out[-1][1] == k and a - out[-1][2] == 1:
            out[-1] = (out[-1][0], k, b)
        else:
            out.append((a, k, b))
    return out


def sample(docs: DataFrame, size: int = SAMPLE) -> list[str]:
    """At most ``size`` texts with something to label."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(
        F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS))
    draw = F.xxhash64("doc_id")
    return [r[0] for r in lowest(rows, draw, size).orderBy(draw, "doc_id", F.xxhash64("text"))
            .limit(size).select("text").collect()]


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, the number of base spans of each kind, ``base_sha256`` and
    ``spans`` (base and added ones, ``kind:start:end``) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [list(x) for x in base]
            if m is not None:
                rows = [i for i, t in enumerate(texts) if "@" in t or _DIGIT.search(t)]
                words = [Words(texts[i]) for i in rows]
                marginal = m.marginals(words)
                ends = np.cumsum([len(w.spans) for w in words])
                for i, w, end in zip(rows, words, ends):
                    p = marginal[end - len(w.spans):end]
                    every[i] = sorted(base[i] + added_spans(w, p, base[i]))
            counts = np.zeros((len(texts), len(KINDS)), np.int64)
            for i, spans in enumerate(base):
                for _, k, _ in spans:
                    counts[i, k] += 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")] + [pa.array(counts[:, k]) for k in range(len(KINDS))]
                + [pa.array([hashlib.sha256(_listed(x).encode()).hexdigest() for x in base], pa.string()),
                   pa.array([_listed(x) for x in every], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS)
                           + ", base_sha256 string, spans string")


def detect(docs: DataFrame) -> DataFrame:
    return find(docs, fit(sample(docs)))

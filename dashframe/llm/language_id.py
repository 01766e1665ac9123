"""Language identification of code-switched text by a linear-chain CRF
(operator 1).

Every word is labelled with a language.  Its features are affixes, character
n-grams and membership in learned lexicons, hashed; neighbouring labels share a
learned transition.  Forward-backward gives each word's label probabilities,
and a document's language is the one with the largest mean probability over
its words, which is the score.  A run of more than ``PIECE`` characters without a
space is cut into pieces of that length, each of which counts as a word, so that
every character is read.

Training: whole texts of at most ``PER_LABEL`` documents a language (those with
the smallest hash of their id, of at most ``SAMPLE_CHARS`` characters) give
word spans; spans of different documents are spliced into sequences, so that
the transitions learn to switch.  The sample is all that the driver holds.

Defined cases: NULL text and text without a letter are ``und`` with score 0; a
NULL id is not held out and not learned from; with nothing to learn from every
text is ``und``; repeated rows give repeated rows; no other column is read.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dashframe.llm.common import remainder, slices
from dashframe.llm.crf import forward_backward, train

PER_LABEL = 64
SAMPLE_CHARS = 20_000
SEQUENCES = 1500
SPAN = (4, 40)
FEATURES = 1 << 16
LEXICON_COUNT = 3
PIECE = 64
MEMO_WORDS = 400_000


def pieces(token: str) -> list[str]:
    return [token[i:i + PIECE] for i in range(0, len(token), PIECE)] or [token]


def bare(token: str) -> str:
    """Lower case, without what isn't a letter at either end."""
    a, b = 0, len(token)
    while a < b and not token[a].isalpha():
        a += 1
    while b > a and not token[b - 1].isalpha():
        b -= 1
    return token[a:b].lower()


def features(word: str, lexicons: dict[str, tuple[int, ...]], labels: int) -> np.ndarray:
    """Feature ids of a bare word: one per lexicon that holds it, then hashes of
    its affixes and n-grams."""
    padded = f"^{word}$"
    names = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
    names += [padded[i:i + n] for n in (2, 3) for i in range(len(padded) - n + 1)]
    hashed = [labels + xxhash.xxh32_intdigest(n) % (FEATURES - labels) for n in names]
    return np.array(list(lexicons.get(word, ())) + hashed, np.int64)


def _keys(codes: list[np.ndarray]) -> np.ndarray:
    """One number for up to three code points, each raised by one (0: none)."""
    return sum(c << np.uint64(21 * i) for i, c in enumerate(codes))


class Model:
    def __init__(self, labels: list[str], lexicons, weight, transition):
        self.labels, self.lexicons = labels, lexicons
        self.weight, self.transition = weight, transition
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}      # rows of the table by token; 0: no letter
        self.table = np.zeros((1, len(self.labels)))
        self.ids: dict[str, dict[int, int]] = {kind: {} for kind in ("p", "s", "")}

    def _hashed(self, kind: str, keys: np.ndarray) -> np.ndarray:
        """Feature ids of affixes or n-grams; only those not met before are hashed."""
        coded = pa.array(keys).dictionary_encode()
        known, ids = self.ids[kind], []
        for key in coded.dictionary.to_pylist():
            found = known.get(key)
            if found is None:
                codes = (key & 0x1FFFFF, key >> 21 & 0x1FFFFF, key >> 42)
                name = kind + "".join(chr(c - 1) for c in codes if c)
                found = known[key] = len(self.labels) + xxhash.xxh32_intdigest(name) % (FEATURES - len(self.labels))
            ids.append(found)
        return np.array(ids, np.int64)[coded.indices.to_numpy()]

    def _scores(self, words: list[str]) -> np.ndarray:
        """Label scores of distinct bare words: the weights of their features,
        summed in the features' order."""
        out = np.zeros((len(words), len(self.labels)))
        for i, w in enumerate(words):
            if w in self.lexicons:
                out[i] = self.weight[features(w, self.lexicons, len(self.labels))].sum(axis=0)
        rest = np.array([i for i, w in enumerate(words) if w not in self.lexicons], np.int64)
        if not len(rest):
            return out
        chosen = [words[i] for i in rest]
        n = np.fromiter(map(len, chosen), np.int64, len(chosen))
        rest, chosen, n = (rest[o := np.argsort(-n, kind="stable")], [chosen[i] for i in o], n[o])   # long before short
        text = np.frombuffer("".join(f"^{w}$" for w in chosen).encode("utf-32-le"), np.uint32).astype(np.uint64) + 1
        first = np.concatenate([[0], np.cumsum(n + 2)[:-1]]) + 1
        total = np.zeros((len(chosen), len(self.labels)))
        for kind in ("p", "s"):
            for k in (1, 2, 3):
                size = np.minimum(n, k)
                start = first if kind == "p" else first + n - size
                codes = [np.where(i < size, text[np.minimum(start + i, len(text) - 1)], 0).astype(np.uint64)
                         for i in range(k)]
                total += self.weight[self._hashed(kind, _keys(codes))]
        for size in (2, 3):
            grams = self._hashed("", _keys([text[i:len(text) - size + 1 + i] for i in range(size)]))
            for at in range(int(n[0]) + 3 - size):
                m = int(np.searchsorted(-n, 2 - size - at, side="right"))    # words of more than at grams
                total[:m] += self.weight[grams[first[:m] - 1 + at]]
        out[rest] = total
        return out

    def emissions(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(label scores, which have a letter) of distinct tokens."""
        new = [t for t in tokens if t not in self.memo]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.forget()
            new = tokens
        words = [bare(t) for t in new]
        fresh = list(dict.fromkeys(w for w in words if w))
        row = {w: len(self.table) + i for i, w in enumerate(fresh)}
        self.table = np.concatenate([self.table, self._scores(fresh)])
        self.memo.update(zip(new, [row.get(w, 0) for w in words]))
        rows = np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens))
        return self.table[rows], rows > 0

    def label(self, texts: pa.Array):
        """(marginals by piece, which pieces are words, offsets by text)."""
        cut = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        offsets = cut.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        tokens = cut.flatten()
        if (pc.max(pc.utf8_length(tokens)).as_py() or 0) > PIECE:
            parts = [pieces(t) for t in tokens.to_pylist()]
            offsets = np.cumsum([0] + [len(p) for p in parts])[offsets]
            tokens = pa.array([x for p in parts for x in p], pa.string())
        coded = tokens.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        table, is_word = self.emissions(coded.dictionary.to_pylist())
        marginal = forward_backward(table[codes], self.transition, np.diff(offsets))
        return marginal, is_word[codes], offsets


def sample(docs: DataFrame, per_label: int = PER_LABEL) -> list[tuple[str, str]]:
    """(label, text) of the training sample: at most ``per_label`` a label."""
    rows = docs.where((remainder("doc_id", 5) != 0) & F.col("lang").isNotNull()
                      & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    rows = rows.select("lang", "text", F.row_number().over(order).alias("k")).where(
        F.col("k") <= per_label)
    return sorted((r[0], r[1]) for r in rows.select("lang", "text").collect())


def fit(rows: list[tuple[str, str]], seed: int = 1) -> Model | None:
    labels = sorted({lang for lang, _ in rows})
    texts = [(labels.index(lang), [w for t in text.split() for w in map(bare, pieces(t)) if w]) for lang, text in rows]
    texts = [(k, ws) for k, ws in texts if ws]
    if not texts:
        return None
    counts: dict[int, Counter] = defaultdict(Counter)
    for k, ws in texts:
        counts[k].update(ws)
    lexicons: dict[str, tuple[int, ...]] = {}
    for k in sorted(counts):
        for w, c in counts[k].items():
            if c >= LEXICON_COUNT:
                lexicons[w] = lexicons.get(w, ()) + (k,)
    rng = random.Random(seed)
    by_label: dict[int, list] = defaultdict(list)
    for k, ws in texts:
        by_label[k].append(ws)
    kinds = sorted(by_label)
    ids: dict[str, int] = {}
    tokens, gold, lengths = [], [], []
    for _ in range(SEQUENCES):
        size = 0
        for _ in range(rng.randint(1, 3)):
            k = rng.choice(kinds)
            ws = rng.choice(by_label[k])
            n = rng.randint(*SPAN)
            at = rng.randrange(max(1, len(ws) - n + 1))
            span = ws[at:at + n]
            tokens += [ids.setdefault(w, len(ids)) for w in span]
            gold += [k] * len(span)
            size += len(span)
        lengths.append(size)
    weight, transition = train([features(w, lexicons, len(labels)) for w in ids], np.array(tokens),
                               np.array(gold), np.array(lengths), FEATURES, len(labels))
    return Model(labels, lexicons, weight, transition)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_words, n_switches`` per row:
    words with a letter, and neighbours among them of different likeliest
    languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in slices(batches):
            n = b.num_rows
            pred, score = ["und"] * n, np.zeros(n)
            words, switches = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if m is not None and n:
                marginal, is_word, offsets = m.label(b.column("text"))
                owner = np.repeat(np.arange(n), np.diff(offsets))[is_word]
                marginal = marginal[is_word]
                words = np.bincount(owner, minlength=n)
                total = np.stack([np.bincount(owner, marginal[:, k], n)
                                  for k in range(len(m.labels))], axis=1)
                best = total.argmax(axis=1)
                mean = total.max(axis=1) / np.maximum(words, 1)
                pred = [m.labels[k] if c else "und" for k, c in zip(best, words)]
                score = np.clip(np.where(words > 0, mean, 0.0), 0.0, 1.0)
                each = marginal.argmax(axis=1)
                turn = np.flatnonzero((each[1:] != each[:-1]) & (owner[1:] == owner[:-1]))
                switches = np.bincount(owner[turn], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()),
                 pa.array(score), pa.array(words, pa.int64()), pa.array(switches, pa.int64())],
                names=["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, "
                                "n_words long, n_switches long")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, then label all."""
    return predict(docs, fit(sample(docs)))

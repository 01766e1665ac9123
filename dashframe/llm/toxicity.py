"""Toxicity by a naive-Bayes-scaled linear classifier (operator 3).

Features are the character n-grams (3 to 6, word edges marked) that a text has,
hashed; each is scaled by the log ratio of its smoothed frequencies in toxic
and other training texts, and a logistic regression is fitted on the scaled
features.

Training: at most ``SAMPLE`` documents of either label (those with the smallest
hash of their id), whole texts; the ``KEPT`` features with the most significant
log ratios, of ``LEAST`` standard errors or more, have a weight.  The sample's feature lists are all that the driver
holds.

Defined cases: NULL and empty texts have no feature and the score that belongs
to none; a NULL id is not held out and not learned from; documents labelled
both ways count as toxic; with one label or none to learn from every score is
that label's (0 without any); repeated rows give repeated rows; no other column
is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dashframe.llm.common import lowest, remainder, slices

LENGTHS = (3, 4, 5, 6)
SAMPLE = 3000
BITS = 18
KEPT = 3000
LEAST = 4.0     # standard errors of a log ratio that matters
STEPS = 300
THRESHOLD = 0.7
MEMO_WORDS = 400_000    # most of them have no feature that matters and share one array
_NONE = np.empty(0, np.int32)


def grams(token: str) -> np.ndarray:
    padded = f"<{token}>"
    mask = (1 << BITS) - 1
    return np.array([xxhash.xxh32_intdigest(padded[i:i + n]) & mask
                     for n in LENGTHS for i in range(len(padded) - n + 1)], np.int32)


class Grams:
    """n-gram ids of the texts of a batch, through their distinct words."""

    def __init__(self, keep: np.ndarray | None = None):
        self.keep = keep        # bool per feature: those that matter
        # Without a selection every array is its own, so fewer are kept.
        self.entries = MEMO_WORDS if keep is not None else MEMO_WORDS // 10
        self.memo: dict[str, np.ndarray] = {}

    def of(self, token: str) -> np.ndarray:
        g = self.memo.get(token)
        if g is None:
            g = grams(token)
            if self.keep is not None:
                g = g[self.keep[g]]
                g = g if len(g) else _NONE
            if len(self.memo) >= self.entries:
                self.memo.clear()
            if len(token) <= 64:
                self.memo[token] = g
        return g

    def sets(self, texts: pa.Array):
        """Sorted distinct ids of each text."""
        cut = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
        offsets = cut.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ids = [self.of(t) for t in coded.dictionary.to_pylist()]
        some = np.array([len(x) > 0 for x in ids], bool)
        for a, b in zip(offsets, offsets[1:]):
            used = np.unique(codes[a:b])
            used = used[some[used]] if len(used) else used
            yield np.unique(np.concatenate([ids[k] for k in used])) if len(used) else \
                np.empty(0, np.int32)


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> list[tuple[int, np.ndarray]]:
    """(label, feature ids) of the training sample."""
    known = labels.where((remainder("doc_id", 3) != 1) & F.col("toxic").isin(0, 1)) \
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = None
    for k in (0, 1):
        part = lowest(known.where(F.col("toxic") == k), F.xxhash64("id"), size) \
            .orderBy(F.xxhash64("id"), "id").limit(size)
        picked = part if picked is None else picked.unionAll(part)
    # At most 2 * size ids are broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(picked), "id").select("id", "toxic", "text")

    def run(batches):
        find = Grams()
        for b in slices(batches):
            ids = [s.astype(np.int32).tobytes() for s in find.sets(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("toxic"), pa.array(ids, pa.binary())],
                                             names=["id", "toxic", "ids"])

    found = rows.mapInArrow(run, "id long, toxic int, ids binary").collect()
    return [(r[1], np.frombuffer(r[2], np.int32)) for r in sorted(found, key=lambda r: (r[0], r[2]))]


def fit(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, float]:
    """(weight per feature, intercept)."""
    n = 1 << BITS
    y = np.array([k for k, _ in rows], float)
    if not len(y) or y.min() == y.max():
        return np.zeros(n), (4.0 if len(y) and y[0] else -30.0 if not len(y) else -4.0)
    df = [np.zeros(n), np.zeros(n)]
    for k, ids in rows:
        df[k][ids] += 1
    p, q = df[1] + 1, df[0] + 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    # The ratio in its standard errors tells the features that matter.
    strength = np.abs(np.log(p / (y.sum() + 2)) - np.log(q / (len(y) - y.sum() + 2))) / np.sqrt(1 / p + 1 / q)
    keep = np.zeros(n, bool)
    keep[np.argsort(-strength, kind="stable")[:KEPT]] = True
    keep &= (df[0] + df[1] > 1) & (strength > LEAST)
    lists = [ids[keep[ids]] for _, ids in rows]
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    x = ratio[flat]
    w, b = np.zeros(n), 0.0
    gw, gb = np.full(n, 1e-8), 1e-8
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(STEPS):
        z = np.bincount(owner, w[flat] * x, len(rows)) + b
        miss = (y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * share
        d = np.bincount(flat, miss[owner] * x, n) - 1e-5 * w
        db = miss.sum()
        gw += d * d
        gb += db * db
        w += 0.1 * d / np.sqrt(gw)
        b += 0.1 * db / np.sqrt(gb)
    return w * ratio, float(b)


def score(docs: DataFrame, weight: np.ndarray, intercept: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def run(batches):
        w = shared.value
        find = Grams(w != 0)
        for b in slices(batches, chars=8 << 20):
            z = np.array([intercept + w[s].sum() for s in find.sets(b.column("text"))])
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64())],
                                             names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double") \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, *fit(sample(docs, labels)))

import random
import re
import zlib
from collections import Counter
from math import isclose, log10

import numpy as np

from dashframe.llm import interpolated_lm as lm
from tests.llm.helpers import docs, odd_rows, prose, row


def tokens(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t) + [None]


def test_counts_and_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 3000)        # several chunks
    rng = random.Random(21)
    rows = odd_rows() + [row(100 + i, prose(rng, rng.randint(1, 120))) for i in range(80)]
    got = lm.scores(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    rem = {r[0]: None if r[0] is None else zlib.crc32(str(r[0]).encode()) % 10 for r in rows}
    train = [tokens(r[1]) for r in rows if rem[r[0]]]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in rows:
        t = tokens(text)
        base = sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert any(r.n_tokens == len(t) and r.n_known == sum(c[w] > 0 for w in t) and r.train_tokens == n
                   and isclose(r.base_score, base, rel_tol=1e-9) and r.held_out == (rem[i] == 0)
                   and r.score < 0 for r in by[i])


def test_scores_equal_the_formula(spark, monkeypatch):
    # Counts of words and pairs by dictionaries over the whole corpus, the
    # deleted estimates of every training token, and the stated mixture.
    monkeypatch.setattr(lm, "CHUNK", 2500)
    monkeypatch.setattr(lm, "RANGE_KEYS", 300)     # many ranges, few keys in each
    rng = random.Random(23)
    rows = [r for r in odd_rows() if r[0] != 8] + [row(100 + i, prose(rng, rng.randint(1, 90))) for i in range(60)]
    rows = [r for r in rows if r[0] is not None]
    got = {r.doc_id: r.score for r in lm.scores(docs(spark, rows)).collect()}
    texts = {r[0]: tokens(r[1]) for r in rows}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    c, pair = Counter(), Counter()
    for t in train:
        c.update(t)
        c["<start>"] += 1
        pair.update(zip(["<start>"] + t, t))
    n = sum(c.values()) - c["<start>"]
    v = len(c) - 1
    table = Counter()
    for t in train:
        for a, w in zip(["<start>"] + t, t):
            left = c[a] - 1
            table[(int(lm._bucket(np.array([left]))[0]),
                   int(lm._bins(np.array([(pair[a, w] - 1) / max(left, 1)]))[0]),
                   int(lm._bins(np.array([(c[w] - 1) / (n - 1)]))[0]))] += 1
    weights = lm.mixture(np.array([(*k, x) for k, x in table.items()]), v)
    for i, t in texts.items():
        want = 0.0
        for a, w in zip(["<start>"] + t, t):
            m = weights[int(lm._bucket(np.array([c[a]]))[0])]
            want += log10(m[0] * pair[a, w] / max(c[a], 1) + m[1] * c[w] / n + m[2] / (v + 1))
        assert isclose(got[i], want, rel_tol=1e-6), i


def test_requests_grow_with_keys(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 1500)
    rng = random.Random(24)
    made = []
    for n in (10, 20, 40):
        frame = docs(spark, [row(i, prose(rng, 250)) for i in range(n)]).coalesce(1).selectExpr(
            "doc_id", "true AS training", "false AS held_out", "text")
        chunks = spark.createDataFrame(lm._chunks(frame).toPandas(), lm._chunks(frame).schema)
        ranges = 500 * n
        keys = asked = 0
        for c in chunks.collect():
            words, _, _, pairs, _, _ = lm._unfold(c.asDict())
            keys += len(words) + len(pairs)
            asked += len(set(lm._part(words, ranges)) | set(lm._part(pairs, ranges)))
        requests = lm._requests(chunks, ranges).collect()
        assert len({(r.range, r.chunk) for r in requests}) == len(requests) == asked <= keys
        made.append(len(requests) / n)
    assert made[2] < 1.5 * made[0]


def test_the_mixture_is_a_distribution_and_beats_its_parts(spark):
    # Pairs repeat, so the two-word estimate must take most of the weight.
    rng = random.Random(22)
    nxt = {w: rng.sample("abcdefghij", 2) for w in "abcdefghij"}
    rows = []
    for i in range(120):
        w, out = rng.choice("abcdefghij"), []
        for _ in range(80):
            out.append(w)
            w = rng.choice(nxt[w])
        rows.append(row(i, " ".join(out)))
    held = [r for r in lm.scores(docs(spark, rows)).collect() if r.held_out]
    assert held and sum(r.score for r in held) > 0.5 * sum(r.base_score for r in held)


def test_weights_by_expectation_maximisation():
    # Tokens whose pair estimate is always better leave it nearly all weight.
    table = np.array([[5, lm._bins(np.array([0.5]))[0], lm._bins(np.array([0.001]))[0], 1000],
                      [2, -1000, lm._bins(np.array([0.01]))[0], 500]])
    w = lm.mixture(table, 1000)
    assert np.allclose(w.sum(axis=1), 1) and w[5][0] > 0.95 and w[2][1] > 0.8 and w[2][0] < 0.01


def test_keys_survive_squeezing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (lm.expand_keys(lm.squeeze_keys(keys)) == keys).all()


def test_no_rows(spark):
    assert lm.scores(docs(spark, [])).collect() == []
    only = lm.scores(docs(spark, [row(None, "no training here")])).collect()
    assert only[0].train_tokens == 0 and only[0].n_known == 0 and only[0].score == 0

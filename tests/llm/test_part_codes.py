"""Part codes against a plain loop over Python integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from dashframe.llm import part_codes
from dashframe.llm.common import join_by_key

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, n long, ids string"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in v], l) for i, v, l in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not order:
        return []
    dims = len(order[0][1])
    cuts = [p * dims // parts for p in range(parts + 1)]
    cut = lambda v: [v[a:b] for a, b in zip(cuts, cuts[1:])]
    books = [cut(v) for _, v, _ in order[:entries] if len(v) == dims]

    def nearest(v):
        out = []
        for p, x in enumerate(cut(v)):
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, e[p])), k) for k, e in enumerate(books)))
        return out

    alike = [v for _, v, _ in kept if len(v) == dims]
    for _ in range(rounds):
        got = defaultdict(list)
        for v in alike:
            for p, (_, k) in enumerate(nearest(v)):
                got[k, p].append(cut(v)[p])
        for (k, p), xs in got.items():
            books[k][p] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for p in range(parts) for e in books for x in e[p]).encode()).hexdigest()
    out, totals = [], {}
    for i, v, l in kept:
        if len(v) != dims:
            out.append((i, l, None, None))
            continue
        near = nearest(v)
        error = sum(d for d, _ in near)
        totals[l] = totals.get(l, 0) + error
        out.append((i, l, "".join("%02x" % k for _, k in near), error))
    return sorted(((i, c, e, totals.get(l), sha) for i, l, c, e in out), key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, l, "x", "y", 1, "z") for i, v, l in rows], SCHEMA)
    out = part_codes.compress(df, **kw)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out.collect()), key=repr)


def vectors(rng, n, dims, first=0):
    return [(first + i, [rng.gauss(0, 0.2) for _ in range(dims)], rng.choice([1, 1, 1, 2, 3, None]))
            for i in range(n)]


@pytest.mark.parametrize("dims,n", [(32, 300), (20, 90), (7, 80), (16, 5)])
def test_like_brute_force(spark, dims, n):
    rows = vectors(random.Random(dims), n, dims)
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = vectors(rng, 70, 16, first=10)
    rows += [(1, None, 1), (2, [None] * 16, 1), (3, [float("nan")] + [0.0] * 15, 2),
             (4, [float("inf")] * 16, 2), (5, [0.5] * 15, 7), (6, [], 8),
             (200, [0.25] * 16, 1), (200, [0.25] * 16, 1), (201, [0.25] * 16, 2),       # repeated rows
             (None, [0.125] * 16, 1), (300, [1e300, -1e300] * 8, 3), (301, [-0.001] * 16, None)]
    # the first kept vector has another length than most
    assert run(spark, rows) == brute(rows)
    rows = [r for r in rows if r[0] not in (5, 6)] + [(400, [0.5] * 15, 1), (401, [0.5], 9)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert [r for r in got if r[0] == 401] == [(401, None, None, None, got[0][4])]


def test_ties_take_the_lower_entry(spark):
    rows = [(i, [0.0] * 16, 1) for i in range(70)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[1] for r in got } == {"00" * 16}


def test_empty_and_all_left_out(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1), (2, [float("nan")], None)]) == []
    with pytest.raises(ValueError):
        run(spark, [], entries=300)


def test_chunks_and_partitions_do_not_matter(spark, monkeypatch):
    rows = vectors(random.Random(8), 200, 16)
    monkeypatch.setattr(part_codes, "CHUNK", 7)
    df = spark.createDataFrame([(i, v, l, "x", "y", 1, "z") for i, v, l in rows], SCHEMA).repartition(5)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)
                  for r in part_codes.compress(df).collect()), key=repr)
    assert got == brute(rows)


def test_tables_equal_direct_distances():
    rng = np.random.default_rng(0)
    books = rng.integers(-50, 50, (9, 10))
    x = rng.integers(-60, 60, (40, 10))
    coder = part_codes._Coder(books, 3)
    values, codes = zip(*(np.unique(x[:, d], return_inverse=True) for d in range(10)))
    entry, distance = coder.assign(values, np.array(codes), 40)
    for p, (a, b) in enumerate(zip(coder.cuts, coder.cuts[1:])):
        direct = ((x[:, None, a:b] - books[None, :, a:b]) ** 2).sum(axis=2)
        assert (direct.argmin(axis=1) == entry[:, p]).all() and (direct.min(axis=1) == distance[:, p]).all()


def test_join_by_key_hot_cold_and_null(spark):
    rows = [(1, i) for i in range(2000)] + [(None, i) for i in range(1500)] + [(k, 0) for k in range(10, 500)]
    df = spark.createDataFrame(rows, "k long, v long")
    side = df.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "n * 10 AS t")
    got = join_by_key(df, side, "k", "n")
    assert got.columns == ["k", "v", "t"]
    want = {1: 20000, None: 15000}
    assert sorted(map(repr, ((r.k, r.v, r.t) for r in got.collect()))) == sorted(
        repr((k, v, want.get(k, 10))) for k, v in rows)

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from dashframe.llm import ngram_join
from dashframe.llm.common import nearly_among
from dashframe.llm.components import components
from tests.llm.helpers import docs, odd_rows, prose, row


def shingles(t):
    w = [x.lower() if x.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
         for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    if len(w) < 3:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)}


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                part[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[i] and find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else (None if sets[i] else r[0])))
    return sorted(map(repr, out))


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = "edit%d" % rng.randrange(9999)
    return " ".join(w)


def rows_with_copies():
    rng = random.Random(4)
    rows = odd_rows()
    for k in range(6):
        base = prose(rng, rng.choice([30, 80, 200, 400]))
        for i in range(rng.choice([2, 5, 40])):
            rows.append(row(1000 * (k + 1) + i, near(rng, base, rng.randint(0, max(1, len(base.split()) // 45)))))
    # A chain whose ends do not link by themselves.
    text = prose(rng, 300)
    for i in range(8):
        rows.append(row(9000 + i, text))
        text = near(rng, text, 3)
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = rows_with_copies()
    got = ngram_join.classes(docs(spark, rows)).drop("text_key", "class").collect()
    assert sorted(map(repr, map(tuple, got))) == brute(rows)


def test_one_per_class_keeps_the_columns(spark):
    rng = random.Random(6)
    text, other = prose(rng, 50), prose(rng, 50)
    frame = docs(spark, [row(3, text), row(2, text.upper()), row(2, text.upper()), row(5, ""), row(5, ""),
                         row(None, "x"), row(None, text), row(None, other), row(None, other.upper()), row(6, None),
                         row(7, other + " a b"), row(7, other + " a c")])
    left = ngram_join.one_per_class(frame)
    assert left.columns == frame.columns
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in left.collect())
    assert [g for g in got if not g[1].startswith(other.lower())] == [
        ("2", text.lower()), ("5", ""), ("5", ""), ("6", ""), ("None", "x")]
    # Of the linked ones with id 7 and without id, one with the id stays.
    assert [g[0] for g in got if g[1].startswith(other.lower())] == ["7"]


def test_pairs_are_judged_from_common_heads():
    """Bounds of an overlap against sets, whatever heads they share."""
    import numpy as np
    import pyarrow as pa
    rng = random.Random(9)
    kind = pa.list_(pa.struct([("head", pa.int64()), ("overlap", pa.int64()), ("n", pa.int64())]))
    sets = [set(rng.sample(range(60), rng.randint(20, 50))) for _ in range(30)]
    rows = {k: [] for k in ("a", "b", "s1", "s2", "h1", "h2")}
    for a in range(20):
        for b in range(a):
            h = [sorted(rng.sample(range(20, 30), rng.randint(0, 4)), key=lambda _: rng.random()) for _ in "ab"]
            for c, x, heads in (("h1", a, h[0]), ("h2", b, h[1])):
                rows[c].append([(t, len(sets[x] & sets[t]), len(sets[t])) for t in heads] or None)
            for c, v in (("a", a), ("b", b), ("s1", len(sets[a])), ("s2", len(sets[b]))):
                rows[c].append(v)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(rows[c], kind if c[0] == "h" else pa.int64()) for c in rows], names=list(rows))
    bounded = 0
    for out in ngram_join._bounds([batch]):
        for r, one, two in zip(out.to_pylist(), rows["h1"], rows["h2"]):
            common = {t for t, _, _ in one or []} & {t for t, _, _ in two or []}
            assert (r["least"] is None) == (not common)
            if common:
                bounded += 1
                assert r["least"] <= len(sets[r["a"]] & sets[r["b"]]) <= r["most"]
    assert bounded > 20


def test_no_rows(spark):
    assert ngram_join.classes(docs(spark, [])).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2)]
    got = components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_five_words_at_four_fifths(spark):
    # Scattered edits: 0.8 or more on five words, under 0.9 on three.
    rng = random.Random(7)
    rows, sets, part = [], [], {}
    for k in range(30):
        base = [f"w{rng.randrange(9999)}" for _ in range(rng.choice([60, 200, 400]))]
        for i in range(3):
            rows.append(row(10 * k + i, near(rng, " ".join(base), i * len(base) // 50)))
    for i, r in enumerate(rows):
        w = r[1].split()
        sets.append({tuple(w[j:j + 5]) for j in range(len(w) - 4)})
        part[i] = i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = part[i], part[j]
                part = {k: min(a, b) if v in (a, b) else v for k, v in part.items()}
    want = {rows[i][0]: rows[v][0] for i, v in part.items()}
    frame = docs(spark, rows)
    got = {r.doc_id: r.component_id for r in ngram_join.classes(frame, ngram_join.Rule(5, 4, 5)).collect()}
    assert got == want and 30 < len(set(want.values())) < 90
    assert corpus_pipeline.NEAR == (5, 4, 5)


def test_lists_hold_only_windows_where_sets_may_meet(spark):
    rule = ngram_join.Rule()
    # Shingle 1: two sets of one block, which meet in its own window alone; 2: a block and the next;
    # 3: one set; 4: two sets, both far in their order; 5: two sets of blocks apart.
    index = spark.createDataFrame([(1, 10, 100, 0), (1, 11, 100, 1), (2, 10, 100, 1), (2, 12, 110, 0), (3, 10, 100, 2),
                                   (4, 10, 100, 9), (4, 11, 100, 9), (5, 10, 100, 3), (5, 13, 300, 0)],
                                  "token long, sid long, size int, pos int")
    got = {}
    for r in ngram_join._lists(index, rule).collect():
        got.setdefault((r.token, r.window), set()).add(r.sid)
        blocks = {r.block, r.window}
        assert len(blocks) == 1 or max(blocks) == r.window
    assert [(t, s) for (t, _), s in sorted(got.items())] == [(1, {10, 11}), (2, {10, 12})]


def test_nearly_among_keeps_every_row_of_a_key(spark):
    rows = spark.range(-3000, 3000).withColumn("key", F.xxhash64("id"))
    keys = rows.where("id % 7 = 0").select("key")
    got = {r.id for r in nearly_among(rows, keys, "key").collect()}
    want = {i for i in range(-3000, 3000) if i % 7 == 0}
    assert want <= got and len(got) < len(want) + 100
    assert nearly_among(rows, keys.where("false"), "key").columns == ["id", "key"]
    assert nearly_among(rows, keys.where("false"), "key").collect() == []

import hashlib
import random
import re

import pytest

from dashframe.llm import winnow
from tests.llm.helpers import docs, odd_rows, prose, row


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i:i + n]))
                if got is not None:
                    found |= got
                    hit |= set(range(i, i + n))
        ids = sorted(str(x) for x in found if x is not None)
        out.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("prefilter", [winnow.PREFILTER, 0])
def test_equals_brute_force(spark, prefilter):
    rng = random.Random(3)
    passages = [prose(rng, n) for n in (13, 14, 20, 40, 80, 5, 1, 12)] + ["la " * 30]
    items = [(i, p) for i, p in enumerate(passages)] + [
        (20, None), (21, " -- "), (22, passages[2]), (None, passages[3]), (5, passages[5])]
    rows = odd_rows()
    for i in range(60):
        p = rng.choice(passages).split()
        a = rng.randrange(len(p))
        text = prose(rng, rng.randint(0, 60)) + " " + " ".join(p[a:a + rng.randint(1, 90)]).upper() + "; " \
            + prose(rng, rng.randint(0, 60)) + rng.choice(["", " " + passages[0], " " + passages[4]])
        rows.append(row(100 + i, text))
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, n_words string")
    got = winnow.contamination(docs(spark, rows), bench, prefilter).drop("text_key")
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(rows, items)


def test_nothing_to_compare(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [row(1, "some words"), row(2, None)]
    got = winnow.contamination(docs(spark, rows), none).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got] == [(1, 2, 0, False), (2, 0, 0, False)]
    assert winnow.contamination(docs(spark, []), none).collect() == []


def test_decontaminate_keeps_the_columns(spark):
    text = prose(random.Random(9), 30)
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    frame = docs(spark, [row(1, "x " + text), row(2, "clean"), row(None, None)])
    left = winnow.decontaminate(frame, bench)
    assert left.columns == frame.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "None"]

"""The trie of rebuilt conversations against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

from dashframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth long, key string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(rows):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in rebuilt(rows).items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        leaves = 0 if kids[p] else 1
        sums[p] = (leaves + sum(sums[k][0] for k in kids[p]), saved + sum(sums[k][1] for k in kids[p]))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]),
                    *sums[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], SCHEMA).repartition(parts)
    out = prefix_trie.trie(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                           "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_like_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 1 else "user", rng.choice(["hi", "é東", "x y"])))
    rows += [(7000 + i, t, "user", "same") for i in range(60) for t in range(3)]      # many copies
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_a_very_long_conversation(spark):
    rows = [(5, t, "user", f"turn {t % 7}") for t in range(700)] + [(6, t, "user", f"turn {t % 7}") for t in range(90)]
    rows += [(c, 0, "user", "short") for c in range(20, 40)]
    assert run(spark, rows, 5) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "", ""), (2, None, "user", "first"), (2, 0, "user", "second"),
            (3, 0, "user", "a"), (3, 0, "user", "a"), (None, 0, "user", "nobody"), (-3, 0, "user", "below"),
            (-5, 0, "user", "base"), (-5, 1, "user", "base 2"), (8, 0, "a:b", "c"), (9, 0, "a", "b:c"),
            (12, 0, "user", "z" * 9000)] + [(c, 0, "u", "t") for c in range(50, 60)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "x")]) == []


def test_ends_in_pieces(spark, monkeypatch):
    """A node's ids cross partitions and pieces."""
    ends = spark.range(5000).selectExpr(
        "CAST(CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 7 AS STRING) END AS BINARY) AS name",
        "id AS conv_id").repartition(6)
    want = defaultdict(list)
    for r in ends.collect():
        want[bytes(r.name)].append(r.conv_id)
    want = {n: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for n, v in want.items()}
    got = {bytes(r.name): r.ends_sha256 for r in prefix_trie.end_hashes(ends).collect()}
    assert got == want


def test_pieces_are_bounded():
    import pyarrow as pa
    b = pa.RecordBatch.from_pydict({"name": [b"n"] * 50000, "conv_id": list(range(50000))})
    out = list(prefix_trie._pieces([b]))
    pieces = [p for x in out for p in x.column("piece").to_pylist()]
    assert ",".join(pieces) == ",".join(map(str, range(50000)))
    assert max(map(len, pieces)) <= prefix_trie.PIECE + 20 and len(out) > 1

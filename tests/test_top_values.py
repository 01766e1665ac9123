"""Top values against a plain count, whichever way proves them."""

import random
from collections import Counter

import pytest

from dashframe.operators import profile
from dashframe.operators.profile import column_profile, detect_types, top_values


def brute(rows, columns, k=10):
    out = []
    for i, c in enumerate(columns):
        counts = Counter(None if r[i] is None else str(r[i]) for r in rows)
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:k]
        out += [(c, v, n, j + 1) for j, (v, n) in enumerate(best)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("column_name", "value", "count", "rank").collect()), key=repr)


def table(rng, n):
    return [(f"key {i:07d}",                                     # unique
             f"key {i // 2:07d}" if i % 5 else "often",          # pairs, and one that stands out
             rng.choice(["a", "b", None, "c"]),                  # few values
             f"v{min(int(rng.paretovariate(0.6)), 5000)}",       # skewed
             rng.choice("xyz") * rng.randint(1, 40),
             i % 7) for i in range(n)]


@pytest.mark.parametrize("buckets,chosen,smallest", [
    (1 << 16, 64, 1000),      # as shipped
    (50, 3, 1000),            # buckets prove nothing, hashes do
    (50, 3, 2),               # neither: whole values are counted
    (1 << 16, 64, 2)])
def test_like_brute_force(spark, monkeypatch, buckets, chosen, smallest):
    for name, value in (("BUCKETS", buckets), ("CHOSEN", chosen), ("SMALLEST", smallest)):
        monkeypatch.setattr(profile, name, value)
    rows = table(random.Random(5), 3000)
    columns = ["unique", "pairs", "few", "skewed", "long", "num"]
    df = spark.createDataFrame(rows, "unique string, pairs string, few string, skewed string, long string, num int")
    assert got(top_values(df.repartition(4))) == brute(rows, columns)


def test_fewer_values_than_k_and_empty(spark):
    rows = [("a", None), ("a", None), ("b", None)]
    df = spark.createDataFrame(rows, "t string, empty string")
    assert got(top_values(df)) == brute(rows, ["t", "empty"])
    assert got(top_values(df.limit(0))) == []
    assert got(top_values(df, ["t"], k=1)) == [("t", "a", 2, 1)]


def test_no_text_of_a_column_that_stands_out_is_shuffled(spark):
    """A near-unique column with frequent values: the rows that reach the
    recount are those of the chosen buckets."""
    rows = [(f"text number {i}" if i % 4 else f"frequent {i % 40}",) for i in range(20000)]
    df = spark.createDataFrame(rows, "t string").repartition(4)
    out = top_values(df)
    assert got(out) == brute(rows, ["t"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "dense_rank" not in plan          # the later ways were dropped
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning-top", "top")
    top_values(df)
    assert not jobs.getJobIdsForGroup("planning-top")


def test_profile_counts_by_fingerprint(spark):
    rows = [("a", "2024-01-05"), ("a", "2024-02-05"), (None, "2024-03-05"), ("", None), ("b", "x")]
    df = spark.createDataFrame(rows, "c string, d string")
    assert {tuple(r) for r in column_profile(df).collect()} == {("c", 5, 1, 4), ("d", 5, 1, 5)}
    assert {tuple(r) for r in detect_types(df).collect()} == {("c", "text"), ("d", "datetime")}

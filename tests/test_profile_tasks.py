"""The tasks that count a table's values grow with the values."""

from collections import Counter

from pyspark.sql import functions as F

from dashframe.operators import profile
from dashframe.plans import derived
from dashframe.session import tasks_for


def test_tasks_grow_with_the_rows(spark):
    assert [tasks_for(spark, n, 1000) for n in (0, 1, 5000, 5001)] == [1, 1, 5, 6]


def test_values_are_counted_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(profile, "VALUES", 500)
    # One value is frequent, rows repeat, and each column has another type.
    rows = [(i if i % 2 else None, "2024-01-0%d" % (i % 9 + 1) if i % 3 else "same", float(i % 5)) for i in range(2000)]
    df = spark.createDataFrame(rows * 2, "a long, b string, c double").repartition(4)
    freq = profile.fingerprint_frequencies(df)
    assert freq.rdd.getNumPartitions() >= 24      # 12,000 values
    sizes = [r[0] for r in freq.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1))).select("count(1)").collect()]
    assert max(sizes) <= 500
    want = {(name, v is None, name == "b" and v != "same", n)
            for name, col in zip("abc", zip(*rows)) for v, n in ((v, 2 * k) for v, k in Counter(col).items())}
    got = freq.collect()
    assert len(got) == sum(len(set(col)) for col in zip(*rows))
    assert {(r.column_name, r.missing, r.dated, r["count"]) for r in got} == want
    assert freq.columns == ["column_name", "f1", "f2", "count", "missing", "dated"]


def test_a_spread_table_has_tasks_by_its_rows(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(derived, "LINES", 10)
    frame = derived.spread(spark, str(tmp_path), "t", "id")
    assert frame.rdd.getNumPartitions() == 100 and frame.count() == 1000

"""A key holding a third of all rows: results stay exact and the work for
that key is spread over several tasks."""

from pyspark.sql import functions as F

from dashframe.operators.aggregate import chart_aggregate
from dashframe.operators.quantiles import LEAST, MARGIN, cell_sizes, grouped_quantiles

SF = "/root/testdata/sf0.01"


def skewed(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    # every third row (by line number) is re-keyed to one hot supplier
    hot = F.when(F.col("l_linenumber") % 3 == 0, F.lit(-1)).otherwise(F.col("l_suppkey"))
    return li.select(hot.alias("k"), F.col("l_extendedprice").alias("v"))


def test_hot_group_shuffles_its_brackets_only(spark):
    df = skewed(spark)
    sizes = cell_sizes(df, ["k"], "v", [0.5]).where("__g0 = -1").collect()
    total = sum(r["rows"] for r in sizes)
    assert total > LEAST
    # Two brackets' worth of values at most, spread over several cells.
    assert 0 < sum(r["shuffled"] for r in sizes) <= 2 * 2 * MARGIN * total + 10
    assert max(r["rows"] for r in sizes) < 0.3 * total


def test_hot_group_median_exact(spark):
    df = skewed(spark)
    got = {r["k"]: r["m"] for r in grouped_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_hot_key_aggregate_is_pre_reduced(spark):
    out = chart_aggregate(skewed(spark), "k", ["v"], "sum")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    assert out.where("k = -1").count() == 1

"""First rows in the order of the files, and pages by the rank index."""

import pytest
from pyspark.sql import functions as F

from dashframe.operators.aggregate import aggregate
from dashframe.operators.order import RankIndex, first_rows, page, preview, row_order
from dashframe.operators.profile import sample_values
from dashframe.operators.transform import compute_measures
from dashframe.spec import AggregationConfig

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """40 rows in four files, in no order of any column."""
    path = str(tmp_path_factory.mktemp("rows") / "t")
    rows = [(i * 37 % 40, f"n{i * 11 % 40}", None if i % 4 == 0 else i) for i in range(40)]
    for at in range(0, 40, 10):
        spark.createDataFrame(rows[at:at + 10], "k long, name string, v long").coalesce(1) \
            .write.mode("append").parquet(f"{path}/part={at // 10}")
    return spark.read.parquet(path), rows


def test_first_rows_are_the_files(spark, files):
    df, rows = files
    assert [(r.k, r.name, r.v) for r in preview(df, 13).collect()] == rows[:13]
    more, _ = compute_measures(df, [{"name": "twice", "expression": "[k] * 2"}])
    got = first_rows(more.where("k > 5"), 7, ["name", "twice"])
    assert [(r.name, r.twice) for r in got.collect()] == [(n, 2 * k) for k, n, _ in rows if k > 5][:7]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_rows_of_no_file_have_a_total_order(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k long, s string")
    assert row_order(df) is None and row_order(df.groupBy("k").count()) is None
    assert [r.k for r in preview(df, 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        aggregate(df, AggregationConfig((), "k", "first"))
    with pytest.raises(ValueError):
        sample_values(df)


def test_first_last_and_samples(spark, files):
    df, rows = files
    keyed = df.withColumn("g", F.col("k") % 3)
    for fn, pick in (("first", 0), ("last", -1)):
        got = {r.g: r[f"v_{fn}"] for r in aggregate(keyed, AggregationConfig(("g",), "v", fn)).collect()}
        want = {}
        for k, _, v in rows:
            want.setdefault(k % 3, []).append(v)
        assert got == {g: v[pick] for g, v in want.items()}
    got = {r.column_name: r.samples for r in sample_values(df, columns=["v"], k=4).collect()}
    assert got == {"v": "|".join(str(v) for _, _, v in rows if v is not None)[:0] + "1|2|3|5"}


@pytest.mark.parametrize("settings", [
    {"spark.sql.shuffle.partitions": "8"},
    {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"},
    {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false"},
    {"spark.sql.shuffle.partitions": "1"}])
def test_index_pages(spark, settings, tmp_path):
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        orders = spark.read.parquet(f"{SF}/orders.parquet").repartition(7)
        order = [F.col("o_totalprice").asc(), F.col("o_orderkey").asc()]
        index = RankIndex.build(orders, order, block_rows=500, path=str(tmp_path / "index"))
        n = index.total()
        assert n == orders.count()
        keys = [r.o_orderkey for r in orders.orderBy(*order).collect()]
        for offset, limit in ((0, 10), (n // 2, 100), (n - 3, 50), (499, 2), (n, 5), (n + 100, 5), (7, 0)):
            got = index.page(limit, offset)
            assert got.columns == orders.columns + ["position"]
            assert [(r.position, r.o_orderkey) for r in got.collect()] == list(
                enumerate(keys, 1))[offset:offset + limit], (offset, limit)
        assert len(index.page(100, n // 2).inputFiles()) <= 2
        again = RankIndex.open(spark, str(tmp_path / "index")).page(20, 4321).collect()
        assert again == page(orders, order, 20, 4321).collect()
        assert index.blocks.agg(F.max("n")).first()[0] <= 500
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_index_of_no_rows(spark):
    empty = spark.createDataFrame([], "k long, s string")
    index = RankIndex.build(empty, [F.col("k")])
    assert index.total() == 0 and index.page(5).collect() == []


def test_deep_page_reads_blocks(spark, monkeypatch):
    monkeypatch.setattr("dashframe.operators.order.PAGE_BLOCK_ROWS", 500)
    rows = spark.range(20_000).selectExpr("cast(hash(id) as long) as h", "id as k").repartition(7)
    order = [F.col("h").asc(), F.col("k").asc()]
    keys = [r.k for r in rows.orderBy(*order).collect()]
    for offset, limit in ((10_000, 100), (0, 20), (19_990, 50), (900, 200)):
        got = page(rows, order, limit, offset)
        assert got.columns == ["h", "k", "position"]
        assert [(r.position, r.k) for r in got.collect()] == list(enumerate(keys, 1))[offset:offset + limit]
    deep = page(rows, order, 100, 10_000)
    assert spark.read.parquet(*deep.inputFiles()).count() <= 1000

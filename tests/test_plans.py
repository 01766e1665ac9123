"""Plan checks: filters reach the Parquet scan, columns are pruned, and no
Python UDF appears in the operator plans."""

import __spark_entry__ as E
from dashframe.operators.quantiles import cell_sizes, grouped_quantiles
from dashframe.plans.registered import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_pushes_filter_and_prunes(spark):
    p = plan(E.entry(spark))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double," \
           "l_returnflag:string>" in p


# The workbook reader parses each file with one Python UDTF call (and the
# test derives its workbooks with mapInPandas); nothing else may use Python.
WORKBOOK_QUERIES = {"ingest_workbooks", "sheet_catalog"}


def test_no_python_udfs_in_operator_plans(spark):
    for name, fn in QUERIES.items():
        if name in WORKBOOK_QUERIES or name == "stream_refresh":
            continue
        p = plan(fn(spark, SF))
        assert "EvalPython" not in p and "MapInPandas" not in p, name


def test_partial_aggregation_before_shuffle(spark):
    p = plan(E.queries()["agg_sum"](spark, SF))
    assert "partial_sum" in p


def executed(df):
    """The final adaptive plan of an executed query."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_top_k_per_group_limits_map_side(spark):
    for name in ("profile_top_values", "catalog_recent", "latest_per_owner"):
        p = plan(E.queries()[name](spark, SF))
        assert "WindowGroupLimit" in p and "Partial" in p, name


def test_histogram_has_no_exact_distinct_shuffle(spark):
    p = plan(E.queries()["chart_histogram"](spark, SF))
    assert "count(distinct" not in p.lower()


def test_median_shuffles_brackets_only(spark):
    """Three passes: sketches, counts, and the values at the places found."""
    rows = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "median")
    out = grouped_quantiles(rows, ["l_returnflag"], "l_extendedprice", {"m": 0.5})
    assert not jobs.getJobIdsForGroup("planning")      # no job while the plan is built
    p = executed(out)
    assert "kll_sketch_agg_double" in p and "percentile" not in p.lower()
    assert p.count("Scan parquet") <= 3
    shuffled = [r["shuffled"] for r in cell_sizes(rows, ["l_returnflag"], "l_extendedprice", [0.5]).collect()]
    assert sum(shuffled) < 0.05 * rows.count()


def test_pie_total_is_a_scalar_subquery_not_a_join(spark):
    p = plan(E.queries()["chart_pie"](spark, SF))
    assert "Subquery" in p and "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_twelve_visuals_share_one_scan(spark):
    """Equal filters: the groupings of all visuals are one scan's aggregate, and
    every dataset reads the stored result of it."""
    from dashframe.operators.charts import grouping_of
    from dashframe.operators.filters import apply_dashboard_filters
    from dashframe.operators.grouping import grouping_sets
    from dashframe.operators.transform import compute_measures
    from dashframe.plans.dashboard import export_datasets
    from dashframe.plans.registered import FLAGSHIP_MEASURES, _twelve
    from dashframe.spec import ChartSpec
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    visuals, one = _twelve(), [{"col": "l_quantity", "op": "gt", "val": 5}]
    parts, _ = export_datasets(li, visuals, FLAGSHIP_MEASURES, {v["viz_id"]: one for v in visuals})
    assert len(parts) == 12 and not any(p.error for p in parts)
    assert all("lineitem" not in f for p in parts for f in p.data.inputFiles())
    rows, _ = apply_dashboard_filters(compute_measures(li, FLAGSHIP_MEASURES)[0], one)
    p = plan(grouping_sets(rows, [grouping_of(rows, ChartSpec.from_dict(v["config"])) for v in visuals]))
    assert p.count("FileScan") == 1 and "Expand" in p and "partial_sum" in p
    assert "GreaterThan(l_quantity,5.0)" in p


def test_shared_and_own_scans_agree(spark, tmp_path):
    """NULL keys, equal key sets, empty tables, and a visual that fails."""
    from dashframe.plans.dashboard import export_datasets, write_bundle
    df = spark.createDataFrame([("a", 1, 2.0, 5), ("a", None, 3.0, None), (None, 1, None, 7), ("b", 2, 1.0, 2 ** 62),
                                ("b", 2, 1.5, 2 ** 62)], "x string, z int, y double, w long")

    def v(i, kind, fn="sum", **config):
        return {"slide_id": "s", "viz_id": f"v{i}", "config": {"visualization_type": kind, "aggregation": fn, **config}}
    visuals = [v(0, "column_chart", x_column="x", y_columns=["y", "w"], color_column="z", show_values=True),
               v(1, "bar_chart", "count", x_column="z", y_column="w"), v(2, "pie_chart", x_column="x", y_column="y"),
               v(3, "heatmap", "mean", x_column="x", y_column="z", color_column="y"), v(4, "metric_card", y_column="w"),
               v(5, "metric_card", "min", y_column="y"), v(6, "bar_chart", x_column="z", y_column="x"),
               v(7, "line_chart", x_column="z", y_column="z", color_column="x"),
               v(8, "column_chart", x_column="z", y_column="y", color_column="x")]
    for rows in (df, df.limit(0)):
        shared, _ = export_datasets(rows, visuals)
        own, _ = export_datasets(rows, visuals, share=False)
        for a, b in zip(shared, own):
            assert (a.error is None) == (b.error is None), a.viz_id
            if a.data is not None:
                assert a.data.dtypes == b.data.dtypes
                assert list(map(tuple, a.data.collect())) == list(map(tuple, b.data.collect())), a.viz_id
    assert [p.error is None for p in shared] == [True] * 6 + [False] + [True] * 2
    man = {r.viz_id: (r.rows, r.status) for r in write_bundle(df.limit(0), visuals, f"{tmp_path}/b").collect()}
    assert man["v0"] == (0, "ok") and man["v4"] == (1, "ok") and man["v6"] == (None, "failed")
    man = {r.viz_id: (r.rows, r.status) for r in write_bundle(df, visuals, f"{tmp_path}/c").collect()}
    assert man["v0"] == (4, "ok") and man["v3"] == (2, "ok")

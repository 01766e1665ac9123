"""Unit tests on small literal frames: null rules, edge frames, odd names."""

import json
import math

import pytest
from pyspark.sql import functions as F

from dashframe.functions.measures import MeasureError, compose_expression, parse_measure
from dashframe.operators.aggregate import aggregate, chart_aggregate, table_aggregate
from dashframe.operators.charts import (ChartSpecError, box_plot, histogram, metric_card,
                                        pie_chart, table_view)
from dashframe.operators.filters import apply_dashboard_filters, search_table
from dashframe.operators.order import with_position
from dashframe.operators.quantiles import grouped_quantiles
from dashframe.operators.transform import compute_measures, dedupe_names
from dashframe.schema import semantic_type, storage_type
from dashframe.spec import AggregationConfig, ChartSpec, ColumnType, FilterCondition


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_measure_whitelist_rejects_code(spark):
    for bad in ("__import__('os')", "[a] ** 2", "[a] if 1 else 2", "f([a])", "[a] % 2", ""):
        with pytest.raises(MeasureError):
            parse_measure(bad)


def test_measure_names_with_odd_characters(spark):
    df = spark.createDataFrame([(2.0, 4.0)], "`a b.c` double, `x``y` double")
    out, skipped = compute_measures(df, [{"name": "r", "expression": "[a b.c] / [x`y]"},
                                         {"name": "z", "expression": "[a b.c] / 0"}])
    assert skipped == []
    assert rows(out.select("r", "z")) == [(0.5, None)]


def test_measure_replaces_and_chains(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    out, _ = compute_measures(df, [{"name": "a", "expression": "[a] + 1"},
                                   {"name": "b", "expression": "-[a] * 3"}])
    assert rows(out) == [(2.0, -6.0)]


def test_compose_expression(spark):
    assert compose_expression([{"col": "a"}, {"op": "*", "col": ""}, {"op": "-", "col": "b"}]) \
        == "[a] - [b]"


def test_dedupe_names():
    assert dedupe_names(["a", "b", "c"], {"a": "x", "b": "x", "c": "x"}) == ["x", "x_1", "x_2"]
    assert dedupe_names(["a", "x"], {"a": "x"}) == ["x_1", "x"]
    assert dedupe_names(["a", "x_1", "b"], {"a": "x", "b": "x"}) == ["x", "x_1", "x_2"]


def test_null_sum_is_zero_and_count_skips_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "k int, v double")
    got = dict(rows(aggregate(df, AggregationConfig(("k",), "v", "sum"))))
    assert got == {1: 0.0, 2: 3.0}
    got = dict(rows(aggregate(df, AggregationConfig(("k",), "v", "count"))))
    assert got == {1: 0, 2: 1}


def test_min_max_skip_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (5.0,)], "v double")
    assert rows(table_aggregate(df, "v", "max")) == [(5.0,)]
    assert rows(table_aggregate(df, "v", "min")) == [(1.0,)]


def test_median_even_and_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", 2.0), ("a", None)], "k string, v double")
    got = dict(rows(aggregate(df, AggregationConfig(("k",), "v", "median"))))
    assert got == {None: 2.5, "a": 2.0}


def test_quantiles_on_hot_group_match_brute_force(spark):
    data = [("hot", float(i % 997)) for i in range(5000)] + [("cold", float(i)) for i in range(7)]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    got = {r["g"]: r for r in grouped_quantiles(df, ["g"], "v", {"q1": 0.25, "med": 0.5}).collect()}
    for g in ("hot", "cold"):
        vals = sorted(v for k, v in data if k == g)
        for name, q in (("q1", 0.25), ("med", 0.5)):
            pos = (len(vals) - 1) * q
            lo, hi = math.floor(pos), math.ceil(pos)
            want = vals[lo] + (vals[hi] - vals[lo]) * (pos - lo)
            assert got[g][name] == pytest.approx(want)


def test_box_positions_and_empty(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [5, 1, 4, 2, 3]] + [(None, 9.0)],
                               "g string, y double")
    out = rows(box_plot(df, ChartSpec("box_plot", x_column="g", y_column="y")))
    assert out == [("a", 5, 1.0, 2.0, 3.0, 4.0, 5.0)]
    empty = df.where("false")
    assert rows(box_plot(empty, ChartSpec("box_plot", x_column="g", y_column="y"))) == []


def test_histogram_constant_column_one_bin(spark):
    df = spark.createDataFrame([(7.0,)] * 4, "v double")
    out = rows(histogram(df, ChartSpec("histogram", x_column="v")))
    assert [(r[0], r[1]) for r in out] == [(0, 4)]


def test_histogram_counts_sum_to_non_null(spark):
    df = spark.createDataFrame([(float(i) if i % 4 else None,) for i in range(100)], "v double")
    out = histogram(df, ChartSpec("histogram", x_column="v"))
    assert out.agg(F.sum("count")).first()[0] == 75
    assert out.count() == 20


def test_pie_share_sums_to_100_and_zero_total(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -3.0), ("c", None)], "x string, y double")
    out = pie_chart(df, ChartSpec("pie_chart", x_column="x", y_column="y"))
    assert out.agg(F.sum("share")).first()[0] == pytest.approx(100.0)
    zero = spark.createDataFrame([("a", 0.0)], "x string, y double")
    assert rows(pie_chart(zero, ChartSpec("pie_chart", x_column="x", y_column="y"))
                .select("share")) == [(0.0,)]


def test_dashboard_filters_skip_invalid(spark):
    df = spark.createDataFrame([(1, "a"), (5, "b")], "n int, s string")
    out, skipped = apply_dashboard_filters(df, [
        {"col": "n", "op": "gt", "val": "x"}, {"col": "zz", "op": "eq", "val": 1},
        {"col": "s", "op": "lt", "val": 3}, {"col": "n", "op": "gte", "val": "4.9"}])
    assert rows(out) == [(5, "b")]
    assert [s.index for s in skipped] == [0, 1, 2]


def test_in_empty_list_keeps_nothing(spark):
    df = spark.createDataFrame([(1,)], "n int")
    out, _ = apply_dashboard_filters(df, [{"col": "n", "op": "in", "val": " , "}])
    assert out.count() == 0


def test_unknown_typed_operator_rejected():
    with pytest.raises(ValueError):
        FilterCondition("a", "like", 1)


def test_search_table_no_text_columns(spark):
    df = spark.createDataFrame([(1,)], "n int")
    assert search_table(df, "x").count() == 1


def test_table_defaults_to_first_ten_columns(spark):
    cols = ", ".join(f"c{i} int" for i in range(12))
    df = spark.createDataFrame([tuple(range(12))], cols)
    assert table_view(df, ChartSpec("table")).columns == [f"c{i}" for i in range(10)]


def test_metric_integer_formatting(spark):
    df = spark.createDataFrame([(1234567,), (1,)], "n long")
    out = metric_card(df, ChartSpec("metric_card", y_column="n", aggregation="sum")).first()
    assert (out["label"], out["formatted"]) == ("Total", "1,234,568")
    out = metric_card(df, ChartSpec("metric_card", y_column="n", aggregation="mean")).first()
    assert out["formatted"] == "617.28K"


def test_chart_aggregate_missing_columns_returns_input(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert chart_aggregate(df, "zz", ["b"]).columns == ["a", "b"]
    with pytest.raises(ChartSpecError):
        pie_chart(df, ChartSpec("pie_chart", x_column="a", y_column="zz"))


def test_with_position_matches_global_sort(spark):
    df = spark.range(0, 3000).select((F.col("id") * 7919 % 3001).alias("v")).repartition(5)
    got = [r["v"] for r in with_position(df, [F.col("v").asc()]).orderBy("position").collect()]
    pos = [r["position"] for r in with_position(df, [F.col("v").asc()]).collect()]
    assert got == sorted(got) and sorted(pos) == list(range(1, 3001))


def test_type_maps(spark):
    df = spark.createDataFrame([], "a tinyint, b decimal(10,2), c timestamp_ntz, d boolean, e string")
    assert [semantic_type(f.dataType) for f in df.schema.fields] == [
        ColumnType.NUMERIC, ColumnType.NUMERIC, ColumnType.DATETIME, ColumnType.BOOLEAN,
        ColumnType.CATEGORICAL]
    assert [storage_type(f.dataType) for f in df.schema.fields] == [
        "Int64", "Float64", "Datetime", "Boolean", "String"]


def test_empty_frame_aggregates(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert rows(aggregate(df, AggregationConfig(("k",), "v", "median"))) == []
    assert rows(table_aggregate(df, "v", "sum")) == [(0.0,)]


def test_offered_operators_by_type(spark):
    from pyspark.sql import types as T
    from dashframe.operators.filters import offered_operators
    assert "contains" not in offered_operators(T.DoubleType())
    assert "gt" not in offered_operators(T.StringType())
    assert "gt" in offered_operators(T.TimestampNTZType())


def test_reorder_ignores_unknown_and_drops_unlisted(spark):
    from dashframe.operators import documents as N
    doc = {"id": "a", "slides": [{"id": "s1"}, {"id": "s2"}, {"id": "s3"}]}
    df = spark.createDataFrame([(json.dumps(doc),)], "data string")
    d = N.parse(df).withColumn("order", F.array(F.lit("s3"), F.lit("zz"), F.lit("s1")))
    got = [r["slide_id"] for r in N.slide_rows(N.reorder_slides(d, "order"))
           .orderBy("slide_pos").collect()]
    assert got == ["s3", "s1"]


def test_parse_fills_defaults(spark):
    from dashframe.operators import documents as N
    df = spark.createDataFrame([('{"id": "x", "slides": [{"id": "s"}]}',)], "data string")
    r = N.parse(df).select("doc.name", "doc.measures", "doc.slides").first()
    assert r["name"] == N.ANALYSIS_DEFAULTS["name"] and r["measures"] == []
    assert r["slides"][0]["layout"] == "single" and r["slides"][0]["visualizations"] == []


def test_boolean_measures_sum_as_counts_and_text_sum_rejected(spark):
    df = spark.createDataFrame([("a", True, "x"), ("a", False, "y"), ("a", True, None)],
                               "k string, b boolean, t string")
    assert rows(chart_aggregate(df, "k", ["b"], "sum")) == [("a", 2)]
    assert rows(chart_aggregate(df, "k", ["t"], "count")) == [("a", 2)]
    with pytest.raises(ValueError):
        chart_aggregate(df, "k", ["t"], "mean")


def test_profile_min_max_skip_nan(spark):
    from dashframe.operators.profile import numeric_stats
    df = spark.createDataFrame([(float("nan"),), (2.0,), (3.0,)], "v double")
    r = numeric_stats(df).first()
    assert (r["min"], r["max"]) == (2.0, 3.0)


def test_approx_quantiles_close_to_exact(spark):
    from dashframe.operators.quantiles import approx_grouped_quantiles
    df = spark.range(0, 10001).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    ex = {r["g"]: r["m"] for r in grouped_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    ap = {r["g"]: r["m"] for r in approx_grouped_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert all(abs(ex[g] - ap[g]) <= 10 for g in ex)


def test_approx_type_detection_agrees_with_exact(spark):
    from dashframe.operators.profile import detect_types
    from dashframe.plans import derived as D
    t = D.typed_customers(spark, "/root/testdata/sf0.001")
    exact = {r[0]: r[1] for r in detect_types(t).collect()}
    approx = {r[0]: r[1] for r in detect_types(t, approx=True).collect()}
    assert exact == approx


def test_value_labels_when_shown(spark):
    from dashframe.operators.charts import chart_dataset
    df = spark.createDataFrame([("a", 1234.5), ("a", 0.004), ("b", None)], "x string, y double")
    col_rows = chart_dataset(df, ChartSpec("column_chart", x_column="x", y_column="y",
                                           show_values=True)).collect()
    assert {r["x"]: r["y_label"] for r in col_rows} == {"a": "1,234.50", "b": "0.00"}
    line_rows = chart_dataset(df, ChartSpec("line_chart", x_column="x", y_column="y",
                                            show_values=True)).collect()
    assert {r["x"]: r["y_label"] for r in line_rows} == {"a": "1234.5", "b": "0.0"}


def test_box_linear_quartiles(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 4]], "g string, y double")
    r = box_plot(df, ChartSpec("box_plot", x_column="g", y_column="y"), method="linear").first()
    assert (r["lower"], r["q1"], r["median"], r["q3"], r["upper"]) == (1.0, 1.75, 2.5, 3.25, 4.0)


def test_odd_column_names_through_filters_charts_profile(spark):
    from dashframe.operators.charts import chart_dataset
    from dashframe.operators.profile import column_profile, top_values
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, None), ("b", None, 5)],
                               "`cat.egory x` string, `val``ue` double, `n [k]` int")
    kept, skipped = apply_dashboard_filters(df, [{"col": "n [k]", "op": "is_not_null"}])
    assert kept.count() == 2 and skipped == []
    spec = ChartSpec("column_chart", x_column="cat.egory x", y_column="val`ue")
    got = {r[0]: r[1] for r in chart_dataset(df, spec).collect()}
    assert got == {"a": 4.0, "b": 0.0}
    prof = {r["column_name"]: (r["null_count"], r["unique_count"])
            for r in column_profile(df).collect()}
    assert prof == {"cat.egory x": (0, 2), "val`ue": (1, 3), "n [k]": (1, 3)}
    assert top_values(df, ["cat.egory x"]).first()["value"] == "a"


def test_pivot_with_odd_names(spark):
    from dashframe.operators.charts import pivot_wide
    df = spark.createDataFrame([("p", "x.1", 1.0), ("p", "x.1", 2.0), ("q", "y", 5.0)],
                               "`row.key` string, `col``key` string, v double")
    out = {r["row.key"]: (r["x.1"], r["y"]) for r in pivot_wide(df, "col`key", "row.key", "v")
           .collect()}
    assert out == {"p": (3.0, None), "q": (None, 5.0)}


def test_sort_only_for_sortable_visuals(spark):
    from dashframe.operators.charts import chart_dataset
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 2.0)], "x string, y double")
    line = chart_dataset(df, ChartSpec("line_chart", x_column="x", y_column="y"), "value_desc")
    assert [r["x"] for r in line.collect()] == ["a", "b", "c"]
    col_ = chart_dataset(df, ChartSpec("column_chart", x_column="x", y_column="y"), "value_desc")
    assert [r["x"] for r in col_.collect()] == ["a", "c", "b"]
    pie = chart_dataset(df, ChartSpec("pie_chart", x_column="x", y_column="y"), "x_desc")
    assert [r["x"] for r in pie.collect()] == ["c", "b", "a"]


def test_typed_contains_is_regex_dashboard_contains_is_literal(spark):
    from dashframe.operators.filters import apply_filters
    df = spark.createDataFrame([("small ring",), ("r.ng x",)], "name string")
    typed = apply_filters(df, [FilterCondition("name", "contains", "r.ng")])
    dash, _ = apply_dashboard_filters(df, [{"col": "name", "op": "contains", "val": "r.ng"}])
    assert sorted(r[0] for r in typed.collect()) == ["r.ng x", "small ring"]
    assert [r[0] for r in dash.collect()] == ["r.ng x"]


def test_skipped_measures_are_reported(spark):
    df = spark.createDataFrame([(1.0, "x")], "a double, t string")
    out, skipped = compute_measures(df, [
        {"name": "ok", "expression": "[a] * 2"}, {"name": "bad_ref", "expression": "[zz] + 1"},
        {"name": "", "expression": "[a]"}, {"name": "blank", "expression": " "},
        {"name": "text", "expression": "[t] * 2"}, {"name": "syntax", "expression": "[a] +* 1"}])
    assert out.columns == ["a", "t", "ok"]
    assert skipped == ["bad_ref", "<blank>", "blank", "text", "syntax"]

"""Registered queries: each builds one operator's result from the fixture
tables (spark, sf_dir) -> DataFrame, next to the DuckDB SQL that states the
same result for the correctness check.  Doubles that come out of arithmetic
are rounded to 4 places on both sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dashframe.functions.columns import col
from dashframe.operators.aggregate import aggregate, chart_aggregate
from dashframe.operators.charts import (bar_chart, box_plot, column_chart, heatmap_cells,
                                        histogram, histogram_left_out, line_chart, metric_card, pie_chart,
                                        pivot_wide, scatter_plot, table_view)
from dashframe.operators.filters import (apply_dashboard_filters, apply_filters,
                                         search_column, search_table)
from dashframe.operators.order import RankIndex, chart_order, with_position
from dashframe.operators.transform import compute_measures
from dashframe.plans import derived as D
from dashframe.plans.dashboard import export_long, render_visual
from dashframe.functions.measures import compose_expression
from dashframe.spec import AggregationConfig, ChartSpec, FilterCondition

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def r4(c):
    return F.round(c, 4)


def rounded(df, names):
    return df.select(*[r4(col(c)).alias(c) if c in names else col(c) for c in df.columns])


T = D.table

# ================================================================ flagship

FLAGSHIP_MEASURES = [{"name": "revenue", "expression": "[l_extendedprice] * (1 - [l_discount])"}]
FLAGSHIP_FILTERS = [{"col": "l_quantity", "op": "gt", "val": 10}]


def flagship(spark, sf_dir):
    """Filter -> measure -> column chart (sum by return flag), value desc."""
    li = T(spark, sf_dir, "lineitem")
    spec = ChartSpec("column_chart", x_column="l_returnflag", y_column="revenue")
    out = render_visual(li, spec, FLAGSHIP_MEASURES, FLAGSHIP_FILTERS, sort_by="value_desc")
    return rounded(out.data, ["revenue"])


register("flagship_revenue_by_flag", """
select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue
from lineitem where l_quantity > 10 group by l_returnflag""")(flagship)

# ============================================================ aggregations

_AGG_SQL = {
    "sum": "coalesce(sum(l_extendedprice), 0)", "mean": "avg(l_extendedprice)",
    "median": "median(l_extendedprice)", "min": "min(l_extendedprice)",
    "max": "max(l_extendedprice)", "count": "count(l_extendedprice)",
    "std": "stddev_samp(l_extendedprice)", "var": "var_samp(l_extendedprice)",
}


def _agg_query(fn):
    def q(spark, sf_dir):
        li = T(spark, sf_dir, "lineitem")
        out = aggregate(li, AggregationConfig(("l_returnflag", "l_linestatus"),
                                              "l_extendedprice", fn))
        return out if fn == "count" else rounded(out, [f"l_extendedprice_{fn}"])
    return q


for _fn, _expr in _AGG_SQL.items():
    _e = _expr if _fn == "count" else f"round({_expr}, 4)"
    register(f"agg_{_fn}", f"""select l_returnflag, l_linestatus, {_e} as l_extendedprice_{_fn}
from lineitem group by l_returnflag, l_linestatus""")(_agg_query(_fn))


def _first_last(fn):
    def q(spark, sf_dir):
        ev = T(spark, sf_dir, "events")
        return aggregate(ev, AggregationConfig(("user_id",), "value", fn, order_column="event_id"))
    return q


register("agg_first", "select user_id, arg_min(value, event_id) as value_first from events "
                      "group by user_id")(_first_last("first"))
register("agg_last", "select user_id, arg_max(value, event_id) as value_last from events "
                     "group by user_id")(_first_last("last"))


@register("agg_null_sum", f"""
select grp, round(coalesce(sum(price), 0), 4) as price_sum, round(avg(price), 4) as price_mean,
  count(price) as price_count from {D.NULL_ORDERS_SQL} t group by grp""")
def agg_null_sum(spark, sf_dir):
    t = D.null_orders(spark, sf_dir)
    parts = [aggregate(t, AggregationConfig(("grp",), "price", fn))
             for fn in ("sum", "mean", "count")]
    out = parts[0].join(parts[1], "grp").join(parts[2], "grp")
    return rounded(out, ["price_sum", "price_mean"])


@register("agg_multi_measure", """
select l_returnflag, round(avg(l_quantity), 4) as l_quantity,
  round(avg(l_extendedprice), 4) as l_extendedprice from lineitem group by l_returnflag""")
def agg_multi_measure(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem")
    out = chart_aggregate(li, "l_returnflag", ["l_quantity", "l_extendedprice", "missing"], "mean")
    return rounded(out, ["l_quantity", "l_extendedprice"])


@register("agg_two_keys", """
select l_returnflag, l_linestatus, round(coalesce(sum(l_quantity), 0), 4) as l_quantity
from lineitem group by l_returnflag, l_linestatus""")
def agg_two_keys(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem")
    out = chart_aggregate(li, "l_returnflag", ["l_quantity"], "sum", "l_linestatus")
    return rounded(out, ["l_quantity"])


@register("agg_whole_table", """
select round(sum(o_totalprice), 4) as total, round(avg(o_totalprice), 4) as average,
  count(o_totalprice) as n, min(o_totalprice) as lowest, max(o_totalprice) as highest
from orders""")
def agg_whole_table(spark, sf_dir):
    from dashframe.operators.aggregate import chart_agg_expr
    o = T(spark, sf_dir, "orders")
    c = col("o_totalprice")
    dt = o.schema["o_totalprice"].dataType
    return o.agg(r4(chart_agg_expr(c, "sum", dt)).alias("total"),
                 r4(chart_agg_expr(c, "mean", dt)).alias("average"),
                 chart_agg_expr(c, "count", dt).alias("n"),
                 chart_agg_expr(c, "min", dt).alias("lowest"),
                 chart_agg_expr(c, "max", dt).alias("highest"))


# ================================================================ filters

PART = "select * from part"


def _typed(table, conds):
    def q(spark, sf_dir):
        return apply_filters(T(spark, sf_dir, table), conds)
    return q


def _dash(table, filters):
    def q(spark, sf_dir):
        return apply_dashboard_filters(T(spark, sf_dir, table), filters)[0]
    return q


register("filter_eq", "select * from part where p_brand = 'Brand#2'")(
    _typed("part", [FilterCondition("p_brand", "eq", "Brand#2")]))
register("filter_eq_list", "select * from part where p_type in ('ECONOMY', 'SMALL')")(
    _dash("part", [{"col": "p_type", "op": "eq", "val": ["ECONOMY", "SMALL"]}]))
register("filter_ne", "select * from lineitem where l_returnflag <> 'N'")(
    _typed("lineitem", [FilterCondition("l_returnflag", "ne", "N")]))
register("filter_gt", "select * from lineitem where l_quantity > 45")(
    _dash("lineitem", [{"col": "l_quantity", "op": "gt", "val": "45"}]))
register("filter_lt", "select * from part where p_retailprice < 950")(
    _dash("part", [{"col": "p_retailprice", "op": "lt", "val": 950}]))
register("filter_gte", "select * from part where p_size >= 40")(
    _typed("part", [FilterCondition("p_size", "gte", 40)]))
register("filter_lte", "select * from lineitem where l_discount <= 0.02 and l_tax <= 0.01")(
    _dash("lineitem", [{"col": "l_discount", "op": "lte", "val": 0.02},
                       {"col": "l_tax", "op": "lte", "val": "0.01"}]))
register("filter_regex", "select * from part where regexp_matches(p_name, '^(red|blue) ')")(
    _typed("part", [FilterCondition("p_name", "contains", "^(red|blue) ")]))
register("filter_contains", "select * from part where contains(p_name, 'ring')")(
    _dash("part", [{"col": "p_name", "op": "contains", "val": "ring"}]))
register("filter_starts", "select * from part where starts_with(p_name, 'small')")(
    _dash("part", [{"col": "p_name", "op": "starts_with", "val": "small"}]))
register("filter_ends", "select * from part where ends_with(p_name, 'bolt')")(
    _typed("part", [FilterCondition("p_name", "ends_with", "bolt")]))


def _cust(conds):
    def q(spark, sf_dir):
        return apply_filters(D.null_customers(spark, sf_dir), conds)
    return q


register("filter_in", f"select * from {D.NULL_CUSTOMERS_SQL} t "
                      "where segment in ('BUILDING', 'MACHINERY')")(
    _cust([FilterCondition("segment", "in", ["BUILDING", "MACHINERY"])]))
register("filter_not_in", f"select * from {D.NULL_CUSTOMERS_SQL} t "
                          "where segment not in ('BUILDING', 'MACHINERY')")(
    _cust([FilterCondition("segment", "not_in", ["BUILDING", "MACHINERY"])]))
register("filter_is_null", f"select * from {D.NULL_CUSTOMERS_SQL} t where segment is null")(
    _cust([FilterCondition("segment", "is_null")]))
register("filter_is_not_null", f"select * from {D.NULL_CUSTOMERS_SQL} t "
                               "where segment is not null")(
    _cust([FilterCondition("segment", "is_not_null")]))
register("filter_in_text", "select * from customer where cast(c_nationkey as varchar) in "
                           "('3', '7', '11')")(
    _dash("customer", [{"col": "c_nationkey", "op": "in", "val": " 3, 7,,11 "}]))
register("filter_int_coercion", "select * from part where p_size > 3")(
    _dash("part", [{"col": "p_size", "op": "gt", "val": "3.7"}]))
register("filter_skip_invalid", "select * from part where p_size <= 20")(
    _dash("part", [{"col": "p_size", "op": "gt", "val": "abc"},
                   {"col": "no_such_column", "op": "eq", "val": 1},
                   {"col": "p_name", "op": "gt", "val": 5},
                   {"col": "p_size", "op": "lte", "val": 20}]))


@register("search_table", """
select * from part where contains(lower(p_name), 'ring') or contains(lower(p_brand), 'ring')
  or contains(lower(p_type), 'ring')""")
def q_search_table(spark, sf_dir):
    return search_table(T(spark, sf_dir, "part"), "RiNg")


@register("search_chart", """
select c_mktsegment, round(coalesce(sum(c_acctbal), 0), 4) as c_acctbal from customer
where contains(lower(c_mktsegment), 'ure') group by c_mktsegment""")
def q_search_chart(spark, sf_dir):
    c = search_column(T(spark, sf_dir, "customer"), "c_mktsegment", "URE")
    out = column_chart(c, ChartSpec("column_chart", x_column="c_mktsegment",
                                    y_column="c_acctbal"))
    return rounded(out, ["c_acctbal"])


# =============================================================== measures

@register("measures_chain", """
select l_orderkey, l_linenumber,
  l_extendedprice * (1 - l_discount) as revenue,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) as gross from lineitem""")
def measures_chain(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem")
    out, _ = compute_measures(li, [
        {"name": "revenue", "expression": "[l_extendedprice] * (1 - [l_discount])"},
        {"name": "gross", "expression": "[revenue] * (1 + [l_tax])"}])
    return out.select("l_orderkey", "l_linenumber", "revenue", "gross")


@register("measure_divide_zero", """
select l_orderkey, l_linenumber, l_discount / nullif(l_tax, 0) as ratio
from lineitem""")
def measure_divide_zero(spark, sf_dir):
    out, _ = compute_measures(T(spark, sf_dir, "lineitem"),
                              [{"name": "ratio", "expression": "[l_discount] / [l_tax]"}])
    return out.select("l_orderkey", "l_linenumber", "ratio")


@register("measure_skip_invalid", """
select l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) as unit_price,
  -l_tax + 2 * l_discount as l_tax from lineitem""")
def measure_skip_invalid(spark, sf_dir):
    out, skipped = compute_measures(T(spark, sf_dir, "lineitem"), [
        {"name": "unit_price", "expression": "[l_extendedprice] / [l_quantity]"},
        {"name": "bad_ref", "expression": "[no_such] + 1"},
        {"name": "", "expression": "[l_tax]"},
        {"name": "blank", "expression": "  "},
        {"name": "code", "expression": "__import__('os')"},
        {"name": "syntax", "expression": "[l_tax] +* 2"},
        {"name": "text", "expression": "[l_returnflag] * 2"},
        {"name": "l_tax", "expression": "-[l_tax] + 2 * [l_discount]"}])
    return out.select("l_orderkey", "l_linenumber", "unit_price", "l_tax")


@register("measure_compose", """
select l_returnflag, round(avg(l_extendedprice / nullif(l_quantity, 0) - l_tax), 4) as unit
from lineitem group by l_returnflag""")
def measure_compose(spark, sf_dir):
    expr = compose_expression([{"op": "+", "col": "l_extendedprice"},
                               {"op": "/", "col": "l_quantity"},
                               {"op": "*", "col": ""},
                               {"op": "-", "col": "l_tax"}])
    out, _ = compute_measures(T(spark, sf_dir, "lineitem"), [{"name": "unit", "expression": expr}])
    chart = column_chart(out, ChartSpec("column_chart", x_column="l_returnflag",
                                        y_column="unit", aggregation="mean"))
    return rounded(chart, ["unit"])


# ================================================================= charts

@register("chart_column", """
select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as l_quantity,
  round(sum(l_extendedprice), 4) as l_extendedprice from lineitem
group by l_returnflag, l_linestatus""")
def chart_column(spark, sf_dir):
    spec = ChartSpec("column_chart", x_column="l_returnflag",
                     y_columns=("l_quantity", "l_extendedprice"), color_column="l_linestatus")
    return rounded(column_chart(T(spark, sf_dir, "lineitem"), spec),
                   ["l_quantity", "l_extendedprice"])


@register("chart_bar", """
select o_orderpriority, round(avg(o_totalprice), 4) as o_totalprice from orders
group by o_orderpriority""")
def chart_bar(spark, sf_dir):
    spec = ChartSpec("bar_chart", x_column="o_orderpriority", y_column="o_totalprice",
                     aggregation="mean", color_column="o_orderstatus")
    return rounded(bar_chart(T(spark, sf_dir, "orders"), spec, "value_desc"), ["o_totalprice"])


@register("chart_line", """
select o_orderdate, o_orderstatus, round(sum(o_totalprice), 4) as o_totalprice from orders
group by o_orderdate, o_orderstatus""")
def chart_line(spark, sf_dir):
    spec = ChartSpec("line_chart", x_column="o_orderdate", y_column="o_totalprice",
                     color_column="o_orderstatus")
    return rounded(line_chart(T(spark, sf_dir, "orders"), spec), ["o_totalprice"])


@register("chart_area", """
select user_id, count(value) as value from events group by user_id""")
def chart_area(spark, sf_dir):
    spec = ChartSpec("area_chart", x_column="user_id", y_column="value", aggregation="count")
    return line_chart(T(spark, sf_dir, "events"), spec)


@register("chart_pie", """
select l_linestatus, round(l_quantity, 4) as l_quantity,
  round(abs(l_quantity) / sum(abs(l_quantity)) over () * 100, 4) as share
from (select l_linestatus, sum(l_quantity) as l_quantity from lineitem group by l_linestatus)""")
def chart_pie(spark, sf_dir):
    spec = ChartSpec("pie_chart", x_column="l_linestatus", y_columns=("l_quantity",))
    return rounded(pie_chart(T(spark, sf_dir, "lineitem"), spec, "value_desc"),
                   ["l_quantity", "share"])


@register("chart_scatter", """
select l_quantity, l_extendedprice, l_returnflag from lineitem
where l_quantity is not null and l_extendedprice is not null""")
def chart_scatter(spark, sf_dir):
    spec = ChartSpec("scatter_plot", x_column="l_quantity", y_column="l_extendedprice",
                     color_column="l_returnflag")
    return scatter_plot(T(spark, sf_dir, "lineitem"), spec)


@register("chart_scatter_export", """
select l_quantity, l_extendedprice from lineitem
where l_quantity is not null and l_extendedprice is not null limit 500""")
def chart_scatter_export(spark, sf_dir):
    spec = ChartSpec("scatter_plot", x_column="l_quantity", y_column="l_extendedprice")
    return scatter_plot(T(spark, sf_dir, "lineitem"), spec, max_points=500)


@register("chart_table", """
select c_name, c_acctbal, c_mktsegment from customer
where contains(lower(c_name), 'building') or contains(lower(c_mktsegment), 'building') limit 200""")
def chart_table(spark, sf_dir):
    spec = ChartSpec("table", y_columns=("c_name", "c_acctbal", "c_mktsegment", "nope"))
    return table_view(T(spark, sf_dir, "customer"), spec, search="Building")


@register("chart_metric", """
select 'Total' as label, 'Total — l_extendedprice' as title,
  round(sum(l_extendedprice), 4) as value,
  case when abs(sum(l_extendedprice)) >= 1000000
         then format('{:.2f}', sum(l_extendedprice) / 1000000) || 'M'
       when abs(sum(l_extendedprice)) >= 1000
         then format('{:.2f}', sum(l_extendedprice) / 1000) || 'K'
       else format('{:.2f}', sum(l_extendedprice)) end as formatted
from lineitem""")
def chart_metric(spark, sf_dir):
    spec = ChartSpec("metric_card", y_column="l_extendedprice", aggregation="sum")
    return rounded(metric_card(T(spark, sf_dir, "lineitem"), spec), ["value"])


@register("chart_metric_count", """
select 'Count' as label, 'Orders' as title, cast(count(o_orderkey) as double) as value,
  format('{:,}', count(o_orderkey)) as formatted from orders""")
def chart_metric_count(spark, sf_dir):
    spec = ChartSpec("metric_card", y_column="o_orderkey", aggregation="count", title="Orders")
    return metric_card(T(spark, sf_dir, "orders"), spec)


_HIST_SQL = """
with v as (select {x} as v{extra} from {t} where {x} is not null),
s as (select min(v) as mn, max(v) as mx, least(count(distinct v), 20) as bins from v),
w as (select mn, bins, (case when mx - mn = 0 then 1.0 else (mx - mn) end)::double / bins as w
      from s),
b as (select cast(least(floor((v - mn) / w), bins - 1) as integer) as bin{extra}
      from v, w)
"""


@register("chart_histogram", _HIST_SQL.format(x="l_extendedprice", t="lineitem", extra="") + """
, g as (select cast(range as integer) as bin from range(20), w where range < bins)
select g.bin, coalesce(c.n, 0) as count, round(w.mn + g.bin * w.w, 4) as bin_start,
  round(w.mn + (g.bin + 1) * w.w, 4) as bin_end
from g cross join w left join (select bin, count(*) as n from b group by bin) c on c.bin = g.bin""")
def chart_histogram(spark, sf_dir):
    spec = ChartSpec("histogram", x_column="l_extendedprice")
    return rounded(histogram(T(spark, sf_dir, "lineitem"), spec), ["bin_start", "bin_end"])


@register("chart_histogram_split", _HIST_SQL.format(x="l_quantity", t="lineitem",
                                                    extra=", l_returnflag") + """
select b.bin, b.l_returnflag, count(*) as count, round(min(w.mn + b.bin * w.w), 4) as bin_start,
  round(min(w.mn + (b.bin + 1) * w.w), 4) as bin_end
from b cross join w group by b.bin, b.l_returnflag""")
def chart_histogram_split(spark, sf_dir):
    spec = ChartSpec("histogram", x_column="l_quantity", color_column="l_returnflag")
    return rounded(histogram(T(spark, sf_dir, "lineitem"), spec), ["bin_start", "bin_end"])


@register("chart_box", """
with r as (select l_returnflag as g, l_extendedprice as v,
  row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as i,
  count(*) over (partition by l_returnflag) as n
  from lineitem where l_returnflag is not null and l_extendedprice is not null)
select g as "group", max(n) as n, min(v) as lower,
  max(case when i = n // 4 then v end) as q1, max(case when i = n // 2 then v end) as median,
  max(case when i = (n * 3) // 4 then v end) as q3, max(v) as upper
from r group by g""")
def chart_box(spark, sf_dir):
    spec = ChartSpec("box_plot", x_column="l_returnflag", y_column="l_extendedprice")
    return box_plot(T(spark, sf_dir, "lineitem"), spec)


@register("chart_box_single", """
with r as (select value as v, row_number() over (order by value) - 1 as i,
  count(*) over () as n from events where value is not null)
select 'value' as "group", max(n) as n, min(v) as lower,
  max(case when i = n // 4 then v end) as q1, max(case when i = n // 2 then v end) as median,
  max(case when i = (n * 3) // 4 then v end) as q3, max(v) as upper from r""")
def chart_box_single(spark, sf_dir):
    return box_plot(T(spark, sf_dir, "events"), ChartSpec("box_plot", y_column="value"))


@register("chart_heatmap", """
with cells as (select event_type as x, cast(user_id as varchar) as y,
    coalesce(sum(value), 0) as value from events
    where event_type is not null and user_id is not null group by all),
xs as (select distinct x from cells order by x limit 20),
ys as (select distinct y from cells order by y limit 20)
select xs.x, ys.y, round(coalesce(c.value, 0), 4) as value,
  round((select min(value) from cells), 4) as min_value,
  round((select max(value) from cells), 4) as max_value
from xs cross join ys left join cells c on c.x = xs.x and c.y = ys.y""")
def chart_heatmap(spark, sf_dir):
    out = heatmap_cells(T(spark, sf_dir, "events"), "event_type", "user_id", "value")
    return rounded(out, ["value", "min_value", "max_value"])


@register("pivot_wide", """
select l_linestatus,
  round(sum(case when l_returnflag = 'A' then l_quantity end), 4) as "A",
  round(sum(case when l_returnflag = 'N' then l_quantity end), 4) as "N",
  round(sum(case when l_returnflag = 'R' then l_quantity end), 4) as "R"
from lineitem group by l_linestatus""")
def q_pivot_wide(spark, sf_dir):
    out = pivot_wide(T(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")
    return rounded(out, [c for c in out.columns if c != "l_linestatus"])


# ================================================================== sorts

def _sorted_chart(sort_by):
    def q(spark, sf_dir):
        spec = ChartSpec("column_chart", x_column="o_orderpriority", y_column="o_totalprice")
        agged = rounded(column_chart(T(spark, sf_dir, "orders"), spec, sort_by), ["o_totalprice"])
        return with_position(agged, chart_order(["o_orderpriority"], "o_totalprice", sort_by))
    return q


_SORT_BASE = """select o_orderpriority, round(sum(o_totalprice), 4) as o_totalprice
from orders group by o_orderpriority"""

register("sort_x_desc", f"""select *, row_number() over (order by o_orderpriority desc nulls first)
  as position from ({_SORT_BASE})""")(_sorted_chart("x_desc"))
register("sort_value_asc", f"""select *, row_number() over (order by o_totalprice asc nulls first,
  o_orderpriority asc nulls first) as position from ({_SORT_BASE})""")(_sorted_chart("value_asc"))


@register("sort_value_desc_top", """
select c_nationkey, c_acctbal, row_number() over (order by c_acctbal desc, c_nationkey) as position
from (select c_nationkey, round(sum(c_acctbal), 4) as c_acctbal from customer
      group by c_nationkey) order by c_acctbal desc, c_nationkey limit 5""")
def sort_value_desc_top(spark, sf_dir):
    spec = ChartSpec("column_chart", x_column="c_nationkey", y_column="c_acctbal")
    agged = rounded(column_chart(T(spark, sf_dir, "customer"), spec, "value_desc"), ["c_acctbal"])
    order = chart_order(["c_nationkey"], "c_acctbal", "value_desc")
    top = agged.orderBy(*order).limit(5)
    return with_position(top, order)


# ============================================================== pipelines

@register("render_visual", """
select l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue
from lineitem where l_quantity > 10 and contains(lower(l_returnflag), 'r')
group by l_returnflag, l_linestatus""")
def q_render_visual(spark, sf_dir):
    spec = ChartSpec("column_chart", x_column="l_returnflag", y_column="revenue",
                     color_column="l_linestatus")
    out = render_visual(T(spark, sf_dir, "lineitem"), spec, FLAGSHIP_MEASURES,
                        FLAGSHIP_FILTERS + [{"col": "missing", "op": "eq", "val": 1}],
                        search="R", sort_by="value_desc")
    return rounded(out.data, ["revenue"])


EXPORT_VISUALS = [
    {"slide_id": "s1", "viz_id": "v1", "config": {
        "visualization_type": "column_chart", "x_column": "l_returnflag",
        "y_columns": ["l_quantity", "revenue"], "aggregation": "sum"}},
    {"slide_id": "s1", "viz_id": "v2", "config": {
        "visualization_type": "pie_chart", "x_column": "l_linestatus",
        "y_column": "l_quantity", "aggregation": "count"}},
    {"slide_id": "s2", "viz_id": "v3", "config": {
        "visualization_type": "metric_card", "y_column": "revenue", "aggregation": "mean"}},
    {"slide_id": "s2", "viz_id": "v4", "config": {"visualization_type": "measures"}},
    {"slide_id": "s2", "viz_id": "v5", "config": {
        "visualization_type": "bar_chart", "x_column": "no_such", "y_column": "l_tax"}},
    {"slide_id": "s3", "viz_id": "v6", "config": {
        "visualization_type": "line_chart", "x_column": "l_linestatus", "y_column": "l_tax",
        "aggregation": "max"}},
]
EXPORT_FILTERS = {"v1": [{"col": "l_quantity", "op": "gte", "val": 25}],
                  "v3": [{"col": "l_returnflag", "op": "eq", "val": ["A", "R"]}]}


@register("export_bundle", """
with m as (select *, l_extendedprice * (1 - l_discount) as revenue from lineitem),
v1 as (select l_returnflag, sum(l_quantity) as l_quantity, sum(revenue) as revenue
       from m where l_quantity >= 25 group by l_returnflag),
v2 as (select l_linestatus, count(l_quantity) as n from m group by l_linestatus),
v3 as (select avg(revenue) as a from m where l_returnflag in ('A', 'R')),
v6 as (select l_linestatus, max(l_tax) as t from m group by l_linestatus)
select 's1' as slide_id, 'v1' as viz_id, 'column_chart' as viz_type, l_returnflag as label,
  null::varchar as series, 'l_quantity' as measure, round(l_quantity, 4) as value from v1
union all select 's1', 'v1', 'column_chart', l_returnflag, null, 'revenue', round(revenue, 4) from v1
union all select 's1', 'v2', 'pie_chart', l_linestatus, null, 'l_quantity', n from v2
union all select 's1', 'v2', 'pie_chart', l_linestatus, null, 'share',
  round(n / sum(n) over () * 100, 4) from v2
union all select 's2', 'v3', 'metric_card', 'Average', null, 'revenue', round(a, 4) from v3
union all select 's2', 'v5', 'bar_chart', 'unknown column ''no_such''', null, 'error', null
union all select 's3', 'v6', 'line_chart', l_linestatus, null, 'l_tax', round(t, 4) from v6""")
def export_bundle(spark, sf_dir):
    out = export_long(T(spark, sf_dir, "lineitem"), EXPORT_VISUALS, FLAGSHIP_MEASURES,
                      EXPORT_FILTERS)
    return out.withColumn("value", r4(F.col("value")))


# ============================================================== profiling

from dashframe.operators import profile as P  # noqa: E402
from dashframe.operators.transform import apply_types, rename_columns  # noqa: E402


def _union(parts):
    return "\nunion all\n".join(parts)


_NULL_COLS = ("o_orderkey", "grp", "price", "status")


@register("profile_columns", f"with t as {D.NULL_ORDERS_SQL}\n" + _union([
    f"""select '{c}' as column_name, count(*) as row_count, count(*) - count({c}) as null_count,
  count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as unique_count from t"""
    for c in _NULL_COLS]))
def profile_columns(spark, sf_dir):
    return P.column_profile(D.null_orders(spark, sf_dir))


_TYPED_SQL = """with t as (select c_mktsegment, c_name, c_acctbal,
  strftime(date '1990-01-01' + cast(c_custkey as integer), '%Y-%m-%d') as uniq_date_text,
  strftime(date '1995-01-01' + cast(c_custkey % 30 as integer), '%Y-%m-%d') as rep_date_text,
  'k' || cast((c_custkey * 2) // 3 as varchar) as mid_text,
  null::varchar as all_null, c_acctbal > 0 as flag from customer)
"""
_DATE_RX = ("^[0-9]{4}-[0-9]{2}-[0-9]{2}", "^[0-9]{2}/[0-9]{2}/[0-9]{4}",
            "^[0-9]{2}-[0-9]{2}-[0-9]{4}", "^[0-9]{4}/[0-9]{2}/[0-9]{2}")


def _type_rule_sql(c):
    dated = " or ".join(f"regexp_matches({c}, '{rx}')" for rx in _DATE_RX)
    return f"""select '{c}' as column_name, case when nn = 0 then 'unknown'
  when u / nn < 0.5 then 'categorical' when d / nn > 0.7 then 'datetime'
  when u / nn > 0.8 then 'text' else 'categorical' end as column_type
from (select count({c}) as nn,
  count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as u,
  count(case when {dated} then 1 end) as d from t)"""


@register("profile_types", _TYPED_SQL + _union(
    [_type_rule_sql(c) for c in ("c_mktsegment", "c_name", "uniq_date_text", "rep_date_text",
                                 "mid_text", "all_null")]
    + ["select 'c_acctbal', 'numeric'", "select 'flag', 'boolean'"]))
def profile_types(spark, sf_dir):
    return P.detect_types(D.typed_customers(spark, sf_dir))


_NUM_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@register("profile_numeric", _union([
    f"""select '{c}' as column_name, min({c})::double as min, max({c})::double as max,
  round(avg({c}::double), 4) as mean, round(median({c}::double), 4) as median,
  round(coalesce(stddev_samp({c}::double), 0), 4) as std, round(sum({c}::double), 4) as sum
from lineitem""" for c in _NUM_COLS]))
def profile_numeric(spark, sf_dir):
    out = P.numeric_stats(T(spark, sf_dir, "lineitem").select(*_NUM_COLS))
    return rounded(out, ["mean", "median", "std", "sum"])


_TOP_COLS = ("o_orderstatus", "o_orderpriority", "o_custkey")


@register("profile_top_values", "with f as (" + _union([
    f"select '{c}' as column_name, cast({c} as varchar) as value, count(*) as count "
    f"from orders group by {c}" for c in _TOP_COLS]) + """)
select *, row_number() over (partition by column_name order by count desc, value asc nulls first)
  as rank from f qualify rank <= 10""")
def profile_top_values(spark, sf_dir):
    return P.top_values(T(spark, sf_dir, "orders"), list(_TOP_COLS))


@register("profile_samples", f"with t as {D.NULL_CUSTOMERS_SQL},\nl as (" + _union([
    "select c_custkey as k, 'c_name' as column_name, c_name as value from t",
    "select c_custkey, 'segment', segment from t",
    "select c_custkey, 'c_nationkey', cast(c_nationkey as varchar) from t"]) + """),
f as (select *, row_number() over (partition by column_name order by k) as pos from l
      where value is not null qualify pos <= 10)
select column_name, string_agg(value, '|' order by pos) as samples,
  string_agg(case when pos <= 3 then substring(value, 1, 18) end, ' · ' order by pos) as preview
from f group by column_name""")
def profile_samples(spark, sf_dir):
    t = D.null_customers(spark, sf_dir)
    return P.sample_values(t, "c_custkey", ["c_name", "segment", "c_nationkey"])


@register("profile_dates", """
select 'o_orderdate' as column_name, cast(min(o_orderdate) as varchar) as min_date,
  cast(max(o_orderdate) as varchar) as max_date from orders""")
def profile_dates(spark, sf_dir):
    return P.datetime_range(T(spark, sf_dir, "orders"))


@register("unique_values", f"""select distinct segment from {D.NULL_CUSTOMERS_SQL} t
order by segment nulls first limit 100""")
def q_unique_values(spark, sf_dir):
    return P.unique_values(D.null_customers(spark, sf_dir), "segment")


@register("unique_values_sorted", "select distinct p_brand from part where p_brand is not null")
def q_unique_sorted(spark, sf_dir):
    return P.sorted_unique(T(spark, sf_dir, "part"), "p_brand")


@register("numeric_summary", """
select 'l_extendedprice' as column_name, min(l_extendedprice) as min, max(l_extendedprice) as max,
  round(avg(l_extendedprice), 4) as mean, round(median(l_extendedprice), 4) as median,
  round(stddev_samp(l_extendedprice), 4) as std,
  round(quantile_cont(l_extendedprice, 0.25), 4) as q1,
  round(quantile_cont(l_extendedprice, 0.75), 4) as q3 from lineitem""")
def q_numeric_summary(spark, sf_dir):
    out = P.numeric_summary(T(spark, sf_dir, "lineitem"), "l_extendedprice")
    return rounded(out, ["mean", "median", "std", "q1", "q3"])


# =============================================================== cleaning

@register("clean_numeric", """
select l_orderkey, l_linenumber, round(l_extendedprice, 2) as brl, round(l_tax, 2) as plain,
  null::double as junk, l_extendedprice as native from lineitem""")
def clean_numeric(spark, sf_dir):
    t = D.messy_lines(spark, sf_dir)
    return apply_types(t, {"brl": "numeric", "plain": "numeric", "junk": "numeric",
                           "native": "numeric"})


@register("clean_date", """
select o_orderkey, strftime(cast(o_orderdate as date), '%Y-%m-%d') as d_iso,
  strftime(cast(o_orderdate as date), '%Y-%m-%d') as d_br,
  strftime(cast(o_orderdate as date), '%Y-%m-%d') as d_dash,
  strftime(cast(o_orderdate as date), '%Y-%m-%d') as d_slash,
  null::varchar as d_bad from orders""")
def clean_date(spark, sf_dir):
    """C2 on four text shapes plus an impossible date; the parsed dates are
    printed as ISO text so the comparison does not depend on how a client
    library converts DATE values."""
    cols = ("d_iso", "d_br", "d_dash", "d_slash", "d_bad")
    typed = apply_types(D.messy_dates(spark, sf_dir), {c: "datetime" for c in cols})
    return typed.select("o_orderkey", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in cols])


@register("cast_text", """
select c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey, c_acctbal, c_mktsegment
from customer""")
def cast_text(spark, sf_dir):
    return apply_types(T(spark, sf_dir, "customer"),
                       {"c_nationkey": "categorical", "c_mktsegment": "text"})


@register("type_overrides", """
select l_orderkey, cast(l_linenumber as varchar) as l_linenumber,
  round(l_extendedprice, 2) as brl, replace(format('{:.2f}', l_tax), '.', ',') as plain,
  case l_linenumber % 3 when 0 then 'abc' when 1 then '' else '1,2,3' end as junk,
  l_extendedprice as native, cast(l_orderkey as double) as key_num from lineitem""")
def type_overrides(spark, sf_dir):
    t = D.messy_lines(spark, sf_dir).withColumn("key_num", F.col("l_orderkey"))
    return apply_types(t, {"brl": "numeric", "l_linenumber": "categorical", "junk": "boolean",
                           "nope": "numeric", "native": "numeric", "key_num": "numeric",
                           "plain": "unknown"})


@register("rename_dedupe", "select n_nationkey as key, n_name as key_1, n_regionkey as n_name "
                           "from nation")
def q_rename_dedupe(spark, sf_dir):
    return rename_columns(T(spark, sf_dir, "nation"),
                          {"n_nationkey": "key", "n_name": "key", "n_regionkey": "n_name"})


@register("rename_collision", "select n_nationkey, n_name as n_regionkey_1, n_regionkey "
                              "from nation")
def q_rename_collision(spark, sf_dir):
    return rename_columns(T(spark, sf_dir, "nation"), {"n_name": "n_regionkey"})


# ============================================================= formatting

from dashframe.functions import format as X  # noqa: E402
from dashframe.functions import text as XT  # noqa: E402


@register("format_numbers", """
select o_orderkey,
  case when abs(o_totalprice) >= 1000000 then format('{:.2f}', o_totalprice / 1000000) || 'M'
       when abs(o_totalprice) >= 1000 then format('{:.2f}', o_totalprice / 1000) || 'K'
       else format('{:.2f}', o_totalprice) end as short,
  case when abs(o_totalprice / 10) >= 1000000 then format('{:.2f}', o_totalprice / 10 / 1000000) || 'M'
       when abs(o_totalprice / 10) >= 1000 then format('{:.2f}', o_totalprice / 10 / 1000) || 'K'
       else format('{:.2f}', o_totalprice / 10) end as short_tenth,
  format('{:,}', o_custkey * 1000) as whole from orders""")
def format_numbers(spark, sf_dir):
    o = T(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.short_number(F.col("o_totalprice")).alias("short"),
                    X.short_number(F.col("o_totalprice") / 10).alias("short_tenth"),
                    X.short_number(F.col("o_custkey") * 1000, is_float=False).alias("whole"))


@register("format_labels", f"""
select o_orderkey, coalesce(format('{{:,.2f}}', price), '') as price_label,
  coalesce(cast(grp as varchar), '') as grp_label, coalesce(status, '') as status_label
from {D.NULL_ORDERS_SQL} t""")
def format_labels(spark, sf_dir):
    t = D.null_orders(spark, sf_dir)
    return t.select("o_orderkey", X.value_label(F.col("price")).alias("price_label"),
                    X.value_label(F.col("grp"), is_float=False).alias("grp_label"),
                    X.value_label(F.col("status"), is_float=False).alias("status_label"))


@register("format_dates", """
select event_id, strftime(ts, '%d/%m %H:%M') as short, strftime(ts, '%Y-%m-%d %H:%M') as iso,
  strftime(ts, '%d/%m/%Y %H:%M') as full, date_trunc('second', ts) as parsed,
  null::timestamp as unparsed from events""")
def format_dates(spark, sf_dir):
    e = T(spark, sf_dir, "events")
    iso_text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return e.select("event_id", X.format_ts(F.col("ts"), "short").alias("short"),
                    X.format_ts(F.col("ts"), "iso").alias("iso"),
                    X.format_ts(F.col("ts"), "full").alias("full"),
                    X.parse_iso(iso_text).cast("timestamp_ntz").alias("parsed"),
                    X.parse_iso(F.concat(iso_text, F.lit("x"))).cast("timestamp_ntz")
                    .alias("unparsed"))


@register("text_cut", """
select p_partkey,
  case when length(p_name) > 10 then substring(p_name, 1, 10) || '…' else p_name end as name10,
  case when length(p_brand) > 6 then substring(p_brand, 1, 6) || '…' else p_brand end as brand6,
  upper(substring(p_type, 1, 1)) || lower(substring(p_type, 2)) as type_title,
  'file_' || p_partkey || '.v2' as stem, 'file_' || p_partkey || '.v2.xlsx' as base
from part""")
def text_cut(spark, sf_dir):
    p = T(spark, sf_dir, "part")
    path = F.concat(F.lit("uploads/u1/file_"), F.col("p_partkey").cast("string"),
                    F.lit(".v2.xlsx"))
    return p.select("p_partkey", XT.cut(F.col("p_name"), 10).alias("name10"),
                    XT.cut(F.col("p_brand"), 6).alias("brand6"),
                    XT.title_of(F.col("p_type")).alias("type_title"),
                    XT.file_stem(path).alias("stem"), XT.base_name(path).alias("base"))


# ============================================================== documents

from dashframe.operators import documents as N  # noqa: E402

_DOC_ROWS = """with s as (select o_orderkey as k, o_custkey, o_orderstatus, o_orderdate,
    unnest(range(0, 3)) as i from orders),
sl as (select * from s where i <= k % 3),
v as (select *, unnest(range(0, 2)) as j from sl),
vz as (select *, (k + i * 2 + j) % 5 = 4 as nocfg,
    ['column_chart', 'table', 'measures', 'pie_chart'][(k + i + j) % 4 + 1] as kind,
    ['l_returnflag', 'l_linestatus', 'l_shipdate'][(k + j) % 3 + 1] as xcol
  from v where j < (k + i) % 3)
"""


def _docs(spark, sf_dir):
    return N.parse(D.analysis_documents(spark, sf_dir))


@register("docs_flatten", _DOC_ROWS + """
select 'an' || k as analysis_id, i + 1 as slide_pos, 's' || k || '_' || i as slide_id,
  'Slide ' || i as slide_title, j + 1 as viz_pos, 'v' || k || '_' || i || '_' || j as viz_id,
  case when nocfg then null else kind end as viz_type,
  case when nocfg then null else xcol end as x_column,
  case when nocfg then null else 'l_quantity' end as y_column,
  case when nocfg then null else 'sum' end as aggregation,
  case when nocfg then null else (k + j) % 2 = 0 end as show_values
from vz""")
def docs_flatten(spark, sf_dir):
    return N.flatten(_docs(spark, sf_dir))


@register("docs_counts", _DOC_ROWS + """
select 'an' || o_orderkey as analysis_id, o_orderkey % 3 + 1 as slide_count,
  coalesce(c.viz_count, 0) as viz_count, coalesce(c.configured_count, 0) as configured_count,
  coalesce(c.exportable_count, 0) as exportable_count,
  cast(case when o_orderstatus = 'F' then 1 else 0 end as bigint) as measure_count
from orders left join (select k, count(*) as viz_count,
    count(*) filter (where not nocfg) as configured_count,
    count(*) filter (where not nocfg and kind <> 'measures') as exportable_count
  from vz group by k) c on c.k = o_orderkey""")
def docs_counts(spark, sf_dir):
    return N.counts(_docs(spark, sf_dir))


@register("docs_history", """
select 'an' || o_orderkey as analysis_id, 'Analysis ' || o_orderkey as name,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as created_at,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as updated_at,
  o_orderkey % 3 + 1 as slide_count, 'file_' || o_custkey || '.xlsx' as file_name from orders""")
def docs_history(spark, sf_dir):
    return N.history(_docs(spark, sf_dir))


@register("docs_reorder", _DOC_ROWS + """
select 'an' || k as analysis_id,
  cast(case when i = 2 then 1 when k % 3 = 2 then 2 else 1 end as bigint) as slide_pos,
  's' || k || '_' || i as slide_id,
  cast(least((k + i) % 3, 2) as bigint) as viz_count
from sl where i in (0, 2)""")
def docs_reorder(spark, sf_dir):
    d = _docs(spark, sf_dir)
    num = F.substring(F.col("doc.id"), 3, 30)
    d = d.withColumn("order", F.array(F.concat(F.lit("s"), num, F.lit("_2")), F.lit("zz"),
                                      F.concat(F.lit("s"), num, F.lit("_0"))))
    return N.slide_rows(N.reorder_slides(d, "order"))


@register("docs_roundtrip", """
select 'an' || o_orderkey as id, 'Analysis ' || o_orderkey as name,
  o_orderkey % 3 + 1 as slides, 'uploads/' || o_custkey || '.xlsx' as file_path from orders""")
def docs_roundtrip(spark, sf_dir):
    d = _docs(spark, sf_dir)
    again = N.parse(d.select(N.to_document(F.col("doc")).alias("data")))
    return again.select(F.col("doc.id").alias("id"), F.col("doc.name").alias("name"),
                        F.size("doc.slides").cast("long").alias("slides"),
                        F.col("doc.file_path").alias("file_path"))


# ================================================================ catalog

from dashframe.operators import catalog as K  # noqa: E402


def _cat(spark, sf_dir):
    sheets = D.catalog_sheets(spark, sf_dir)
    return (D.catalog_files(spark, sf_dir), sheets, D.catalog_columns(spark, sf_dir, sheets),
            D.catalog_visualizations(spark, sf_dir))


@register("catalog_orphans", f"""select * from {D.FILES_SQL} f where not exists (
  select 1 from {D.SHEETS_SQL} s join {D.VIZ_SQL} v on v.sheet_id = s.sheet_id
  where s.file_id = f.file_id)""")
def catalog_orphans(spark, sf_dir):
    f, s, _, v = _cat(spark, sf_dir)
    return K.orphan_files(f, s, v)


@register("catalog_in_use", f"""select * from {D.FILES_SQL} f where exists (
  select 1 from {D.SHEETS_SQL} s join {D.VIZ_SQL} v on v.sheet_id = s.sheet_id
  where s.file_id = f.file_id)""")
def catalog_in_use(spark, sf_dir):
    f, s, _, v = _cat(spark, sf_dir)
    return K.files_in_use(f, s, v)


@register("catalog_dangling", f"""select * from {D.VIZ_SQL} v
where not exists (select 1 from {D.SHEETS_SQL} s where s.sheet_id = v.sheet_id)""")
def catalog_dangling(spark, sf_dir):
    _, s, _, v = _cat(spark, sf_dir)
    return K.dangling_visualizations(v, s)


@register("catalog_tree", f"""
select f.file_id, f.file_name, s.sheet_id, s.sheet_name,
  coalesce(c.column_count, 0) as column_count, c.column_names
from {D.FILES_SQL} f left join {D.SHEETS_SQL} s on s.file_id = f.file_id
left join (select sheet_id, count(*) as column_count,
  string_agg(column_name, ',' order by column_name) as column_names
  from {D.COLUMNS_SQL} group by sheet_id) c on c.sheet_id = s.sheet_id""")
def catalog_tree(spark, sf_dir):
    f, s, c, _ = _cat(spark, sf_dir)
    return K.file_tree(f, s, c)


@register("catalog_dashboards", f"""select dashboard_id, viz_type, count(*) as viz_count
from {D.VIZ_SQL} v group by dashboard_id, viz_type""")
def catalog_dashboards(spark, sf_dir):
    return K.dashboard_visuals(D.catalog_visualizations(spark, sf_dir))


@register("catalog_first_file", f"""
with fv as (select * from {D.VIZ_SQL} v
  qualify row_number() over (partition by dashboard_id order by created_at, viz_id) = 1)
select fv.dashboard_id, fv.viz_id, fv.sheet_id, s.file_id, f.file_name
from fv left join {D.SHEETS_SQL} s on s.sheet_id = fv.sheet_id
left join {D.FILES_SQL} f on f.file_id = s.file_id""")
def catalog_first_file(spark, sf_dir):
    f, s, _, v = _cat(spark, sf_dir)
    return K.first_file(v, s, f)


_DOOMED_SQL = f"""(select f.file_id from {D.FILES_SQL} f join customer c on c.c_custkey = f.user_id
  where c.c_mktsegment = 'AUTOMOBILE')"""


@register("catalog_cascade", f"""
select 'files' as table_name, count(*) as row_count from {D.FILES_SQL} f
  where file_id not in (select file_id from {_DOOMED_SQL})
union all select 'file_sheets', count(*) from {D.SHEETS_SQL} s
  where file_id not in (select file_id from {_DOOMED_SQL})
union all select 'sheet_columns', count(*) from {D.COLUMNS_SQL} c
  where sheet_id not in (select sheet_id from {D.SHEETS_SQL} s
                         where file_id in (select file_id from {_DOOMED_SQL}))
union all select 'blocking_visualizations', count(*) from {D.VIZ_SQL} v
  where sheet_id in (select sheet_id from {D.SHEETS_SQL} s
                     where file_id in (select file_id from {_DOOMED_SQL}))""")
def catalog_cascade(spark, sf_dir):
    f, s, c, v = _cat(spark, sf_dir)
    cust = T(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "AUTOMOBILE")
    doomed = f.join(cust, f["user_id"] == cust["c_custkey"], "left_semi")
    left = K.cascade_delete(f, s, c, v, doomed)
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("catalog_upsert", f"""
select coalesce(n.analysis_id, o.analysis_id) as analysis_id,
  coalesce(o.user_id, n.user_id) as user_id,
  case when n.analysis_id is not null then n.name else o.name end as name,
  case when n.analysis_id is not null then coalesce(n.storage_path, o.storage_path)
       else o.storage_path end as storage_path,
  case when n.analysis_id is not null then n.updated_at else o.updated_at end as updated_at
from {D.ANALYSES_OLD_SQL} o full outer join {D.ANALYSES_NEW_SQL} n
  on o.analysis_id = n.analysis_id""")
def catalog_upsert(spark, sf_dir):
    return K.upsert(D.analyses_old(spark, sf_dir), D.analyses_new(spark, sf_dir), "analysis_id",
                    keep_if_null=["storage_path"], keep_old=["user_id"])


@register("catalog_merge", f"""
select * from {D.ANALYSES_OLD_SQL} o
union all select * from {D.ANALYSES_NEW_SQL} n
  where analysis_id not in (select analysis_id from {D.ANALYSES_OLD_SQL} o2)""")
def catalog_merge(spark, sf_dir):
    return K.merge_missing(D.analyses_old(spark, sf_dir), D.analyses_new(spark, sf_dir),
                           "analysis_id")


_DELETE_REQ_SQL = """(select 'a' || c_custkey as analysis_id,
  cast(c_nationkey + c_custkey % 2 as bigint) as user_id
  from customer where c_mktsegment = 'BUILDING')"""


@register("catalog_delete", f"""select * from {D.ANALYSES_SQL} o where not exists (
  select 1 from {_DELETE_REQ_SQL} r where r.analysis_id = o.analysis_id and r.user_id = o.user_id)""")
def catalog_delete(spark, sf_dir):
    c = T(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    req = c.select(F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("analysis_id"),
                   (F.col("c_nationkey") + F.col("c_custkey") % 2).cast("long").alias("user_id"))
    return K.delete_by_key_and_owner(D.analyses(spark, sf_dir), req, "analysis_id", "user_id")


@register("catalog_page", f"""select *, row_number() over (partition by user_id
  order by updated_at desc, analysis_id) as rank from {D.ANALYSES_SQL} o
qualify rank > 5 and rank <= 10""")
def catalog_page(spark, sf_dir):
    return K.page_owner(D.analyses(spark, sf_dir), "user_id", "updated_at", "analysis_id",
                        limit=5, offset=5)


@register("catalog_search", f"""select *, row_number() over (partition by user_id
  order by updated_at desc, analysis_id) as rank from {D.ANALYSES_SQL} o
where contains(lower(name), 'mer#00000012') qualify rank <= 10""")
def catalog_search(spark, sf_dir):
    hits = K.search_names(D.analyses(spark, sf_dir), "name", "MER#00000012")
    return K.page_owner(hits, "user_id", "updated_at", "analysis_id", limit=10)


@register("catalog_search_literal", f"""select * from {D.ANALYSES_SQL} o
where contains(lower(name), 'r#0') or contains(lower(name), 'r_0') or contains(lower(name), '#%')""")
def catalog_search_literal(spark, sf_dir):
    a = D.analyses(spark, sf_dir)
    # Wildcard signs are literal: only the first of the three finds rows.
    return K.search_names(a, "name", "R#0").unionByName(K.search_names(a, "name", "r_0")) \
        .unionByName(K.search_names(a, "name", "#%"))


@register("catalog_lookup", """select * from customer where lower(c_name) in (
  select lower(upper(c_name)) from customer where c_mktsegment = 'MACHINERY')""")
def catalog_lookup(spark, sf_dir):
    c = T(spark, sf_dir, "customer")
    wanted = c.where(F.col("c_mktsegment") == "MACHINERY").select(F.upper("c_name").alias("q"))
    return K.lookup_ci(c, "c_name", wanted, "q")


@register("catalog_recent", f"""select *, row_number() over (partition by user_id
  order by updated_at desc, analysis_id) as rank from {D.ANALYSES_SQL} o qualify rank <= 8""")
def catalog_recent(spark, sf_dir):
    return K.recent(D.analyses(spark, sf_dir), "user_id", "updated_at", "analysis_id", 8)


def _now():
    return F.lit(D.SESSION_NOW).cast("timestamp_ntz")


@register("latest_per_owner", f"""select * from {D.SESSIONS_SQL} s
where expires_at > timestamp '{D.SESSION_NOW}'
qualify row_number() over (partition by user_id order by last_activity desc, session_id desc) = 1""")
def latest_per_owner(spark, sf_dir):
    return K.latest_per_owner(D.sessions(spark, sf_dir), _now())


@register("drop_expired", f"""select * from {D.SESSIONS_SQL} s
where expires_at > timestamp '{D.SESSION_NOW}'""")
def drop_expired(spark, sf_dir):
    return K.unexpired(D.sessions(spark, sf_dir), _now())


@register("drop_expired_count", f"""select count(*) filter (where expires_at <= timestamp
  '{D.SESSION_NOW}') as removed, count(*) filter (where expires_at > timestamp
  '{D.SESSION_NOW}') as remaining from {D.SESSIONS_SQL} s""")
def drop_expired_count(spark, sf_dir):
    s = D.sessions(spark, sf_dir)
    live = F.col("expires_at") > _now()
    return s.agg(F.count_if(~live).alias("removed"), F.count_if(live).alias("remaining"))


@register("count_per_owner", f"""select user_id, count(*) as row_count,
  (select count(*) from {D.ANALYSES_SQL} o2) as total_rows
from {D.ANALYSES_SQL} o group by user_id""")
def count_per_owner(spark, sf_dir):
    return K.count_per_owner(D.analyses(spark, sf_dir), "user_id")


# ================================================================= ingest

from dashframe.session import shared_dir  # noqa: E402
from dashframe.sources import tables as S  # noqa: E402
from dashframe.sources import workbook as W  # noqa: E402


@register("ingest_csv", "select * from customer")
def ingest_csv(spark, sf_dir):
    """Customer written as CSV to the shared folder, read back with the
    declared schema."""
    c = T(spark, sf_dir, "customer")
    target = shared_dir(spark, "ingest-csv")
    c.write.mode("overwrite").option("header", "true").csv(target)
    return S.read_csv(spark, target, c.schema)


def _customer_books(spark, sf_dir):
    """Customer as workbooks, parsed once into the shared store: the Python
    parse is the expensive step, and the widening reads the cells twice."""
    c = T(spark, sf_dir, "customer")
    return S.store(W.workbook_cells(W.frame_to_workbooks(c, "c_mktsegment")), "workbook-cells")


@register("ingest_workbooks", """
select cast(c_custkey as double) as c_custkey, c_name, cast(c_nationkey as double) as c_nationkey,
  c_acctbal, c_mktsegment as sheet_name from customer""")
def ingest_workbooks(spark, sf_dir):
    """S1-S3 + C4: customer as workbooks (one per partition, one sheet per
    segment), read back cell by cell, widened by header and typed."""
    from dashframe.operators.transform import apply_types
    wide = W.sheet_table(_customer_books(spark, sf_dir), all_sheets=True)
    typed = apply_types(wide, {"c_custkey": "numeric", "c_nationkey": "numeric",
                               "c_acctbal": "numeric"})
    return typed.drop("path")


@register("sheet_catalog", """
select c_mktsegment as sheet_name, h.column_name, h.data_type, count(*) as row_count
from customer, (values ('c_custkey', 'Int64'), ('c_name', 'String'), ('c_nationkey', 'Int64'),
  ('c_acctbal', 'Float64')) h(column_name, data_type)
group by c_mktsegment, h.column_name, h.data_type""")
def sheet_catalog(spark, sf_dir):
    """Per sheet name, its columns, their storage types and data rows
    (summed over the files that hold the sheet)."""
    cat = W.sheet_catalog(_customer_books(spark, sf_dir))
    return cat.groupBy("sheet_name", "column_name").agg(
        F.first("data_type").alias("data_type"), F.sum("row_count").alias("row_count"))


# ============================================================== streaming

@register("stream_refresh", """
select l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue,
  round(sum(l_quantity), 4) as l_quantity
from lineitem where l_quantity > 10 group by l_returnflag, l_linestatus""")
def stream_refresh(spark, sf_dir):
    """The flagship chart kept by a file stream over the lineitem folder."""
    from dashframe.streaming.refresh import refresh_once
    schema = T(spark, sf_dir, "lineitem").schema
    spec = ChartSpec("column_chart", x_column="l_returnflag", color_column="l_linestatus",
                     y_columns=("revenue", "l_quantity"))
    out = refresh_once(spark, sf_dir, schema, spec, FLAGSHIP_MEASURES, FLAGSHIP_FILTERS,
                       glob="lineitem.parquet")
    return rounded(out, ["revenue", "l_quantity"])


# ===================================================== more profile/ingest

@register("profile_preview", _union([
    f"""select '{c}' as column_name, min({c})::double as min, max({c})::double as max,
  round(avg({c}::double), 4) as mean from orders""" for c in ("o_orderkey", "o_custkey",
                                                               "o_totalprice")]))
def profile_preview(spark, sf_dir):
    return rounded(P.preview_stats(T(spark, sf_dir, "orders")), ["mean"])


@register("chart_generic", """
select o_orderpriority, round(var_samp(o_totalprice), 4) as o_totalprice_var from orders
group by o_orderpriority""")
def chart_generic(spark, sf_dir):
    from dashframe.operators.charts import generic_payload
    spec = ChartSpec("line_chart", x_column="o_orderpriority", y_column="o_totalprice",
                     aggregation="var")
    return rounded(generic_payload(T(spark, sf_dir, "orders"), spec), ["o_totalprice_var"])


@register("ingest_pipeline", """
select l_orderkey::double as l_orderkey, cast(l_linenumber as varchar) as l_linenumber,
  round(l_extendedprice, 2) as brl, round(l_tax, 2) as plain,
  case l_linenumber % 3 when 0 then 'abc' when 1 then '' else '1,2,3' end as junk,
  l_extendedprice as native from lineitem""")
def ingest_pipeline(spark, sf_dir):
    """L3 on messy text: detected types (text stays text), the user marks the
    money columns numeric and the line number categorical; stored, read back."""
    from dashframe.plans.ingest import ingest
    got = ingest(D.messy_lines(spark, sf_dir), "ingest-lines",
                 {"brl": "numeric", "plain": "numeric", "l_linenumber": "categorical"})
    return got.table


# A re-upload: every file uploaded from 1999 on comes back renamed, resized and
# as another user's, small ones without a path; first sheets renamed, columns
# retyped; files, sheets and columns under negated ids are new.
_REUPLOAD_SQL = f"""nf as (select file_id, -user_id as user_id, file_name || '_v2' as file_name,
    case when file_size_kb < 100000 then null else storage_path || '.v2' end as storage_path,
    file_size_kb + 1 as file_size_kb, uploaded_at + interval 1 day as uploaded_at
  from {D.FILES_SQL} f where uploaded_at >= timestamp '1999-01-01'
  union all select -file_id, user_id, file_name || '_new', storage_path, file_size_kb, uploaded_at
  from {D.FILES_SQL} f where file_id % 10 = 0),
ns as (select sheet_id, -file_id as file_id, sheet_name || ' (2)' as sheet_name from {D.SHEETS_SQL} s
    where sheet_name = 'Sheet1'
  union all select -sheet_id, -file_id, sheet_name from {D.SHEETS_SQL} s where file_id % 10 = 0),
nc as (select column_id, -sheet_id as sheet_id, upper(column_name) as column_name, 'Int64' as data_type
    from {D.COLUMNS_SQL} c where column_name = 'l_tax'
  union all select -column_id, -sheet_id, column_name, data_type from {D.COLUMNS_SQL} c where sheet_id % 10 = 0)"""


def _reupload(spark, sf_dir):
    f, s, c, _ = _cat(spark, sf_dir)
    recent = F.col("uploaded_at") >= F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    size = F.col("file_size_kb")
    nf = f.where(recent).select(
        "file_id", (-F.col("user_id")).alias("user_id"), F.concat("file_name", F.lit("_v2")).alias("file_name"),
        F.when(size >= 100000, F.concat("storage_path", F.lit(".v2"))).alias("storage_path"),
        (size + 1).alias("file_size_kb"), (F.col("uploaded_at") + F.expr("interval 1 day")).alias("uploaded_at"))
    nf = nf.unionByName(f.where("file_id % 10 = 0").select(
        (-F.col("file_id")).alias("file_id"), "user_id", F.concat("file_name", F.lit("_new")).alias("file_name"),
        "storage_path", "file_size_kb", "uploaded_at"))
    ns = s.where("sheet_name = 'Sheet1'").select("sheet_id", (-F.col("file_id")).alias("file_id"), F.concat(
        "sheet_name", F.lit(" (2)")).alias("sheet_name")).unionByName(s.where("file_id % 10 = 0").select(
            (-F.col("sheet_id")).alias("sheet_id"), (-F.col("file_id")).alias("file_id"), "sheet_name"))
    nc = c.where("column_name = 'l_tax'").select(
        "column_id", (-F.col("sheet_id")).alias("sheet_id"), F.upper("column_name").alias("column_name"),
        F.lit("Int64").alias("data_type")).unionByName(c.where("sheet_id % 10 = 0").select(
            (-F.col("column_id")).alias("column_id"), (-F.col("sheet_id")).alias("sheet_id"), "column_name",
            "data_type"))
    return K.save_files(f, s, c, nf, ns, nc)


@register("catalog_upsert_files", f"""
with {_REUPLOAD_SQL}
select coalesce(n.file_id, o.file_id) as file_id, coalesce(o.user_id, n.user_id) as user_id,
  case when n.file_id is not null then n.file_name else o.file_name end as file_name,
  case when n.file_id is not null then n.storage_path else o.storage_path end as storage_path,
  case when n.file_id is not null then n.file_size_kb else o.file_size_kb end as file_size_kb,
  coalesce(o.uploaded_at, n.uploaded_at) as uploaded_at
from {D.FILES_SQL} o full outer join nf n on o.file_id = n.file_id""")
def catalog_upsert_files(spark, sf_dir):
    """The files after a batch of uploads; owner and upload time stay, and
    a path may be emptied."""
    return _reupload(spark, sf_dir)["files"]


@register("catalog_upsert_sheets", f"""
with {_REUPLOAD_SQL}
select coalesce(n.sheet_id, o.sheet_id) as sheet_id, coalesce(o.file_id, n.file_id) as file_id,
  coalesce(n.sheet_name, o.sheet_name) as sheet_name
from {D.SHEETS_SQL} o full outer join ns n on o.sheet_id = n.sheet_id""")
def catalog_upsert_sheets(spark, sf_dir):
    """Its sheets; a known one takes the new name and stays in its file."""
    return _reupload(spark, sf_dir)["file_sheets"]


@register("catalog_upsert_columns", f"""
with {_REUPLOAD_SQL}
select coalesce(n.column_id, o.column_id) as column_id, coalesce(o.sheet_id, n.sheet_id) as sheet_id,
  coalesce(n.column_name, o.column_name) as column_name, coalesce(n.data_type, o.data_type) as data_type
from {D.COLUMNS_SQL} o full outer join nc n on o.column_id = n.column_id""")
def catalog_upsert_columns(spark, sf_dir):
    """And their columns, likewise."""
    return _reupload(spark, sf_dir)["sheet_columns"]


@register("preview_rows", """
select * from orders limit 10""")
def preview_rows(spark, sf_dir):
    from dashframe.operators.order import preview
    return preview(T(spark, sf_dir, "orders"))


@register("users_page", """
select * from (select c_custkey as user_id, c_name as username,
    lower(c_name) || '@example.com' as email,
    row_number() over (order by c_custkey desc) as position from customer)
where position > 100 and position <= 200""")
def users_page(spark, sf_dir):
    """R9 over a whole table: users newest first (highest key), page 2 of 100."""
    from dashframe.operators.order import page
    c = T(spark, sf_dir, "customer")
    users = c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
                     F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"))
    return page(users, [F.col("user_id").desc()], limit=100, offset=100)


@register("chart_value_labels", """
select o_orderpriority, round(sum(o_totalprice), 4) as o_totalprice,
  format('{:,.2f}', sum(o_totalprice)) as o_totalprice_label from orders
group by o_orderpriority""")
def chart_value_labels(spark, sf_dir):
    """G1 with show_values: each bar carries its ``1,234.50`` label."""
    from dashframe.operators.charts import chart_dataset
    spec = ChartSpec("column_chart", x_column="o_orderpriority", y_column="o_totalprice",
                     show_values=True)
    out = chart_dataset(T(spark, sf_dir, "orders"), spec, "value_desc")
    return out.withColumn("o_totalprice", r4(F.col("o_totalprice")))


register("filter_date", "select * from orders where o_orderdate >= timestamp '1998-01-01' "
                        "and o_orderdate < timestamp '1999-06-30 12:00:00'")(
    _dash("orders", [{"col": "o_orderdate", "op": "gte", "val": "1998-01-01"},
                     {"col": "o_orderdate", "op": "lt", "val": "1999-06-30 12:00:00"}]))


@register("search_chart_numeric", """
select c_nationkey, count(c_custkey) as c_custkey from customer
where contains(lower(cast(c_nationkey as varchar)), '1') group by c_nationkey""")
def search_chart_numeric(spark, sf_dir):
    """F21 on a numeric x: the search matches the text form of the key."""
    c = search_column(T(spark, sf_dir, "customer"), "c_nationkey", "1")
    return column_chart(c, ChartSpec("column_chart", x_column="c_nationkey",
                                     y_column="c_custkey", aggregation="count"))


@register("agg_sum_int", """
select p_type, cast(coalesce(sum(p_size), 0) as bigint) as p_size_sum,
  cast(min(p_size) as integer) as p_size_min from part group by p_type""")
def agg_sum_int(spark, sf_dir):
    """A1/A4 on an integer column: the sum stays integral (BIGINT)."""
    p = T(spark, sf_dir, "part")
    s = aggregate(p, AggregationConfig(("p_type",), "p_size", "sum"))
    m = aggregate(p, AggregationConfig(("p_type",), "p_size", "min"))
    return s.join(m, "p_type")


_DOOMED_USERS_SQL = "(select c_custkey as user_id from customer where c_mktsegment = 'HOUSEHOLD')"


@register("catalog_cascade_users", f"""
with f as {D.FILES_SQL}, s as {D.SHEETS_SQL}, v as {D.VIZ_SQL},
gf as (select file_id from f where user_id in (select user_id from {_DOOMED_USERS_SQL})),
gs as (select sheet_id from s where file_id in (select file_id from gf)),
kv as (select * from v where dashboard_id not in (select user_id from {_DOOMED_USERS_SQL}))
select 'files' as table_name, count(*) as row_count from f
  where file_id not in (select file_id from gf)
union all select 'file_sheets', count(*) from s where file_id not in (select file_id from gf)
union all select 'sheet_columns', count(*) from {D.COLUMNS_SQL} c
  where sheet_id not in (select sheet_id from gs)
union all select 'visualizations', count(*) from kv
union all select 'blocking_visualizations', count(*) from kv
  where sheet_id in (select sheet_id from gs)""")
def catalog_cascade_users(spark, sf_dir):
    """J5 from users: the household-segment customers leave."""
    f, s, c, v = _cat(spark, sf_dir)
    doomed = T(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "HOUSEHOLD") \
        .select(F.col("c_custkey").alias("user_id"))
    left = K.cascade_delete_users(f, s, c, v, doomed)
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("chart_box_linear", """
select l_linestatus as "group", count(l_quantity) as n, min(l_quantity) as lower,
  round(quantile_cont(l_quantity, 0.25), 4) as q1, round(quantile_cont(l_quantity, 0.5), 4)
    as median, round(quantile_cont(l_quantity, 0.75), 4) as q3, max(l_quantity) as upper
from lineitem where l_linestatus is not null and l_quantity is not null group by l_linestatus""")
def chart_box_linear(spark, sf_dir):
    """G9 with interpolated quartiles (the interactive plot's rule)."""
    spec = ChartSpec("box_plot", x_column="l_linestatus", y_column="l_quantity")
    out = box_plot(T(spark, sf_dir, "lineitem"), spec, method="linear")
    return rounded(out, ["q1", "median", "q3"])


# ========================================== whole-table and edge-case queries

from dashframe.operators.charts import chart_dataset, heatmap_all  # noqa: E402
from dashframe.operators.order import page  # noqa: E402
from dashframe.plans.dashboard import write_bundle  # noqa: E402


@register("orders_page", """
select *, row_number() over (order by o_orderkey) as position from orders
qualify position > (select count(*) // 2 from orders) and position <= (select count(*) // 2 from orders) + 100""")
def orders_page(spark, sf_dir):
    """R9 with a deep offset: a page from the middle of the table."""
    o = T(spark, sf_dir, "orders")
    return page(o, [F.col("o_orderkey").asc()], limit=100, offset=o.count() // 2)


@register("orders_page_indexed", """
select *, row_number() over (order by o_totalprice desc, o_orderkey) as position from orders
qualify position > (select count(*) // 2 from orders) and position <= (select count(*) // 2 from orders) + 100""")
def orders_page_indexed(spark, sf_dir):
    """R9 by a rank index: the middle page reads the blocks that hold it."""
    index = RankIndex.build(T(spark, sf_dir, "orders"),
                            [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], block_rows=1000)
    return index.page(100, index.total() // 2)


@register("agg_first_row_order", """
with t as (select o_orderpriority as p, o_custkey as v, row_number() over () as i from orders)
select p, arg_min(v, i) as v_first from t group by p""")
def agg_first_row_order(spark, sf_dir):
    """A9 without an order column: the first row as the files hold them."""
    rows = T(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("v"))
    return aggregate(rows, AggregationConfig(("p",), "v", "first"))


@register("agg_last_row_order", """
with t as (select o_orderpriority as p, o_custkey as v, row_number() over () as i from orders)
select p, arg_max(v, i) as v_last from t group by p""")
def agg_last_row_order(spark, sf_dir):
    """A10 likewise."""
    rows = T(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("v"))
    return aggregate(rows, AggregationConfig(("p",), "v", "last"))


@register("profile_samples_row_order", """
with t as (select *, row_number() over () as i from customer),
l as (select i, 'c_name' as column_name, c_name as value from t union all
      select i, 'c_mktsegment', case when c_custkey % 5 = 0 then null else c_mktsegment end from t),
f as (select *, row_number() over (partition by column_name order by i) as pos from l
      where value is not null qualify pos <= 10)
select column_name, string_agg(value, '|' order by pos) as samples,
  string_agg(case when pos <= 3 then substring(value, 1, 18) end, ' · ' order by pos) as preview
from f group by column_name""")
def profile_samples_row_order(spark, sf_dir):
    """P7/P8 in the files' own order."""
    c = T(spark, sf_dir, "customer")
    return P.sample_values(c.select("c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
                                    .alias("c_mktsegment")))


@register("orders_position", """
select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as position from orders""")
def orders_position(spark, sf_dir):
    """A global position for every row."""
    o = T(spark, sf_dir, "orders")
    return with_position(o, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]) \
        .select("o_orderkey", "position")


@register("profile_preview_all", _union([
    f"""select '{c}' as column_name, min({c})::double as min, max({c})::double as max,
  round(avg({c}::double), 4) as mean from lineitem""" for c in (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax")]))
def profile_preview_all(spark, sf_dir):
    return rounded(P.preview_stats(T(spark, sf_dir, "lineitem")), ["mean"])


_HEAT_SQL = """
with cells as (select event_type as x, cast(user_id as varchar) as y, {fn}(value) as value from events
    where event_type is not null and user_id is not null group by all)
select x, y, round(value, 8) as value, round((select min(value) from cells), 8) as min_value,
  round((select max(value) from cells), 8) as max_value from cells"""


@register("chart_heatmap_mean", _HEAT_SQL.format(fn="avg"))
def chart_heatmap_mean(spark, sf_dir):
    spec = ChartSpec("heatmap", x_column="event_type", y_column="user_id", color_column="value",
                     aggregation="mean")
    out = chart_dataset(T(spark, sf_dir, "events"), spec)
    return out.select("x", "y", *[F.round(c, 8).alias(c) for c in ("value", "min_value", "max_value")])


@register("chart_heatmap_all", _HEAT_SQL.format(fn="sum"))
def chart_heatmap_all(spark, sf_dir):
    out = heatmap_all(T(spark, sf_dir, "events"), "event_type", "user_id", "value")
    return out.select("x", "y", *[F.round(c, 8).alias(c) for c in ("value", "min_value", "max_value")])


@register("chart_box_color", """
with r as (select l_returnflag as g, l_linestatus as s, l_extendedprice as v,
  row_number() over (partition by l_returnflag, l_linestatus order by l_extendedprice) - 1 as i,
  count(*) over (partition by l_returnflag, l_linestatus) as n from lineitem)
select g as "group", s as series, max(n) as n, min(v) as lower,
  max(case when i = n // 4 then v end) as q1, max(case when i = n // 2 then v end) as median,
  max(case when i = (n * 3) // 4 then v end) as q3, max(v) as upper
from r group by g, s""")
def chart_box_color(spark, sf_dir):
    spec = ChartSpec("box_plot", x_column="l_returnflag", y_column="l_extendedprice",
                     color_column="l_linestatus")
    return chart_dataset(T(spark, sf_dir, "lineitem"), spec)


register("filter_bad_date", "select * from orders where o_totalprice > 1000")(
    _dash("orders", [{"col": "o_orderdate", "op": "gte", "val": "not a date"},
                     {"col": "o_totalprice", "op": "gt", "val": 1000}]))


@register("chart_line_labels", """
select o_orderpriority, round(sum(o_totalprice), 4) as o_totalprice,
  regexp_replace(cast(cast(round(sum(o_totalprice), 2) as decimal(38,2)) as varchar), '(\\.\\d)0$', '\\1')
    as o_totalprice_label from orders group by o_orderpriority""")
def chart_line_labels(spark, sf_dir):
    """G3 with show_values: large sums print in full."""
    spec = ChartSpec("line_chart", x_column="o_orderpriority", y_column="o_totalprice",
                     show_values=True)
    out = chart_dataset(T(spark, sf_dir, "orders"), spec)
    return out.withColumn("o_totalprice", r4(F.col("o_totalprice")))


@register("measure_overflow", """
select o_orderkey, case when o_orderkey::hugeint * 4000000000000000000 between -9223372036854775808
  and 9223372036854775807 then o_orderkey * 4000000000000000000 end as big from orders""")
def measure_overflow(spark, sf_dir):
    out, _ = compute_measures(T(spark, sf_dir, "orders"), [
        {"name": "big", "expression": "[o_orderkey] * 4000000000000000000"}])
    return out.select("o_orderkey", "big")


@register("measure_constant_skipped", "select o_orderkey, o_totalprice from orders")
def measure_constant_skipped(spark, sf_dir):
    """An expression that names no column is no measure."""
    out, skipped = compute_measures(T(spark, sf_dir, "orders"), [{"name": "five", "expression": "5"}])
    assert skipped == ["five"]
    return out.select("o_orderkey", "o_totalprice")


BUNDLE_VISUALS = EXPORT_VISUALS + [
    {"slide_id": "s3", "viz_id": "v7", "config": {
        "visualization_type": "table", "y_columns": ["l_orderkey", "l_tax"]}},
    {"slide_id": "s3", "viz_id": "v8", "config": {
        "visualization_type": "scatter_plot", "x_column": "l_quantity", "y_column": "l_tax"}},
    {"slide_id": "s4", "viz_id": "v9", "config": {
        "visualization_type": "histogram", "x_column": "l_shipdate"}},
    {"slide_id": "s4", "viz_id": "v10", "config": {
        "visualization_type": "heatmap", "x_column": "l_returnflag", "y_column": "l_linestatus",
        "color_column": "l_tax", "aggregation": "mean"}},
    {"slide_id": "s4", "viz_id": "v11", "config": {
        "visualization_type": "box_plot", "x_column": "l_returnflag", "y_column": "l_tax"}},
]


@register("export_manifest", """
with m as (select 's1' as slide_id, 'v1' as viz_id, 'column_chart' as viz_type,
  (select count(distinct l_returnflag) from lineitem where l_quantity >= 25) as "rows", 'ok' as status
union all select 's1', 'v2', 'pie_chart', (select count(distinct l_linestatus) from lineitem), 'ok'
union all select 's2', 'v3', 'metric_card', 1, 'ok'
union all select 's2', 'v5', 'bar_chart', null, 'failed'
union all select 's3', 'v6', 'line_chart', (select count(distinct l_linestatus) from lineitem), 'ok'
union all select 's3', 'v7', 'table', (select least(count(*), 100) from lineitem), 'ok'
union all select 's3', 'v8', 'scatter_plot', (select count(*) from lineitem), 'ok'
union all select 's4', 'v9', 'histogram', 20, 'ok'
union all select 's4', 'v10', 'heatmap',
  (select count(*) from (select distinct l_returnflag, l_linestatus from lineitem)), 'ok'
union all select 's4', 'v11', 'box_plot', (select count(distinct l_returnflag) from lineitem), 'ok')
select *, case when viz_id = 'v3' then 1 else 0 end as skipped from m""")
def export_manifest(spark, sf_dir):
    """The bundle is written and its manifest read back."""
    filters = {**EXPORT_FILTERS, "v3": EXPORT_FILTERS["v3"] + [{"col": "no_such", "op": "eq", "val": 1}]}
    man = write_bundle(T(spark, sf_dir, "lineitem"), BUNDLE_VISUALS, shared_dir(spark, "bundle"),
                       FLAGSHIP_MEASURES, filters)
    return man.select("slide_id", "viz_id", "viz_type", "rows", "status",
                      F.size("skipped_filters").alias("skipped"))


@register("docs_defaults", """
select o_orderkey as id, 'New Analysis' as name, 'Untitled Slide' as title, 'single' as layout,
  '#FFFFFF' as background_color, '' as comment, 400.0::double as width, 'sum' as aggregation,
  true as show_legend, false as show_values, 0 as y_columns, 0 as measures from orders""")
def docs_defaults(spark, sf_dir):
    """What a document with hardly a key means."""
    text = F.concat(F.lit('{"id": "'), F.col("o_orderkey").cast("string"), F.lit(
        '", "slides": [{"visualizations": [{"config": {"visualization_type": "table"}}]}]}'))
    doc, slide = "doc", F.col("doc.slides")[0]
    viz = slide["visualizations"][0]
    return N.parse(T(spark, sf_dir, "orders").select(text.alias("data"))).select(
        F.col("doc.id").cast("long").alias("id"), F.col("doc.name").alias("name"),
        slide["title"].alias("title"), slide["layout"].alias("layout"),
        slide["background_color"].alias("background_color"), viz["comment"].alias("comment"),
        viz["size"]["width"].alias("width"), viz["config"]["aggregation"].alias("aggregation"),
        viz["config"]["show_legend"].alias("show_legend"),
        viz["config"]["show_values"].alias("show_values"),
        F.size(viz["config"]["y_columns"]).alias("y_columns"), F.size("doc.measures").alias("measures"))


@register("docs_roundtrip_whole", """
select 'an' || o_orderkey as id, true as same from orders""")
def docs_roundtrip_whole(spark, sf_dir):
    """Writing and reading a document again changes nothing in it."""
    d = _docs(spark, sf_dir).select("doc", N.to_document(F.col("doc")).alias("data"))
    again = N.parse(d.withColumnRenamed("doc", "before"))
    return again.select(F.col("doc.id").alias("id"),
                        (N.to_document(F.col("doc")) == F.col("data")).alias("same"))


@register("format_rounding", """
select o_orderkey, round_even(o_totalprice, 1) as even, abs(o_custkey - 100) as magnitude from orders""")
def format_rounding(spark, sf_dir):
    """Half-even rounding and absolute values."""
    return T(spark, sf_dir, "orders").select(
        "o_orderkey", F.bround("o_totalprice", 1).alias("even"),
        F.abs(F.col("o_custkey") - 100).alias("magnitude"))


@register("table_records", """
select count(*) as n, count(distinct n_nationkey) as keys from nation""")
def table_records(spark, sf_dir):
    """Rows as records and back."""
    nation = T(spark, sf_dir, "nation")
    back = S.records(nation).select(F.from_json("record", nation.schema).alias("r"))
    return back.agg(F.count("r").alias("n"), F.count_distinct("r.n_nationkey").alias("keys"))


@register("store_reload", "select * from customer")
def store_reload(spark, sf_dir):
    """The stored copy of a table, read by its path."""
    path = shared_dir(spark, "reload")
    S.store(T(spark, sf_dir, "customer"), "customer", path)
    return S.read_table(spark, path)


_COUNTS = """select '{c}' as column_name, count(*) as row_count,
  count(*) filter (where {c} is null) as null_count,
  count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as unique_count, """


@register("ingest_profile", _union([
    _COUNTS.format(c=c) + f"""'numeric' as column_type, min({c})::double as min, max({c})::double as max,
  round(avg({c}::double), 4) as mean, round(stddev_samp({c}::double), 4) as std,
  round(sum({c}::double), 2) as sum from customer""" for c in ("c_custkey", "c_nationkey", "c_acctbal")]
    + [_COUNTS.format(c=c) + f"""case when count(distinct {c}) > 0.8 * count({c}) then 'text' else 'categorical' end,
  null, null, null, null, null from customer""" for c in ("c_name", "c_mktsegment")]))
def ingest_profile(spark, sf_dir):
    """L3: what an upload's profile says of every column."""
    from dashframe.plans.ingest import ingest
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    got = ingest(T(spark, sf_dir, "customer").select(*names), "profiled", keep=False).profile
    return got.select("column_name", "row_count", "null_count", "unique_count", "column_type", "min", "max",
                      r4(F.col("mean")).alias("mean"), r4(F.col("std")).alias("std"),
                      F.round("sum", 2).alias("sum"))


@register("catalog_files_nested", f"""
with c as (select sheet_id, list({{'column_id': column_id, 'column_name': column_name,
    'data_type': data_type}} order by column_id) as cols from {D.COLUMNS_SQL} group by sheet_id),
s as (select file_id, list({{'sheet_id': s.sheet_id, 'sheet_name': sheet_name, 'columns': cols}}
    order by s.sheet_id) as sheets from {D.SHEETS_SQL} s join c on c.sheet_id = s.sheet_id group by file_id)
select f.file_id, file_name, coalesce(cast(to_json(sheets) as varchar), '[]') as sheets
from {D.FILES_SQL} f left join s on s.file_id = f.file_id""")
def catalog_files_nested(spark, sf_dir):
    files, sheets, columns, _ = _cat(spark, sf_dir)
    return K.file_documents(files, sheets, columns).select("file_id", "file_name",
                                                           F.to_json("sheets").alias("sheets"))


@register("catalog_dashboards_nested", f"""
select dashboard_id, count(*) as visuals, string_agg(viz_id || ':' || viz_type, ',' order by created_at, viz_id)
  as listed from {D.VIZ_SQL} group by dashboard_id""")
def catalog_dashboards_nested(spark, sf_dir):
    viz = _cat(spark, sf_dir)[3]
    return K.dashboard_documents(viz).select(
        "dashboard_id", F.size("visualizations").cast("long").alias("visuals"),
        F.array_join(F.transform("visualizations", lambda v: F.concat(
            v["viz_id"].cast("string"), F.lit(":"), v["viz_type"])), ",").alias("listed"))


# ------------------------------------------------- large, infinite, not a number

@register("filter_large_value", """
select count(*) as n from lineitem where l_orderkey < 1e30 and l_partkey <> 1e30 and l_suppkey >= -1e300""")
def filter_large_value(spark, sf_dir):
    """Values that no long holds decide a predicate, they don't end the call."""
    rows, skipped = apply_dashboard_filters(T(spark, sf_dir, "lineitem"), [
        {"col": "l_orderkey", "op": "lt", "val": 1e30}, {"col": "l_partkey", "op": "ne", "val": "1e30"},
        {"col": "l_suppkey", "op": "gte", "val": -1e300}])
    assert not skipped
    return rows.agg(F.count(F.lit(1)).alias("n"))


@register("agg_sum_large", """
with t as (select o_orderstatus as g, case o_orderstatus when 'O' then 9223372036854775807 - o_custkey
           when 'P' then null else o_orderkey end as v from orders)
select g, case when count(v) = 0 then 0 when sum(v) > 9223372036854775807 then null
  else cast(sum(v) as bigint) end as v from t group by g""")
def agg_sum_large(spark, sf_dir):
    """A group whose sum no long holds is NULL; the others are summed."""
    v = F.when(F.col("o_orderstatus") == "O", F.lit(2 ** 63 - 1) - F.col("o_custkey")).when(
        F.col("o_orderstatus") != "P", F.col("o_orderkey"))
    return chart_aggregate(T(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("g"), v.alias("v")),
                           "g", ["v"], "sum")


def _infinite():
    return (F.when(F.col("l_linenumber") == 1, float("inf")).when(F.col("l_linenumber") == 2, float("-inf"))
            .when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_quantity")))


@register("chart_metric_nan", """
with t as (select case l_linenumber when 1 then 'inf'::double when 2 then '-inf'::double when 3 then 'nan'::double
             else l_quantity end as v from lineitem)
select 'Average' as label, case when isnan(avg(v)) then 'nan' else '?' end as formatted,
  'infM' as largest from t""")
def chart_metric_nan(spark, sf_dir):
    """The mean over a value that is no number reads ``nan``, an infinite
    maximum ``infM``."""
    rows = T(spark, sf_dir, "lineitem").withColumn("v", _infinite())
    mean = metric_card(rows, ChartSpec("metric_card", y_column="v", aggregation="mean"))
    most = metric_card(rows, ChartSpec("metric_card", y_column="v", aggregation="max"))
    return mean.select("label", "formatted", most.select("formatted").scalar().alias("largest"))


@register("chart_histogram_infinite", """
with t as (select l_quantity as v from lineitem where l_linenumber > 3),
s as (select min(v) as mn, max(v) as mx, least(20, count(distinct v)) as bins from t),
b as (select least(cast(floor((v - mn) / ((mx - mn) / bins)) as int), bins - 1) as bin, count(*) as n
      from t, s group by 1)
select cast(i as int) as bin, coalesce(n, 0) as count, round(mn + i * (mx - mn) / bins, 4) as bin_start,
  round(mn + (i + 1) * (mx - mn) / bins, 4) as bin_end,
  (select count(*) from lineitem where l_linenumber = 3) as n_nan,
  (select count(*) from lineitem where l_linenumber in (1, 2)) as n_infinite
from s, unnest(range(20)) as r(i) left join b on b.bin = i where i < bins""")
def chart_histogram_infinite(spark, sf_dir):
    """Bins span the finite values; the others are counted beside them."""
    rows = T(spark, sf_dir, "lineitem").withColumn("v", _infinite())
    left = histogram_left_out(rows, "v")
    bins = rounded(histogram(rows, ChartSpec("histogram", x_column="v")), ["bin_start", "bin_end"])
    return bins.withColumn("n_nan", left.select("n_nan").scalar()).withColumn(
        "n_infinite", left.select("n_infinite").scalar())


# ------------------------------------------------------- one scan, many visuals

def _twelve():
    def v(i, kind, fn="sum", **config):
        return {"slide_id": f"s{i // 4}", "viz_id": f"v{i}",
                "config": {"visualization_type": kind, "aggregation": fn, **config}}
    return [
        v(0, "column_chart", x_column="l_returnflag", y_columns=["l_quantity", "revenue"]),
        v(1, "column_chart", "mean", x_column="l_returnflag", y_column="l_tax", color_column="l_linestatus"),
        v(2, "bar_chart", "max", x_column="l_linenumber", y_column="l_extendedprice", color_column="l_linestatus"),
        v(3, "line_chart", "min", x_column="l_linenumber", y_column="l_discount", color_column="l_returnflag"),
        v(4, "area_chart", "count", x_column="l_shipdate", y_column="l_orderkey"),
        v(5, "pie_chart", x_column="l_linestatus", y_column="revenue"),
        v(6, "pie_chart", "count", x_column="l_suppkey", y_column="l_tax"),
        v(7, "heatmap", "mean", x_column="l_returnflag", y_column="l_linenumber", color_column="l_tax"),
        v(8, "metric_card", y_column="l_orderkey"),
        v(9, "metric_card", "mean", y_column="revenue"),
        v(10, "metric_card", "count", y_column="l_tax"),
        v(11, "line_chart", x_column="l_partkey", y_column="l_quantity")]


def _twelve_sql():
    agg = {"sum": "sum", "mean": "avg", "max": "max", "min": "min", "count": "count"}
    parts = []
    for v in _twelve():
        c = v["config"]
        kind, fn = c["visualization_type"], agg[c["aggregation"]]
        head = f"select '{v['slide_id']}' as slide_id, '{v['viz_id']}' as viz_id, '{kind}' as viz_type"
        x, series = c.get("x_column"), c.get("color_column")
        if kind == "metric_card":
            label = {"sum": "Total", "avg": "Average", "count": "Count"}[fn]
            parts.append(f"{head}, '{label}' as label, null::varchar as series, '{c['y_column']}' as measure, "
                         f"{fn}({c['y_column']}) as value from m")
            continue
        if kind == "heatmap":
            parts.append(f"{head}, cast({x} as varchar), cast({c['y_column']} as varchar), 'value', "
                         f"{fn}({series}) from m group by {x}, {c['y_column']}")
            continue
        series = series if series and kind not in ("bar_chart", "pie_chart") else None
        for y in c.get("y_columns") or [c["y_column"]]:
            text = f"cast({series} as varchar)" if series else "null"
            keys = x + (f", {series}" if series else "")
            label = f"strftime({x}, '%Y-%m-%d %H:%M:%S')" if x == "l_shipdate" else f"cast({x} as varchar)"
            parts.append(f"{head}, {label}, {text}, '{y}', {fn}({y}) from m group by {keys}")
            if kind == "pie_chart":
                parts.append(f"{head}, {label}, {text}, 'share', abs({fn}({y})) / sum(abs({fn}({y}))) over () * 100 "
                             f"from m group by {keys}")
    return ("with m as (select *, l_extendedprice * (1 - l_discount) as revenue from lineitem where l_quantity > 5),\n"
            "u(slide_id, viz_id, viz_type, label, series, measure, value) as (" + "\nunion all ".join(parts) + ")\n"
            "select slide_id, viz_id, viz_type, label, series, measure, round(cast(value as double), 4) as value from u")


@register("export_shared_scan", _twelve_sql())
def export_shared_scan(spark, sf_dir):
    """L2: twelve visuals over one filter, answered by one scan."""
    visuals = _twelve()
    out = export_long(T(spark, sf_dir, "lineitem"), visuals, FLAGSHIP_MEASURES,
                      {v["viz_id"]: [{"col": "l_quantity", "op": "gt", "val": 5}] for v in visuals})
    return out.withColumn("value", r4(F.col("value")))

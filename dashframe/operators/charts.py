"""Chart datasets: the rows each visual draws.

``chart_dataset(df, spec, sort_by)`` dispatches on the visual type.  Every
dataset is a lazy plan; totals, heatmap axes and scales come from scalar
subqueries.  Only a histogram's range and bin count and a pivot's labels, which
shape the plan, are read by the driver.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dashframe.functions.columns import col
from dashframe.functions.format import short_number, value_label
from dashframe.operators.aggregate import chart_agg_expr, null_safe_sum
from dashframe.operators.filters import search_table
from dashframe.operators.grouping import Grouping, grouped
from dashframe.operators.order import asc, chart_order, first_rows
from dashframe.operators.quantiles import box_positions, grouped_quantiles, rank_select
from dashframe.schema import is_datetime, is_floating, is_integral, is_numeric
from dashframe.spec import (CHART_AGGREGATIONS, HEATMAP_AXIS_CAP, HISTOGRAM_MAX_BINS,
                            SCREEN_TABLE_ROWS, SORTABLE, ChartSpec, VisualizationType as V)


class ChartSpecError(ValueError):
    """The spec cannot produce a dataset (missing or unknown columns)."""


def _need(df: DataFrame, *names: str | None) -> None:
    for n in names:
        if not n:
            raise ChartSpecError("a required column is not set")
        if n not in df.columns:
            raise ChartSpecError(f"unknown column {n!r}")


# --------------------------------------------------------- category charts

def _function(spec: ChartSpec) -> str:
    return spec.aggregation if spec.aggregation in CHART_AGGREGATIONS else "sum"


def grouping_of(df: DataFrame, spec: ChartSpec) -> Grouping | None:
    """What the visual's dataset is made from, or None where that is no
    aggregate by key: G1/G2 several y by x (a series column adds a key, which
    bars ignore), G3/G4 one y by x and series, G5 one y by x, G10 one value by
    the text of x and y, G12 one value of the whole table."""
    vt, x, y, fn = spec.visualization_type, spec.x_column, spec.y_column, _function(spec)
    if vt == V.METRIC_CARD:
        _need(df, y)
        return Grouping((), (("__value", y, fn),))
    if vt == V.HEATMAP:
        value = spec.color_column or y
        _need(df, x, y, value)
        return Grouping((("x", x), ("y", y)), (("value", value, fn),), as_text=True)
    if vt in (V.COLUMN_CHART, V.BAR_CHART):
        _need(df, x)
        ys = [c for c in spec.effective_y if c in df.columns]
        if not ys:
            raise ChartSpecError("no valid y column")
    elif vt in (V.LINE_CHART, V.AREA_CHART):
        _need(df, x, y)
        ys = [y]
    elif vt == V.PIE_CHART:
        ys = [y or (spec.y_columns[0] if spec.y_columns else None)]
        _need(df, x, ys[0])
    else:
        return None
    series = spec.color_column if vt not in (V.BAR_CHART, V.PIE_CHART) else None
    keys = [k for k in dict.fromkeys((x, series)) if k in df.columns]
    return Grouping(tuple((k, k) for k in keys), tuple((c, c, fn) for c in dict.fromkeys(ys)))


def dataset_of(rows: DataFrame, spec: ChartSpec, g: Grouping, source: DataFrame, sort_by: str = "none") -> DataFrame:
    """The visual's dataset from the rows of its grouping; ``source`` is the
    table they come from, for its column types."""
    vt = spec.visualization_type
    if vt == V.METRIC_CARD:
        return _metric(rows, spec, source.schema[spec.y_column].dataType)
    if vt == V.HEATMAP:
        return _scaled(rows)
    if vt in (V.LINE_CHART, V.AREA_CHART) or vt not in SORTABLE:
        sort_by = "none"
    keys, value = [k for k, _ in g.keys], g.measures[0][0]
    if vt == V.PIE_CHART:
        rows = share_of_total(rows, value)
    rows = rows.orderBy(*chart_order(keys, value, sort_by))
    if spec.show_values and vt != V.PIE_CHART:
        rows = with_value_labels(rows, spec)
    return rows


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """|v| / sum(|v|) * 100, NULL counted as 0, zero total guarded.
    The total is a scalar subquery over the (already aggregated) rows."""
    mag = F.abs(F.coalesce(col(value).cast("double"), F.lit(0.0)))
    total = df.agg(F.coalesce(F.sum(mag), F.lit(0.0)).alias("t")).scalar()
    safe = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return df.withColumn(name, mag / safe * 100)


# ------------------------------------------------------------ raw-row charts

def scatter_plot(df, spec: ChartSpec, sort_by="none", max_points: int | None = None):
    """Raw (x, y[, color][, size]) where x and y are both present.
    ``max_points`` is the image export's cap (R6)."""
    _need(df, spec.x_column, spec.y_column)
    cols = [spec.x_column, spec.y_column]
    for extra in (spec.color_column, spec.size_column):
        if extra and extra in df.columns and extra not in cols:
            cols.append(extra)
    rows = df.where(col(spec.x_column).isNotNull() & col(spec.y_column).isNotNull())
    return first_rows(rows, max_points, cols) if max_points else rows.select(*[col(c) for c in cols])


# Above this HyperLogLog estimate the true distinct count is surely >= 20
# (relative error about 5%), so the exact count is not needed.
_SURELY_MANY = 2 * HISTOGRAM_MAX_BINS


def histogram_bins(values: DataFrame) -> tuple[float, float, int, float] | None:
    """G7 rules as numbers: (min, max, bins, width); None when no value.

    One small job reads min, max and a HyperLogLog estimate; the exact
    distinct count (needed only when fewer than 20 values could be
    distinct) runs only when the estimate is low, where it is cheap."""
    v = F.col("__v")
    row = values.agg(F.min(v).alias("mn"), F.max(v).alias("mx"),
                     F.approx_count_distinct(v).alias("approx")).first()
    if row["mn"] is None:
        return None
    if row["approx"] >= _SURELY_MANY:
        bins = HISTOGRAM_MAX_BINS
    else:
        exact = values.agg(F.count_distinct(v)).first()[0]
        bins = min(HISTOGRAM_MAX_BINS, int(exact))
    mn, mx = float(row["mn"]), float(row["mx"])
    return mn, mx, bins, ((mx - mn) or 1) / bins


def _label_counts(df: DataFrame, x: str, split: str | None) -> DataFrame:
    """A text column's histogram: one bin per value, in text order."""
    keys = [col(x).cast("string").alias("bin")] + ([col(split)] if split else [])
    rows = df.where(col(x).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return rows.orderBy(asc("bin"), *([asc(split)] if split else []))


def histogram_left_out(df: DataFrame, x: str) -> DataFrame:
    """One row: how many values of ``x`` are NULL, NaN or infinite, and so in no
    bin of its histogram."""
    v = col(x).cast("double")
    return df.agg(F.count_if(col(x).isNull()).alias("n_null"), F.count_if(F.isnan(v)).alias("n_nan"),
                  F.count_if(F.abs(v) == float("inf")).alias("n_infinite"))


def histogram(df, spec: ChartSpec, sort_by="none"):
    """G7 (G8 when a color column is set): ``min(20, distinct)`` equal-width
    bins over [min, max], last bin closed; empty bins kept (G7).  NaN and
    infinities have no bin (``histogram_left_out`` counts them)."""
    _need(df, spec.x_column)
    x = spec.x_column
    split = spec.color_column if spec.color_column in df.columns and \
        spec.color_column != x else None
    kind = df.schema[x].dataType
    if not is_numeric(kind) and not is_datetime(kind):
        return _label_counts(df, x, split)
    # Dates are binned by their seconds.
    number = col(x) if is_numeric(kind) else F.unix_micros(col(x).cast("timestamp")) / 1e6
    values = df.select(number.alias("__v"), *([col(split)] if split else [])) \
        .where(F.col("__v").isNotNull())
    if is_floating(df.schema[x].dataType):
        values = values.where(~F.isnan("__v") & (F.abs("__v") != float("inf")))
    stats = histogram_bins(values.select("__v"))
    spark = df.sparkSession
    if stats is None:
        schema = "bin int, " + (f"`{split}` string, " if split else "") + \
            "count long, bin_start double, bin_end double"
        return spark.createDataFrame([], schema)
    mn, _, bins, w = stats
    mn_c, w_c = F.lit(mn), F.lit(w)
    idx = F.least(F.floor((F.col("__v") - mn_c) / w_c), F.lit(bins - 1)).cast("int")
    keyed = values.withColumn("bin", idx)

    def _edges(frame):
        return frame.withColumn("bin_start", mn_c + F.col("bin") * w_c) \
                    .withColumn("bin_end", mn_c + (F.col("bin") + 1) * w_c)

    if split:
        counts = keyed.groupBy("bin", col(split)).agg(F.count(F.lit(1)).alias("count"))
        return _edges(counts).orderBy("bin", asc(split))
    counts = keyed.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(counts, "bin", "left").select(
        "bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    return _edges(full).orderBy("bin")


def box_plot(df, spec: ChartSpec, sort_by="none", method: str = "positional"):
    """Quartiles per x group (and series, when a colour column is
    set); NULL values and the NULL group are left out.  ``positional`` (the image export's rule): sorted values at n//4,
    n//2, 3n//4, plus first and last; ``linear``: interpolated quartiles (the
    interactive plot's rule)."""
    _need(df, spec.y_column)
    y, x, color = spec.y_column, spec.x_column, spec.color_column
    group = col(x) if x and x in df.columns else F.lit(y)
    keys = {"group": group}
    if color and color in df.columns and color != x:
        keys["series"] = col(color)
    base = df.select(*[c.alias(k) for k, c in keys.items()], col(y).alias("__y")) \
        .where(F.col("group").isNotNull())
    if method == "linear":
        q = {"lower": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "upper": 1.0}
        stats = grouped_quantiles(base, list(keys), "__y", q)
    elif method == "positional":
        stats = rank_select(base, list(keys), "__y", box_positions())
    else:
        raise ChartSpecError(f"unknown quartile method {method!r}")
    # Groups are labelled as text but ordered by their own values.
    out = stats.select(*[col(k).cast("string").alias(k) for k in keys], "n", "lower", "q1",
                       "median", "q3", "upper", *[col(k).alias(f"__{k}") for k in keys])
    return out.orderBy(*[asc(f"__{k}") for k in keys]).drop(*[f"__{k}" for k in keys])


# ------------------------------------------------------------------- heatmap

def _cells(df: DataFrame, x: str, y: str, value: Column) -> DataFrame:
    return (df.where(col(x).isNotNull() & col(y).isNotNull())
            .groupBy(col(x).cast("string").alias("x"), col(y).cast("string").alias("y"))
            .agg(value.alias("value")))


def heatmap_all(df: DataFrame, x: str, y: str, value: str, fn: str = "sum") -> DataFrame:
    """Every (x, y) pair that occurs with the spec's aggregation, and the
    scale's ends on each row."""
    fn = fn if fn in CHART_AGGREGATIONS else "sum"
    return _scaled(grouped(df, Grouping((("x", x), ("y", y)), (("value", value, fn),), as_text=True)))


def _scaled(cells: DataFrame) -> DataFrame:
    scale = cells.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"))).scalar()
    return cells.select("x", "y", "value", scale["lo"].alias("min_value"),
                        scale["hi"].alias("max_value")).orderBy("y", "x")


def heatmap_cells(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """A15, the image export's form: sum per (x, y) with NULL -> 0; axes are the
    first 20 labels of each side in text order; absent pairs read 0; every row
    also carries the min and max over all cells for the colour scale."""
    cells = _cells(df, x, y, null_safe_sum(col(value)))
    xs = cells.select("x").distinct().orderBy("x").limit(HEATMAP_AXIS_CAP) \
        .agg(F.sort_array(F.collect_list("x")).alias("a")).scalar()
    ys = cells.select("y").distinct().orderBy("y").limit(HEATMAP_AXIS_CAP) \
        .agg(F.sort_array(F.collect_list("y")).alias("a")).scalar()
    scale = cells.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"))).scalar()
    spark = df.sparkSession
    grid = (spark.range(1).select(F.explode(xs).alias("x"))
            .select("x", F.explode(ys).alias("y")))
    inside = cells.where(F.array_contains(xs, F.col("x")) & F.array_contains(ys, F.col("y")))
    return (grid.join(inside, ["x", "y"], "left")
            .select("x", "y", F.coalesce("value", F.lit(0)).alias("value"),
                    scale["lo"].alias("min_value"), scale["hi"].alias("max_value"))
            .orderBy("y", "x"))


def pivot_wide(df: DataFrame, x: str, y: str, value: str, fn: str = "sum",
               x_values: list | None = None) -> DataFrame:
    """Aggregate per (y, x) with x spread into columns (absent -> NULL).
    The x labels are the result's column names, so they are listed first."""
    if x_values is None:
        labels = df.select(col(x).alias("__x")).distinct()
        x_values = [r[0] for r in labels.orderBy(asc("__x")).collect()]
    # pivot() takes a column *name*, so x is carried under a plain alias.
    return (df.withColumn("__x", col(x)).groupBy(col(y)).pivot("__x", x_values)
            .agg(chart_agg_expr(col(value), fn, df.schema[value].dataType)).orderBy(asc(y)))


# ----------------------------------------------------------- table & metric

def table_columns(df: DataFrame, spec: ChartSpec) -> list[str]:
    """The first of three choices that names anything -- the listed
    columns, the axes and the series, the first ten of the table -- without
    names that the table lacks."""
    axes = (spec.x_column, spec.y_column)
    choice = spec.y_columns or (any(axes) and (*axes, spec.color_column)) or df.columns[:10]
    return [c for c in dict.fromkeys(choice) if c in df.columns]


def table_view(df, spec: ChartSpec, sort_by="none", search: str | None = None,
               max_rows: int = SCREEN_TABLE_ROWS):
    """Searched, projected rows, the first of them in row order."""
    cols = table_columns(df, spec)
    if not cols:
        raise ChartSpecError("no valid column to show")
    rows = search_table(df, search)
    return first_rows(rows, max_rows, cols) if max_rows else rows.select(*[col(c) for c in cols])


# Metric card labels.
METRIC_LABELS = {"mean": "Average", "sum": "Total", "count": "Count",
                 "min": "Minimum", "max": "Maximum"}


def _metric(rows: DataFrame, spec: ChartSpec, dtype) -> DataFrame:
    """Whole-table value, its label and short form."""
    fn = _function(spec)
    is_float = not (fn == "count" or (fn in ("sum", "min", "max") and is_integral(dtype)))
    label = METRIC_LABELS[fn]
    title = spec.title or f"{label} — {spec.y_column}"
    return rows.select(F.lit(label).alias("label"), F.lit(title).alias("title"),
                       F.col("__value").cast("double").alias("value"),
                       short_number(F.col("__value"), is_float).alias("formatted"))


def with_value_labels(data: DataFrame, spec: ChartSpec) -> DataFrame:
    """Value labels drawn when ``show_values`` is set: ``{y}_label`` per
    measure -- ``1,234.50`` style for column and bar charts (X9), the value
    rounded to 2 places as text for line and area charts."""
    vt = spec.visualization_type
    ys = [y for y in dict.fromkeys(spec.effective_y) if y in data.columns]
    if vt in (V.LINE_CHART, V.AREA_CHART):
        ys = [spec.y_column] if spec.y_column in data.columns else []
    out = data
    for y in ys:
        is_float = is_floating(data.schema[y].dataType)
        if vt in (V.LINE_CHART, V.AREA_CHART):
            text = F.bround(col(y), 2).cast("decimal(38,2)").cast("string") if is_float \
                else F.bround(col(y), 2).cast("string")
            text = F.regexp_replace(text, r"(\.\d)0$", "$1") if is_float else text
        else:
            text = value_label(col(y), is_float)
        out = out.withColumn(f"{y}_label", text)
    return out


_RAW = {V.SCATTER_PLOT: scatter_plot, V.HISTOGRAM: histogram, V.BOX_PLOT: box_plot, V.TABLE: table_view}


def chart_dataset(df: DataFrame, spec: ChartSpec, sort_by: str = "none") -> DataFrame:
    raw = _RAW.get(spec.visualization_type)
    if raw is not None:
        return raw(df, spec, sort_by if spec.visualization_type in SORTABLE else "none")
    g = grouping_of(df, spec)
    if g is None:
        raise ChartSpecError(f"no dataset for {spec.visualization_type.value}")
    return dataset_of(grouped(df, g), spec, g, df, sort_by)


def _named(kind: V):
    def chart(df: DataFrame, spec: ChartSpec, sort_by: str = "none") -> DataFrame:
        return chart_dataset(df, replace(spec, visualization_type=kind), sort_by)
    return chart


column_chart, bar_chart, line_chart, area_chart, pie_chart, heatmap, metric_card = map(_named, (
    V.COLUMN_CHART, V.BAR_CHART, V.LINE_CHART, V.AREA_CHART, V.PIE_CHART, V.HEATMAP, V.METRIC_CARD))


def generic_payload(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """The older one-call payload -- aggregate y by x with the spec's
    function (output ``{y}_{fn}``) for every visual but scatter and
    histogram, then keep the columns the visual reads."""
    from dashframe.operators.aggregate import aggregate
    from dashframe.spec import AGGREGATION_FUNCTIONS, AggregationConfig
    vt = spec.visualization_type
    x, y, fn = spec.x_column, spec.y_column, spec.aggregation
    if x and y and fn and vt not in (V.SCATTER_PLOT, V.HISTOGRAM) and \
            fn in AGGREGATION_FUNCTIONS and vt != V.METRIC_CARD:
        _need(df, x, y)
        return aggregate(df, AggregationConfig((x,), y, fn))
    if vt == V.METRIC_CARD:
        return metric_card(df, spec)
    keep = [c for c in (x, y, spec.color_column, spec.size_column) if c and c in df.columns]
    if not keep:
        raise ChartSpecError("no column to return")
    return df.select(*[col(c) for c in dict.fromkeys(keep)])

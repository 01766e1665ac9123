"""Analysis documents as nested data.

An analysis is one JSON text per row; it is read with an explicit schema
(``from_json``), defaults fill missing keys, and slides/visuals are reached
with ``posexplode`` and higher-order functions -- row-local work that never
groups documents together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONFIG = T.StructType([
    T.StructField("visualization_type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("x_column", T.StringType()),
    T.StructField("y_column", T.StringType()),
    T.StructField("y_columns", T.ArrayType(T.StringType())),
    T.StructField("color_column", T.StringType()),
    T.StructField("size_column", T.StringType()),
    T.StructField("aggregation", T.StringType()),
    T.StructField("show_legend", T.BooleanType()),
    T.StructField("show_grid", T.BooleanType()),
    T.StructField("show_values", T.BooleanType()),
    T.StructField("color_scheme", T.StringType()),
    T.StructField("custom_options", T.MapType(T.StringType(), T.StringType())),
])
_NUMBERS = T.MapType(T.StringType(), T.DoubleType())
VISUAL = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("config", CONFIG),
    T.StructField("position", _NUMBERS),
    T.StructField("size", _NUMBERS),
    T.StructField("comment", T.StringType()),
    T.StructField("data_snapshot", T.MapType(T.StringType(), T.StringType())),
])
SLIDE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("visualizations", T.ArrayType(VISUAL)),
    T.StructField("layout", T.StringType()),
    T.StructField("background_color", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])
COLUMN = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("original_name", T.StringType()),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
    T.StructField("null_count", T.LongType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("statistics", T.MapType(T.StringType(), T.StringType())),
])
MEASURE = T.StructType([T.StructField("name", T.StringType()),
                        T.StructField("expression", T.StringType())])
ANALYSIS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("data_schema", T.StructType([
        T.StructField("columns", T.ArrayType(COLUMN)),
        T.StructField("file_name", T.StringType()),
        T.StructField("row_count", T.LongType())])),
    T.StructField("slides", T.ArrayType(SLIDE)),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("measures", T.ArrayType(MEASURE)),
])

# What a key missing from a stored document means.
DEFAULT_AGGREGATION = "sum"
ANALYSIS_DEFAULTS = {"name": "New Analysis"}
SLIDE_DEFAULTS = {"title": "Untitled Slide", "layout": "single", "background_color": "#FFFFFF"}
VISUAL_DEFAULTS = {"comment": "", "position": {"x": 0.0, "y": 0.0},
                   "size": {"width": 400.0, "height": 300.0}}
CONFIG_DEFAULTS = {"title": "", "aggregation": DEFAULT_AGGREGATION, "show_legend": True,
                   "show_grid": True, "show_values": False, "color_scheme": "default"}


def _literal(value) -> Column:
    if isinstance(value, dict):
        return F.create_map(*[F.lit(x) for pair in value.items() for x in pair])
    return F.lit(value)


def _filled(c: Column, fields: T.StructType, defaults: dict) -> Column:
    """``c`` with its NULL fields replaced; lists and option maps become empty."""
    for f in fields:
        if f.name in defaults:
            c = c.withField(f.name, F.coalesce(c[f.name], _literal(defaults[f.name])))
        elif isinstance(f.dataType, T.ArrayType):
            c = c.withField(f.name, F.coalesce(c[f.name], F.array().cast(f.dataType)))
        elif f.name == "custom_options":
            c = c.withField(f.name, F.coalesce(c[f.name], F.create_map().cast(f.dataType)))
    return c


def _visual(v: Column) -> Column:
    config = F.when(v["config"].isNotNull(), _filled(v["config"], CONFIG, CONFIG_DEFAULTS))
    return _filled(v, VISUAL, VISUAL_DEFAULTS).withField("config", config)


def _slide(s: Column) -> Column:
    visuals = F.transform(F.coalesce(s["visualizations"], F.array().cast(T.ArrayType(VISUAL))), _visual)
    return _filled(s, SLIDE, SLIDE_DEFAULTS).withField("visualizations", visuals)


def parse(df: DataFrame, json_col: str = "data", name: str = "doc") -> DataFrame:
    """N1 / S9 read: JSON text -> typed struct with defaults for missing keys."""
    # Parsed once into its own column; the defaults below read that column
    # (an expensive expression is not inlined twice by the optimizer).
    df = df.withColumn("__raw", F.from_json(F.col(json_col), ANALYSIS))
    raw = F.col("__raw")
    slides = F.transform(F.coalesce(raw["slides"], F.array().cast(T.ArrayType(SLIDE))), _slide)
    doc = _filled(raw, ANALYSIS, ANALYSIS_DEFAULTS).withField("slides", slides)
    return df.withColumn(name, doc).drop("__raw")


def to_document(doc: Column) -> Column:
    """N2 / S9 write: struct -> JSON text with every key, unset ones as null."""
    return F.to_json(doc, {"ignoreNullFields": "false"})


def flatten(df: DataFrame, doc: str = "doc", keep: list[str] | None = None) -> DataFrame:
    """One row per (analysis, slide, visual) with 1-based positions."""
    keep = keep or []
    slides = df.select(*keep, F.col(f"{doc}.id").alias("analysis_id"),
                       F.posexplode_outer(F.col(f"{doc}.slides")).alias("slide_pos", "slide")) \
        .where(F.col("slide").isNotNull())
    vis = slides.select(*keep, "analysis_id",
                        (F.col("slide_pos") + 1).cast("long").alias("slide_pos"),
                        F.col("slide.id").alias("slide_id"),
                        F.col("slide.title").alias("slide_title"),
                        F.posexplode_outer(F.col("slide.visualizations"))
                        .alias("viz_pos", "viz")).where(F.col("viz").isNotNull())
    return vis.select(*keep, "analysis_id", "slide_pos", "slide_id", "slide_title",
                      (F.col("viz_pos") + 1).cast("long").alias("viz_pos"),
                      F.col("viz.id").alias("viz_id"),
                      F.col("viz.config.visualization_type").alias("viz_type"),
                      F.col("viz.config.x_column").alias("x_column"),
                      F.col("viz.config.y_column").alias("y_column"),
                      F.coalesce(F.col("viz.config.aggregation"),
                                 F.when(F.col("viz.config").isNotNull(),
                                        F.lit(DEFAULT_AGGREGATION))).alias("aggregation"),
                      F.col("viz.config.show_values").alias("show_values"))


def counts(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Slides, visuals, visuals with a config, exportable visuals (config
    set and not a measures panel), measures."""
    slides = F.col(f"{doc}.slides")
    per_slide = lambda f: F.aggregate(F.transform(slides, f), F.lit(0), lambda a, b: a + b)
    return df.select(
        F.col(f"{doc}.id").alias("analysis_id"),
        F.size(slides).cast("long").alias("slide_count"),
        per_slide(lambda s: F.size(s["visualizations"])).cast("long").alias("viz_count"),
        per_slide(lambda s: F.size(F.filter(s["visualizations"],
                                            lambda v: v["config"].isNotNull())))
        .cast("long").alias("configured_count"),
        per_slide(lambda s: F.size(F.filter(
            s["visualizations"],
            lambda v: v["config"].isNotNull()
            & (F.coalesce(v["config"]["visualization_type"], F.lit("")) != "measures"))))
        .cast("long").alias("exportable_count"),
        F.size(F.col(f"{doc}.measures")).cast("long").alias("measure_count"))


def reorder_slides(df: DataFrame, order_col: str, doc: str = "doc") -> DataFrame:
    """Slides put in the order of an id list; unknown ids are ignored and
    slides not listed are dropped."""
    order = F.col(order_col)
    listed = F.filter(F.col(f"{doc}.slides"), lambda s: F.array_contains(order, s["id"]))
    keyed = F.transform(listed, lambda s: F.struct(
        F.array_position(order, s["id"]).alias("p"), s.alias("s")))
    ordered = F.array_sort(keyed, lambda a, b: (a["p"] - b["p"]).cast("int"))
    return df.withColumn(doc, F.col(doc).withField("slides",
                                                    F.transform(ordered, lambda x: x["s"])))


def history(df: DataFrame, doc: str = "doc") -> DataFrame:
    """The history entry of each analysis."""
    return df.select(F.col(f"{doc}.id").alias("analysis_id"), F.col(f"{doc}.name").alias("name"),
                     F.col(f"{doc}.created_at").alias("created_at"),
                     F.col(f"{doc}.updated_at").alias("updated_at"),
                     F.size(F.col(f"{doc}.slides")).cast("long").alias("slide_count"),
                     F.col(f"{doc}.data_schema.file_name").alias("file_name"))


def slide_rows(df: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per slide (1-based position, id, visual count).

    Exploding uses the *outer* generator plus a NULL filter: a plain explode
    lets the optimizer infer a ``size(array) > 0`` filter and push it under
    the projection, evaluating the whole document expression twice."""
    rows = df.select(F.col(f"{doc}.id").alias("analysis_id"),
                     F.posexplode_outer(F.col(f"{doc}.slides")).alias("p", "s"))
    return rows.where(F.col("s").isNotNull()).select(
        "analysis_id", (F.col("p") + 1).cast("long").alias("slide_pos"),
        F.col("s.id").alias("slide_id"),
        F.size(F.col("s.visualizations")).cast("long").alias("viz_count"))

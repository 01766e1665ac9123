"""Dashboard pipelines.

L1  measures -> the visual's filters -> search -> dataset (with sort)
L2  measures once on a shared base -> per visual filters -> dataset;
    no search, no sort; ``measures`` visuals skipped; a failing visual is
    reported and the rest go on.
S11 the export is a *bundle*: one Parquet dataset per visual plus a manifest.
"""

from __future__ import annotations

import json
from contextlib import suppress
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from dashframe.functions.columns import col
from dashframe.operators.charts import ChartSpecError, chart_dataset, dataset_of, grouping_of, table_view
from dashframe.operators.filters import apply_dashboard_filters, search_column
from dashframe.operators.grouping import Grouping, grouping_sets, one_of
from dashframe.operators.transform import compute_measures
from dashframe.session import store
from dashframe.spec import (EXPORT_TABLE_ROWS, SEARCHABLE, ChartSpec,
                            VisualizationType as V)


@dataclass
class Rendered:
    data: DataFrame | None
    skipped_filters: list = field(default_factory=list)
    skipped_measures: list = field(default_factory=list)
    error: str | None = None


def render_visual(df: DataFrame, spec: ChartSpec, measures=None, filters=None,
                  search: str | None = None, sort_by: str = "none") -> Rendered:
    """L1: one lazy plan per visual."""
    base, bad_measures = compute_measures(df, measures or [])
    base, bad_filters = apply_dashboard_filters(base, filters or [])
    vt = spec.visualization_type
    try:
        if vt == V.TABLE:
            data = table_view(base, spec, search=search if vt in SEARCHABLE else None)
        else:
            if search and vt in SEARCHABLE:
                base = search_column(base, spec.x_column, search)
            data = chart_dataset(base, spec, sort_by)
    except (ChartSpecError, AnalysisException, ValueError) as exc:
        return Rendered(None, bad_filters, bad_measures, str(exc))
    return Rendered(data, bad_filters, bad_measures)


@dataclass
class Exported:
    slide_id: str
    viz_id: str
    viz_type: str
    spec: ChartSpec | None = None
    data: DataFrame | None = None
    error: str | None = None
    skipped_filters: list = field(default_factory=list)


def export_datasets(df: DataFrame, visuals: list[dict], measures=None,
                    filters_by_viz: dict | None = None, share: bool = True) -> tuple[list[Exported], list[str]]:
    """L2: ``visuals`` are ``{"slide_id", "viz_id", "config": {...}}``.
    Returns what each visual gives, failures included, and the measures that
    were skipped.

    Visuals with equal filters whose datasets are aggregates by key share one
    scan: their groupings are computed together and written once, and each
    dataset reads its rows from there.  Other visuals scan the columns they
    read.  If the common job fails, its visuals are planned one by one, so that
    only those at fault do."""
    base, bad_measures = compute_measures(df, measures or [])
    out, together = [], {}
    for v in visuals:
        cfg = v.get("config") or {}
        vtype = cfg.get("visualization_type")
        if not vtype or vtype == V.MEASURES.value:
            continue
        one = Exported(v["slide_id"], v["viz_id"], vtype)
        out.append(one)
        try:
            one.spec = ChartSpec.from_dict(cfg)
            wanted = (filters_by_viz or {}).get(v["viz_id"], [])
            rows, one.skipped_filters = apply_dashboard_filters(base, wanted)
            if one.spec.visualization_type == V.TABLE:
                one.data = table_view(rows, one.spec, max_rows=EXPORT_TABLE_ROWS)
            elif share and (g := grouping_of(rows, one.spec)):
                one.data = chart_dataset(rows, one.spec, "none")
                together.setdefault(json.dumps(wanted, sort_keys=True, default=str), []).append((one, g, rows))
            else:
                one.data = chart_dataset(rows, one.spec, "none")
        except Exception as exc:  # whatever it is, it is this visual's alone
            one.error = str(exc)
    for members in together.values():
        if len(members) > 1:
            _share_scan(members)
    return out, bad_measures


def _share_scan(members: list[tuple[Exported, Grouping, DataFrame]]) -> None:
    """Replace the datasets of visuals over the same rows by such that read one
    stored table of all their groupings."""
    rows = members[0][2]
    groupings = [g for _, g, _ in members]
    try:
        stored = store(grouping_sets(rows, groupings), "export-groupings")
    except Exception:  # one of them can't be computed: each on its own
        return
    for one, g, _ in members:
        with suppress(AnalysisException):  # a measure named as a key keeps its own scan
            one.data = dataset_of(one_of(stored, groupings, g), one.spec, g, rows)


def long_form(data: DataFrame, spec: ChartSpec) -> DataFrame:
    """One visual's dataset as ``(label, series, measure, value)`` rows, so the
    datasets of an analysis can share one table."""
    vt = spec.visualization_type
    if vt in (V.TABLE, V.SCATTER_PLOT):
        # Rows of any shape travel as records.
        return data.select(F.to_json(F.struct(*map(col, data.columns))).alias("label"),
                           F.lit(None).cast("string").alias("series"), F.lit("row").alias("measure"),
                           F.lit(None).cast("double").alias("value"))
    if vt == V.METRIC_CARD:
        return data.select(F.col("label"), F.lit(None).cast("string").alias("series"),
                           F.lit(spec.y_column).alias("measure"), F.col("value"))
    if vt == V.HISTOGRAM:
        label, values = F.col("bin").cast("string"), ["count"]
        series = col(spec.color_column).cast("string") if spec.color_column in data.columns else None
    elif vt == V.BOX_PLOT:
        label, values = F.col("group"), ["n", "lower", "q1", "median", "q3", "upper"]
        series = F.col("series") if "series" in data.columns else None
    elif vt == V.HEATMAP:
        label, series, values = F.col("x"), F.col("y"), ["value"]
    else:
        ys = spec.effective_y if vt in (V.COLUMN_CHART, V.BAR_CHART) else \
            [spec.y_column or spec.y_columns[0]]
        ys = [y for y in dict.fromkeys(ys) if y in data.columns]
        values = ys + (["share"] if vt == V.PIE_CHART else [])
        label = col(spec.x_column).cast("string")
        series = col(spec.color_column).cast("string") if (
            spec.color_column and spec.color_column in data.columns
            and spec.color_column != spec.x_column) else None
    framed = data.select(label.alias("label"),
                         (series if series is not None else F.lit(None).cast("string"))
                         .alias("series"),
                         *[col(v).cast("double").alias(v) for v in values])
    return framed.unpivot(["label", "series"], [col(v) for v in values], "measure", "value")


def export_long(df: DataFrame, visuals: list[dict], measures=None,
                filters_by_viz: dict | None = None) -> DataFrame:
    """The whole export as one table in long form, tagged with slide and visual
    ids.  Rows of tables and scatters are records; a failing visual has one
    row with the measure ``error`` and the error text as its label."""
    parts, _ = export_datasets(df, visuals, measures, filters_by_viz)
    frames = []
    for p in parts:
        if p.data is None:
            rows = df.sparkSession.createDataFrame(
                [(p.error, None, "error", None)],
                "label string, series string, measure string, value double")
        else:
            rows = long_form(p.data, p.spec)
        frames.append(rows.select(
            F.lit(p.slide_id).alias("slide_id"), F.lit(p.viz_id).alias("viz_id"),
            F.lit(p.viz_type).alias("viz_type"), "label", "series", "measure", "value"))
    if not frames:
        raise ChartSpecError("nothing to export")
    return reduce(DataFrame.unionByName, frames)


def write_bundle(df: DataFrame, visuals: list[dict], out_dir: str, measures=None,
                 filters_by_viz: dict | None = None, concurrency: int = 4) -> DataFrame:
    """Every visual's dataset under ``out_dir/slide_id=../viz_id=..`` and a
    manifest with one row per visual: path, rows, status, the whole error, and
    the filters and measures that were skipped.

    Visuals that can share a scan do (:func:`export_datasets`).  The others are
    independent jobs, so up to ``concurrency`` of them
    are submitted at once from driver threads."""
    from concurrent.futures import ThreadPoolExecutor

    parts, bad_measures = export_datasets(df, visuals, measures, filters_by_viz)
    spark = df.sparkSession

    def write_one(p: Exported):
        path, rows, status, error = f"{out_dir}/slide_id={p.slide_id}/viz_id={p.viz_id}", None, "failed", p.error
        if p.data is not None:
            try:
                # Rows are counted as they are written; the files are not read again.
                seen = Observation()
                p.data.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
                rows, status = seen.get["rows"], "ok"
            except Exception as exc:  # a failing visual does not stop the export
                error = str(exc)
        return (p.slide_id, p.viz_id, p.viz_type, path if status == "ok" else None, rows, status,
                error, [f"{x.index}: {x.reason}" for x in p.skipped_filters], bad_measures)

    with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
        manifest = list(pool.map(write_one, parts))
    schema = ("slide_id string, viz_id string, viz_type string, path string, rows long, "
              "status string, error string, skipped_filters array<string>, "
              "skipped_measures array<string>")
    man = spark.createDataFrame(manifest, schema)
    man.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/_manifest")
    return spark.read.schema(schema).parquet(f"{out_dir}/_manifest")


def visuals_of(document: str | dict) -> tuple[list[dict], list[dict]]:
    """One analysis document (its JSON text or dict) -> (visuals, measures) as
    the export expects them; visuals without a config are dropped.  A
    document is a small per-analysis record, read on the driver."""
    doc = json.loads(document) if isinstance(document, str) else document
    visuals = []
    for slide in doc.get("slides") or []:
        for viz in slide.get("visualizations") or []:
            if viz.get("config"):
                visuals.append({"slide_id": slide.get("id"), "viz_id": viz.get("id"),
                                "config": viz["config"]})
    return visuals, list(doc.get("measures") or [])


def export_analysis(df: DataFrame, document: str | dict, out_dir: str | None = None,
                    filters_by_viz: dict | None = None) -> DataFrame:
    """L2 for a stored analysis: its measures and visuals, exported as the
    long table (or, with ``out_dir``, as a bundle whose manifest is returned)."""
    visuals, measures = visuals_of(document)
    if out_dir:
        return write_bundle(df, visuals, out_dir, measures, filters_by_viz)
    return export_long(df, visuals, measures, filters_by_viz)

"""Keep a chart dataset current while new files land in an upload folder.

The dashboard engine recomputes a visual from scratch on every rerun; for a
growing table the same result can be kept incrementally: a file stream
feeds measures and filters (stateless, per micro-batch) into the chart's
grouped aggregate, whose running state lives in the checkpoint under the
cluster's shared folder.  Each micro-batch publishes the whole dataset
(complete output mode) to a folder of its own, and readers take the newest
folder that is finished, so they always see a whole, consistent chart.

Only aggregates with mergeable state (sum, count, min, max, mean) are
offered; medians and positional quartiles need the batch path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from dashframe.functions.columns import col
from dashframe.operators.aggregate import chart_agg_expr
from dashframe.operators.filters import apply_dashboard_filters
from dashframe.operators.transform import compute_measures
from dashframe.session import file_system, shared_dir
from dashframe.spec import ChartSpec


def chart_stream(stream: DataFrame, spec: ChartSpec, measures=None, filters=None) -> DataFrame:
    """The streaming chart aggregate: measures -> filters -> group by x (and
    series) -> aggregate every y."""
    base, _ = compute_measures(stream, measures or [])
    base, _ = apply_dashboard_filters(base, filters or [])
    keys = [spec.x_column] + ([spec.color_column] if spec.color_column
                              and spec.color_column != spec.x_column else [])
    types = {f.name: f.dataType for f in base.schema.fields}
    ys = [y for y in dict.fromkeys(spec.effective_y) if y in types]
    return base.groupBy(*[col(k) for k in keys]).agg(
        *[chart_agg_expr(col(y), spec.aggregation, types[y]).alias(y) for y in ys])


KEPT_EPOCHS = 3     # so that a reader can finish with the folder it has found


def _epoch_dir(out_dir: str, epoch: int) -> str:
    return f"{out_dir}/epoch-{epoch:012d}"


def published(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest chart dataset that was written to the end."""
    fs, root = file_system(spark, out_dir)
    folders = sorted((f.getPath().toString() for f in fs.listStatus(root)), reverse=True)
    done = (f for f in folders if fs.exists(file_system(spark, f"{f}/_SUCCESS")[1]))
    return spark.read.parquet(next(done))


def start_refresh(spark: SparkSession, source_dir: str, schema, spec: ChartSpec, out_dir: str,
                  measures=None, filters=None, glob: str = "*.parquet",
                  checkpoint: str | None = None, max_files: int | None = None) -> StreamingQuery:
    """Start the stream; every micro-batch writes the whole current chart
    dataset to a new folder under ``out_dir`` (see :func:`published`); all but
    the newest few are removed."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    agg = chart_stream(reader.parquet(source_dir), spec, measures, filters)

    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(_epoch_dir(out_dir, epoch))
        if epoch >= KEPT_EPOCHS:
            fs, old = file_system(spark, _epoch_dir(out_dir, epoch - KEPT_EPOCHS))
            fs.delete(old, True)

    return (agg.writeStream.outputMode("complete").foreachBatch(publish)
            .option("checkpointLocation", checkpoint or shared_dir(spark, "chart-stream-ckpt"))
            .start())


def refresh_once(spark: SparkSession, source_dir: str, schema, spec: ChartSpec,
                 measures=None, filters=None, glob: str = "*.parquet") -> DataFrame:
    """Run the stream over every file present now, stop, and return the
    published dataset."""
    out_dir = shared_dir(spark, "chart-stream-out")
    q = start_refresh(spark, source_dir, schema, spec, out_dir, measures, filters, glob)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return published(spark, out_dir)

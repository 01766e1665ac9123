"""Column profiling.

One long *fingerprint table* ``(column_name, fingerprint, count)`` -- every
column unpivoted to text, its values replaced by 128-bit fingerprints, then a
partial/final aggregate -- answers null counts, distinct counts (NULL counted
as a value) and the type rule for text columns, with shuffles for all columns
that hold no text.  Top values come from hash-bucket counters (see
:func:`top_values`).  Typed statistics (min, max, mean, std, sum) come from one
plain ``agg``; medians and quartiles from the distributed rank selection in
:mod:`dashframe.operators.quantiles`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dashframe.functions.clean import looks_like_date
from dashframe.functions.columns import col
from dashframe.operators.order import row_order, top_per_group
from dashframe.operators.quantiles import grouped_quantiles
from dashframe.schema import is_datetime, is_numeric, is_string, semantic_type
from dashframe.session import store, tasks_for
from dashframe.spec import SAMPLE_VALUES, TOP_VALUES, ColumnType

# Thresholds of the text-column type rule.
CATEGORICAL_RATIO = 0.5
TEXT_RATIO = 0.8
DATE_SHARE = 0.7
VALUES = 1 << 20      # values that a task counts


def long_values(df: DataFrame, columns: list[str] | None = None,
                ids: list[str] | None = None) -> DataFrame:
    """``(ids..., column_name, value)``: every listed column as text."""
    columns = columns or [c for c in df.columns if c not in (ids or [])]
    id_cols = [col(i) for i in ids or []]
    framed = df.select(*id_cols, *[col(c).cast("string").alias(c) for c in columns])
    return framed.unpivot([col(i) for i in ids or []], [col(c) for c in columns],
                          "column_name", "value")


def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, value, count)``; NULL is a value."""
    return _count_values(long_values(df, columns))


def _count_values(rows: DataFrame, *also: str) -> DataFrame:
    return rows.groupBy("column_name", "value", *also).agg(F.count(F.lit(1)).alias("count"))


def fingerprint_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, f1, f2, count, missing, dated)`` of every distinct value:
    its fingerprint (two 64-bit hashes), whether it is NULL, and whether it
    starts like a date.

    Rows are dealt as fingerprints, counted where they are, and the counts dealt
    by value: both times to tasks of about ``VALUES`` values, whatever the
    session's number of shuffle partitions.  Frequent values are dealt as a count
    a task."""
    columns = columns or list(df.columns)
    n = tasks_for(df.sparkSession, df.count() * len(columns), VALUES)
    prints, values = [], []
    for i, c in enumerate(columns):
        v = col(c).cast("string")
        kind = F.when(v.isNull(), 2).when(looks_like_date(v), 1).otherwise(0).cast("byte")
        prints += [F.xxhash64(v).alias(f"f1_{i}"), F.xxhash64(F.lit(1), v).alias(f"f2_{i}"), kind.alias(f"kind_{i}")]
        values.append(F.struct(*[F.col(f"{x}_{i}").alias(x) for x in ("f1", "f2", "kind")]))
    rows = df.select(*prints)
    # The partition's number parts equal rows; 16 salts a task even the tasks out.
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *rows.columns), F.lit(16 * n)).alias("salt")
    rows = rows.select("*", salt).repartition(n, "salt").select("salt", F.posexplode(F.array(*values)).alias("at", "v"))
    keys = ["at", "f1", "f2", "kind"]
    dealt = rows.select("salt", "at", "v.*").groupBy("salt", *keys).agg(F.count(F.lit(1)).alias("count"))
    freq = dealt.repartition(n, *keys).groupBy(*keys).agg(F.sum("count").alias("count"))
    return freq.select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("at") + 1).alias("column_name"), "f1",
                       "f2", "count", (F.col("kind") == 2).alias("missing"), (F.col("kind") == 1).alias("dated"))


def column_profile(df: DataFrame, columns: list[str] | None = None,
                   freq: DataFrame | None = None) -> DataFrame:
    """``column_name, row_count, null_count, unique_count``; ``freq`` is a
    fingerprint table that is at hand."""
    freq = freq if freq is not None else fingerprint_frequencies(df, columns)
    return freq.groupBy("column_name").agg(
        F.sum("count").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("missing"), F.col("count"))), F.lit(0))
        .cast("long").alias("null_count"),
        F.count(F.lit(1)).alias("unique_count"))


def detect_types(df: DataFrame, columns: list[str] | None = None,
                 approx: bool = False, freq: DataFrame | None = None) -> DataFrame:
    """``column_name, column_type``.

    Non-text columns take their type from the schema.  Text columns: no
    non-null value -> unknown; ``unique (NULL counted) / non_null < 0.5`` ->
    categorical; more than 70% of the non-null values start like a date ->
    datetime; ratio above 0.8 -> text; otherwise categorical.  The date share
    is measured over the whole column, not a leading sample.

    ``approx=True`` takes the distinct counts from HyperLogLog sketches in a
    single aggregate (no shuffle of the values): for very large free-text
    columns, at the price of exactness near the 0.5 / 0.8 thresholds.
    """
    columns = columns or list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    spark = df.sparkSession
    fixed = [(c, semantic_type(types[c]).value) for c in columns if not is_string(types[c])]
    text_cols = [c for c in columns if is_string(types[c])]
    parts = []
    if fixed:
        parts.append(spark.createDataFrame(fixed, "column_name string, column_type string"))
    if text_cols and approx:
        per_col = [F.struct(
            F.lit(c).alias("column_name"), F.count(col(c)).alias("non_null"),
            (F.approx_count_distinct(col(c), 0.01)
             + F.max(col(c).isNull().cast("int"))).alias("uniq"),
            F.count_if(col(c).isNotNull() & looks_like_date(col(c))).alias("dated"))
            for c in text_cols]
        stats = df.agg(F.array(*per_col).alias("__p")).select(F.inline("__p"))
    elif text_cols:
        if freq is None:
            freq = fingerprint_frequencies(df, text_cols)
        freq = freq.where(F.col("column_name").isin(text_cols))
        cnt = F.col("count")
        stats = freq.groupBy("column_name").agg(
            F.coalesce(F.sum(F.when(~F.col("missing"), cnt)), F.lit(0)).alias("non_null"),
            F.count(F.lit(1)).alias("uniq"),
            F.coalesce(F.sum(F.when(~F.col("missing") & F.col("dated"), cnt)), F.lit(0))
            .alias("dated"))
    if text_cols:
        ratio = F.try_divide(F.col("uniq"), F.col("non_null"))
        kind = (F.when(F.col("non_null") == 0, ColumnType.UNKNOWN.value)
                .when(ratio < CATEGORICAL_RATIO, ColumnType.CATEGORICAL.value)
                .when(F.try_divide(F.col("dated"), F.col("non_null")) > DATE_SHARE,
                      ColumnType.DATETIME.value)
                .when(ratio > TEXT_RATIO, ColumnType.TEXT.value)
                .otherwise(ColumnType.CATEGORICAL.value))
        parts.append(stats.select("column_name", kind.alias("column_type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column min, max, mean, median, std (0.0 when n = 1),
    sum -- all as double over the non-null values; no row when empty.

    The plain statistics are one wide aggregate (a single output row, turned
    into one row per column); only the exact medians need the long form."""
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in (columns or df.columns) if is_numeric(types[c])]
    base = _plain_stats(df, columns)
    longv = (df.select(*[col(c).cast("double").alias(c) for c in columns])
             .unpivot([], [col(c) for c in columns], "column_name", "value")
             .where(F.col("value").isNotNull()))
    med = grouped_quantiles(longv, ["column_name"], "value", {"median": 0.5}).drop("n")
    std = F.when(F.col("n") > 1, F.col("std")).otherwise(F.lit(0.0))
    return base.join(med, "column_name").select(
        "column_name", "min", "max", "mean", "median", std.alias("std"), "sum")


def _plain_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, min, max, mean, std, sum, n`` of numeric columns, from one
    row of aggregates."""
    per_col = []
    for c in columns:
        v = col(c).cast("double")
        ranged = F.when(~F.isnan(v), v)  # min/max skip NaN
        per_col.append(F.struct(
            F.lit(c).alias("column_name"), F.min(ranged).alias("min"),
            F.max(ranged).alias("max"), F.avg(v).alias("mean"),
            F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.sum(v).alias("sum"),
            F.count(v).alias("n")))
    return df.agg(F.array(*per_col).alias("__p")).select(F.inline("__p")) \
        .where(F.col("n") > 0)


def table_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The profile of an upload: type, row, null and distinct counts of every
    column, and min, max, mean, std and sum of the numeric ones.  Counts and
    types read one frequency table, which is written once."""
    columns = columns or list(df.columns)
    freq = store(fingerprint_frequencies(df, columns), "frequencies")
    numeric = [f.name for f in df.schema.fields if f.name in columns and is_numeric(f.dataType)]
    out = column_profile(df, columns, freq).join(detect_types(df, columns, freq=freq), "column_name")
    if not numeric:
        return out
    return out.join(_plain_stats(df, numeric).drop("n"), "column_name", "left")


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """Min, max, mean, median, std, q1, q3 of one column (linear
    interpolation quantiles)."""
    keyed = df.select(F.lit(column).alias("column_name"), col(column).cast("double").alias("v"))
    q = grouped_quantiles(keyed, ["column_name"], "v", {"median": 0.5, "q1": 0.25, "q3": 0.75})
    v = F.col("v")
    ranged = F.when(~F.isnan(v), v)  # min/max skip NaN
    base = keyed.groupBy("column_name").agg(F.min(ranged).alias("min"), F.max(ranged).alias("max"),
                                            F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    return base.join(q, "column_name").select("column_name", "min", "max", "mean", "median",
                                              "std", "q1", "q3")


def _best(freq: DataFrame, k: int) -> DataFrame:
    return top_per_group(freq, ["column_name"],
                         [F.col("count").desc(), F.col("value").asc_nulls_first()], k)


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent values per column (NULL included),
    ties by value: ``column_name, value, count, rank``.  Numbers, dates and
    booleans are counted by value; text, which may be long, as in
    :func:`_top_text`."""
    columns = columns or list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in columns if is_string(types[c])]
    narrow = [c for c in columns if c not in text]
    parts = [_best(value_frequencies(df, narrow), k)] if narrow else []
    parts += [p.select("column_name", "value", "count", "rank") for p in _top_text(df, text, k)] if text else []
    return reduce(DataFrame.unionByName, parts)


def _top_text(df: DataFrame, columns: list[str], k: int) -> list[DataFrame]:
    """Frames that together hold the k most frequent values of text columns.

    Counting every value of a near-unique text column would shuffle the column.
    Instead each task counts *hash buckets* (``BUCKETS`` counters a column, summed
    like any aggregate).  The values in the ``CHOSEN`` fullest buckets are
    recounted exactly; any other value is at most as frequent as the fullest
    bucket that was not chosen.  Where the k-th of the recounted is above that,
    the column's top k are proven.

    A column where no value stands out is counted by 64-bit hashes, still
    without text: hashes above the k-th count (fewer than k), and of the equally
    frequent ones those of the column's ``SMALLEST`` first values, which is where
    the ties in text order are found; both are recounted as text.  Only if that
    proves nothing either (more than ``SMALLEST`` rarer values come before the
    ties, or hashes collide), the column's whole values are counted.  Every step
    gives the same in any evaluation, and Spark drops the later ones when no
    column is left for them.
    """
    rows = long_values(df, columns).withColumn("h", F.xxhash64("value"))
    bucketed = rows.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    fullest = top_per_group(
        bucketed.groupBy("column_name", "bucket").agg(F.count(F.lit(1)).alias("size")),
        ["column_name"], [F.col("size").desc(), F.col("bucket")], CHOSEN + 1, "place")
    cut = F.max(F.when(F.col("place") > CHOSEN, F.col("size"))).over(Window.partitionBy("column_name"))
    chosen = fullest.withColumn("cut", F.coalesce(cut, F.lit(0))).where(F.col("place") <= CHOSEN)
    found = _best(_count_values(
        bucketed.join(F.broadcast(chosen.select("column_name", "bucket", "cut")),     # CHOSEN a column
                      ["column_name", "bucket"]), "cut"), k)
    found = _proven(found, (F.col("cut") == 0) | ((F.col("least") > F.col("cut")) & (F.col("n") == k)))

    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    left = _without(names, found)
    tested = _proven(_by_hash(_only(rows, left), k), (F.col("least") >= F.col("cut")) & (F.col("n") == k))
    rest = _only(long_values(df, columns), _without(left, tested))
    return [found, tested, _best(_count_values(rest), k)]


BUCKETS = 1 << 16     # counters a column
CHOSEN = 64           # buckets whose values are recounted
SMALLEST = 1000       # first values of a column in which ties are looked for


def _only(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the named columns; there is a name a column at most."""
    return rows.join(F.broadcast(names.select("column_name")), "column_name", "left_semi")


def _without(names: DataFrame, done: DataFrame) -> DataFrame:
    return names.join(F.broadcast(done.select("column_name")), "column_name", "left_anti")


def _proven(best: DataFrame, condition) -> DataFrame:
    """The ``best`` rows of the columns whose most frequent values they surely
    are, by the least of their counts and their number."""
    w = Window.partitionBy("column_name")
    return best.withColumns({"least": F.min("count").over(w), "n": F.count(F.lit(1)).over(w)}).where(condition)


def _by_hash(rows: DataFrame, k: int) -> DataFrame:
    """The best of the values whose hashes are among the k most frequent, or tie
    with the k-th and belong to the column's first values; ``cut`` is the k-th
    hash's count, which no other value exceeds."""
    counted = rows.groupBy("column_name", "h").agg(F.count(F.lit(1)).alias("c"))
    top = top_per_group(counted, ["column_name"], [F.col("c").desc(), F.col("h")], k)
    kth = top.groupBy("column_name").agg(F.min("c").alias("cut"))
    above = top.join(F.broadcast(kth), "column_name").where("c > cut").select("column_name", "h", "cut")
    first = rows.withColumn("at", F.dense_rank().over(
        Window.partitionBy("column_name").orderBy(F.col("value").asc_nulls_first()))) \
        .where(F.col("at") <= SMALLEST).select("column_name", "h", "value").distinct()
    ties = (counted.join(F.broadcast(first), ["column_name", "h"])      # SMALLEST a column
            .join(F.broadcast(kth), "column_name").where("c = cut"))
    ties = top_per_group(ties, ["column_name"], [F.col("value").asc_nulls_first()], k).select(
        "column_name", "h", "cut")
    candidates = above.unionByName(ties).distinct()      # fewer than 2k a column
    return _best(_count_values(rows.join(F.broadcast(candidates), ["column_name", "h"]), "cut"), k)


def sample_values(df: DataFrame, order_col: str | None = None, columns: list[str] | None = None,
                  k: int = SAMPLE_VALUES) -> DataFrame:
    """First k non-null values per column in row order (that of the files,
    or of a column that gives one), and the three-sample preview (each cut to 18
    characters, joined by ' · ')."""
    columns = columns or [c for c in df.columns if c != order_col]
    if order_col is None:
        place = row_order(df)
        if place is None:
            raise ValueError("these rows come from no file: name a column that orders them")
        order_col = "__place"
        df = df.select(*[col(c) for c in columns], place.alias(order_col))
    firsts = top_per_group(
        long_values(df, columns, ids=[order_col]).where(F.col("value").isNotNull()),
        ["column_name"], [col(order_col).asc()], k, "pos")
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col("value")))),
        lambda s: s["value"])
    grouped = firsts.groupBy("column_name").agg(ordered.alias("vals"))
    preview = F.concat_ws(" · ", F.transform(F.slice(F.col("vals"), 1, 3),
                                             lambda s: F.substring(s, 1, 18)))
    return grouped.select("column_name", F.concat_ws("|", "vals").alias("samples"),
                          preview.alias("preview"))


def datetime_range(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """P5: min and max as text for datetime columns."""
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in (columns or df.columns) if is_datetime(types[c])]
    parts = [df.agg(F.lit(c).alias("column_name"),
                    F.min(col(c)).cast("string").alias("min_date"),
                    F.max(col(c)).cast("string").alias("max_date")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unique_values(df: DataFrame, column: str, limit: int = 100) -> DataFrame:
    """Distinct values (NULL included) in order, first ``limit``."""
    return df.select(col(column)).distinct().orderBy(col(column).asc_nulls_first()).limit(limit)


def sorted_unique(df: DataFrame, column: str) -> DataFrame:
    """Sorted non-null distinct values (filter picker)."""
    return df.select(col(column)).where(col(column).isNotNull()).distinct().orderBy(col(column))


def preview_stats(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Min, max and mean of every numeric column (of the first ``limit``
    of them when it is set), in one aggregate."""
    nums = [f.name for f in df.schema.fields if is_numeric(f.dataType)][:limit]
    return _plain_stats(df, nums).select("column_name", "min", "max", "mean")


def measure_schema(df: DataFrame, measures) -> list[tuple[str, str]]:
    """The semantic schema after measures are added (measures are
    numeric columns at the end); resolved from the plan, no job runs."""
    from dashframe.operators.transform import compute_measures
    out, _ = compute_measures(df, measures)
    return [(f.name, semantic_type(f.dataType).value) for f in out.schema.fields]


def column_profile_approx(df: DataFrame, columns: list[str] | None = None,
                          rsd: float = 0.02) -> DataFrame:
    """P6 for very wide or very large tables: HyperLogLog distinct counts
    (named approximate; relative error about ``rsd``) in one aggregate
    without a shuffle of the values."""
    columns = columns or list(df.columns)
    parts = [F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("row_count"),
                      F.count_if(col(c).isNull()).alias("null_count"),
                      (F.approx_count_distinct(col(c), rsd)
                       + F.max(col(c).isNull().cast("int"))).cast("long")
                      .alias("approx_unique_count")).alias(f"__p{i}")
             for i, c in enumerate(columns)]
    row = df.agg(F.array(*parts).alias("p"))
    return row.select(F.inline("p"))

"""Sorts, caps, top-k and paging.

Ordering rules: ascending puts NULL first, and so does descending (the
dashboard engine's rule, unlike Spark's default).  Ties are broken by the
category so results are deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from dashframe.functions.columns import col
from dashframe.session import shared_dir, store

# Up to this row a page is taken from every task's first rows;
# the largest block that a deeper one reads.
SHALLOW_ROWS = 1000
PAGE_BLOCK_ROWS = 100_000


def asc(name: str) -> Column:
    return col(name).asc_nulls_first()


def desc(name: str) -> Column:
    return col(name).desc_nulls_first()


def chart_order(keys: list[str], first_y: str | None, sort_by: str) -> list[Column]:
    """R1-R4 (and the default, which is R1)."""
    x = keys[0]
    rest = [asc(k) for k in keys[1:]]
    if sort_by == "x_desc":
        return [desc(x)] + rest
    if sort_by == "value_asc" and first_y:
        return [asc(first_y), asc(x)] + rest
    if sort_by == "value_desc" and first_y:
        return [desc(first_y), asc(x)] + rest
    return [asc(x)] + rest


def sort_chart_rows(df: DataFrame, keys: list[str], first_y: str | None,
                    sort_by: str = "none") -> DataFrame:
    return df.orderBy(*chart_order(keys, first_y, sort_by))


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """1-based position of every row in a global order, computed without a
    single-partition window.

    The sorted rows are written once, each with its partition and its place in
    it; the partitions' offsets (one row each) are counted from the same files.
    As nothing is sorted twice, positions do not depend on how often, or with
    which partitions, the plan is evaluated.
    """
    placed = store(df.orderBy(*order).withColumn("__pid", F.spark_partition_id())
                   .withColumn("__mid", F.monotonically_increasing_id()), "positions")
    counts = placed.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__cnt").over(before), F.lit(0))
                            .alias("__off"))
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return (placed.join(offsets, "__pid")
            .withColumn(name, (F.col("__off") + local + 1).cast("long"))
            .drop("__pid", "__mid", "__off"))


def row_order(df: DataFrame) -> Column | None:
    """The place of a row in the files it was read from (file, row), for frames
    that select, filter or extend rows of Parquet files; None for others."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        df.select(place).schema
    except AnalysisException:
        return None
    return place


def first_rows(df: DataFrame, n: int, columns: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows in row order, as the files hold them.  Planned as
    the first n of every task and their merge: nothing is sorted whole.  Rows
    that have no such order are taken by :func:`top_rows`."""
    cols = columns or df.columns
    place = row_order(df)
    if place is None:
        return top_rows(df.select(*[col(c) for c in cols]), n, cols)
    kept = df.select(*[col(c) for c in cols], place.alias("__place"))
    return kept.orderBy("__place").limit(n).drop("__place")


def top_rows(df: DataFrame, n: int, columns: list[str] | None = None) -> DataFrame:
    """A row cap made deterministic by ordering on every projected column
    (ties are identical rows).  Planned as a per-partition top-n + merge."""
    cols = columns or df.columns
    return df.orderBy(*[asc(c) for c in cols]).limit(n)


def top_per_group(df: DataFrame, group_cols: list[str], order: list[Column], n: int,
                  rank_name: str = "rank") -> DataFrame:
    """First n rows per group.  ``row_number() <= n`` is planned with a partial
    WindowGroupLimit before the shuffle, so each map task forwards at most n
    rows per group."""
    w = Window.partitionBy(*[col(g) for g in group_cols]).orderBy(*order)
    return (df.withColumn(rank_name, F.row_number().over(w).cast("long"))
            .where(F.col(rank_name) <= n))


def page_per_group(df: DataFrame, group_cols: list[str], order: list[Column],
                   limit: int, offset: int = 0, rank_name: str = "rank") -> DataFrame:
    """R9 per owner: rows ``offset+1 .. offset+limit`` of each group."""
    ranked = top_per_group(df, group_cols, order, offset + limit, rank_name)
    return ranked.where(F.col(rank_name) > offset)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0,
         name: str = "position") -> DataFrame:
    """R9 over the whole table, deep offsets included: the ordered rows after
    ``offset``, with their positions.  Pages near the top are the first rows of
    every task and their merge; for deeper ones, where these would be most of the
    table in one task, the rows are sorted by range into blocks and the page reads
    the blocks that hold it."""
    if offset + limit > SHALLOW_ROWS:
        return RankIndex.build(df, order, block_rows=PAGE_BLOCK_ROWS).page(limit, offset, name)
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") + offset)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """R6 preview: the first n rows."""
    return first_rows(df, n)


@dataclass
class RankIndex:
    """R9 for tables that are paged often: the rows, clustered once by the
    order, and a block table with each block's first position.  A page reads the
    blocks that hold it, wherever it starts.

    Rows are range-partitioned by the order and sorted within; a file holds at
    most ``block_rows`` of them, so files are blocks.  Their rows are counted
    from the written files, which later pages read too: positions are those of
    the files, whatever partitions the index was built with.
    """
    spark: SparkSession
    path: str
    schema: T.StructType

    @staticmethod
    def build(df: DataFrame, order: list[Column], block_rows: int = 1_000_000,
              path: str | None = None) -> RankIndex:
        spark = df.sparkSession
        path = path or shared_dir(spark, "rank-index", temporary=True)
        placed = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
        placed.write.option("maxRecordsPerFile", block_rows).parquet(f"{path}/rows")
        files = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        counted = files.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min("__at").alias("first"), F.count(F.lit(1)).alias("n"))
        before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)     # a row a block
        counted.select("file", "first", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")) \
            .write.parquet(f"{path}/blocks")
        return RankIndex(spark, path, placed.schema)

    @staticmethod
    def open(spark: SparkSession, path: str) -> RankIndex:
        return RankIndex(spark, path, spark.read.parquet(f"{path}/rows").schema)

    @property
    def blocks(self) -> DataFrame:
        """``file, first, n, before``: ``before`` rows precede the block."""
        return self.spark.read.schema("file string, first long, n long, before long").parquet(f"{self.path}/blocks")

    def total(self) -> int:
        return self.blocks.agg(F.coalesce(F.max(F.col("before") + F.col("n")), F.lit(0))).first()[0]

    def page(self, limit: int, offset: int = 0, name: str = "position") -> DataFrame:
        """The rows after ``offset`` in order, with their 1-based positions."""
        held = (self.blocks.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
                .select("file", "first", "before").collect())      # the page's blocks
        columns = [c for c in self.schema.names if c != "__at"]
        if not held:
            return self.spark.createDataFrame([], T.StructType(
                [f for f in self.schema if f.name != "__at"] + [T.StructField(name, T.LongType())]))
        rows = self.spark.read.schema(self.schema).parquet(*[b["file"] for b in held])
        start = F.lit(None).cast("long")
        # Places within a block are consecutive: its files' rows are.
        for b in sorted(held, key=lambda b: b["first"]):
            start = F.when(F.col("__at") >= b["first"], F.lit(b["before"] - b["first"])).otherwise(start)
        at = (F.col("__at") + start + 1).cast("long")
        return (rows.withColumn(name, at).where((F.col(name) > offset) & (F.col(name) <= offset + limit))
                .orderBy(name).select(*[col(c) for c in columns], name))

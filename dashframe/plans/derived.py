"""Frames derived from the fixture tables inside each query, with the same
derivation written in SQL for the DuckDB oracle (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dashframe.session import tasks_for

LINES = 1 << 18       # rows of a spread table a task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt by its key: the fixture files have one row group, and what
    is derived from them here costs more per row than dealing the row.  Its tasks
    grow with its rows (counted from the files' footers)."""
    rows = table(spark, sf_dir, name)
    return rows.repartition(tasks_for(spark, rows.count(), LINES), key)


# ------------------------------------------------------------------ nulls

def null_orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k, (k % 7).alias("grp"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("status"))


NULL_ORDERS_SQL = """(select o_orderkey, o_orderkey % 7 as grp,
  case when o_orderkey % 7 = 0 then null else o_totalprice end as price,
  case when o_orderkey % 5 = 0 then null else o_orderstatus end as status
  from orders)"""


def null_customers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                    F.when(F.col("c_custkey") % 5 == 0, F.lit(None))
                    .otherwise(F.col("c_mktsegment")).alias("segment"))


NULL_CUSTOMERS_SQL = """(select c_custkey, c_name, c_nationkey, c_acctbal,
  case when c_custkey % 5 = 0 then null else c_mktsegment end as segment
  from customer)"""


# ------------------------------------------------------------ messy text

NBSP = " "


def messy_lines(spark, sf_dir) -> DataFrame:
    """Locale-formatted numbers from lineitem: ``R$ 1.234,56`` (a no-break
    space after the symbol on even line numbers), ``0,05`` and junk."""
    li = spread(spark, sf_dir, "lineitem", "l_orderkey")
    br = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    sym = F.when(F.col("l_linenumber") % 2 == 0, F.lit("R$" + NBSP)).otherwise(F.lit("R$ "))
    junk = (F.when(F.col("l_linenumber") % 3 == 0, F.lit("abc"))
            .when(F.col("l_linenumber") % 3 == 1, F.lit("")).otherwise(F.lit("1,2,3")))
    return li.select("l_orderkey", "l_linenumber",
                     F.concat(sym, br).alias("brl"),
                     F.translate(F.format_number("l_tax", 2), ".", ",").alias("plain"),
                     junk.alias("junk"),
                     F.col("l_extendedprice").alias("native"))


def messy_dates(spark, sf_dir) -> DataFrame:
    o = spread(spark, sf_dir, "orders", "o_orderkey")
    d = F.col("o_orderdate")
    return o.select("o_orderkey",
                    F.date_format(d, "yyyy-MM-dd").alias("d_iso"),
                    F.date_format(d, "dd/MM/yyyy").alias("d_br"),
                    F.date_format(d, "dd-MM-yyyy").alias("d_dash"),
                    F.date_format(d, "yyyy/MM/dd").alias("d_slash"),
                    F.lit("2024-13-45").alias("d_bad"))


# ---------------------------------------------------------- type detection

def typed_customers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    base = F.lit("1990-01-01").cast("date")
    return c.select(
        "c_mktsegment", "c_name", "c_acctbal",
        F.date_format(F.date_add(base, k.cast("int")), "yyyy-MM-dd").alias("uniq_date_text"),
        F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), (k % 30).cast("int")),
                      "yyyy-MM-dd").alias("rep_date_text"),
        F.concat(F.lit("k"), ((k * 2) / 3).cast("long").cast("string")).alias("mid_text"),
        F.lit(None).cast("string").alias("all_null"),
        (F.col("c_acctbal") > 0).alias("flag"))


# ------------------------------------------------------------- documents

def analysis_documents(spark, sf_dir) -> DataFrame:
    """One analysis document (JSON text) per order.  Its shape is derived
    from the order row alone -- 1 to 3 slides, 0 to 2 visuals per slide,
    a visual type and columns picked from the keys -- so no grouping is
    needed and every document is bounded."""
    o = spread(spark, sf_dir, "orders", "o_orderkey")
    k = F.col("o_orderkey")
    kinds = F.array(*[F.lit(v) for v in ("column_chart", "table", "measures", "pie_chart")])
    xs = F.array(*[F.lit(v) for v in ("l_returnflag", "l_linestatus", "l_shipdate")])

    def viz(i, j):
        kind = F.element_at(kinds, ((k + i + j) % 4 + 1).cast("int"))
        config = F.when((k + i * 2 + j) % 5 == 4, F.lit(None)).otherwise(F.struct(
            kind.alias("visualization_type"),
            F.concat(F.lit("Visual "), j.cast("string")).alias("title"),
            F.element_at(xs, ((k + j) % 3 + 1).cast("int")).alias("x_column"),
            F.lit("l_quantity").alias("y_column"),
            F.array(F.lit("l_quantity"), F.lit("l_extendedprice")).alias("y_columns"),
            F.lit(None).cast("string").alias("color_column"),
            F.lit(None).cast("string").alias("size_column"),
            F.lit("sum").alias("aggregation"),
            ((k + j) % 2 == 0).alias("show_values")))
        return F.struct(
            F.concat(F.lit("v"), k.cast("string"), F.lit("_"), i.cast("string"), F.lit("_"),
                     j.cast("string")).alias("id"),
            F.lit("").alias("comment"), config.alias("config"))

    def slide(i):
        return F.struct(
            F.concat(F.lit("s"), k.cast("string"), F.lit("_"), i.cast("string")).alias("id"),
            F.concat(F.lit("Slide "), i.cast("string")).alias("title"),
            F.lit("single").alias("layout"),
            F.transform(F.filter(F.sequence(F.lit(0), F.lit(1)),
                                 lambda j: j < (k + i) % 3), lambda j: viz(i, j))
            .alias("visualizations"))

    slides = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i <= k % 3), slide)
    measures = F.when(F.col("o_orderstatus") == "F", F.array(F.struct(
        F.lit("revenue").alias("name"),
        F.lit("[l_extendedprice] * (1 - [l_discount])").alias("expression")))) \
        .otherwise(F.array().cast("array<struct<name:string,expression:string>>"))
    ts = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    doc = F.struct(
        F.concat(F.lit("an"), k.cast("string")).alias("id"),
        F.concat(F.lit("Analysis "), k.cast("string")).alias("name"),
        F.struct(F.concat(F.lit("file_"), F.col("o_custkey").cast("string"), F.lit(".xlsx"))
                 .alias("file_name"), F.col("o_custkey").alias("row_count")).alias("data_schema"),
        slides.alias("slides"), ts.alias("created_at"), ts.alias("updated_at"),
        F.concat(F.lit("uploads/"), F.col("o_custkey").cast("string"), F.lit(".xlsx"))
        .alias("file_path"),
        measures.alias("measures"))
    return o.select(F.col("o_custkey").alias("user_id"), F.to_json(doc).alias("data"))


# -------------------------------------------------------------- catalog

def catalog_files(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("user_id"),
                    F.concat(F.lit("file_"), F.col("o_orderkey").cast("string")).alias("file_name"),
                    F.concat(F.lit("uploads/"), F.col("o_orderkey").cast("string"),
                             F.lit(".xlsx")).alias("storage_path"),
                    F.col("o_totalprice").cast("long").alias("file_size_kb"),
                    F.col("o_orderdate").alias("uploaded_at"))


FILES_SQL = """(select o_orderkey as file_id, o_custkey as user_id,
  'file_' || o_orderkey as file_name, 'uploads/' || o_orderkey || '.xlsx' as storage_path,
  cast(trunc(o_totalprice) as bigint) as file_size_kb, o_orderdate as uploaded_at from orders)"""


def catalog_sheets(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    keys = li.select("l_orderkey", "l_linenumber").distinct()
    return keys.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sheet_id"),
                       F.col("l_orderkey").alias("file_id"),
                       F.concat(F.lit("Sheet"), F.col("l_linenumber").cast("string"))
                       .alias("sheet_name"))


SHEETS_SQL = """(select distinct l_orderkey * 8 + l_linenumber as sheet_id,
  l_orderkey as file_id, 'Sheet' || l_linenumber as sheet_name from lineitem)"""


def catalog_columns(spark, sf_dir, sheets: DataFrame | None = None) -> DataFrame:
    s = sheets if sheets is not None else catalog_sheets(spark, sf_dir)
    return s.select(F.explode(F.array(
        F.struct((F.col("sheet_id") * 2).alias("column_id"), F.col("sheet_id"),
                 F.lit("l_quantity").alias("column_name"), F.lit("Float64").alias("data_type")),
        F.struct((F.col("sheet_id") * 2 + 1).alias("column_id"), F.col("sheet_id"),
                 F.lit("l_tax").alias("column_name"), F.lit("Float64").alias("data_type"))))
        .alias("c")).select("c.*")


COLUMNS_SQL = f"""(select sheet_id * 2 as column_id, sheet_id, 'l_quantity' as column_name,
    'Float64' as data_type from {SHEETS_SQL}
  union all select sheet_id * 2 + 1, sheet_id, 'l_tax', 'Float64' from {SHEETS_SQL})"""


def catalog_visualizations(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("viz_id"), F.col("user_id").alias("dashboard_id"),
                    (F.col("event_id") * 8 + F.col("event_id") % 7 + 1).alias("sheet_id"),
                    F.col("event_type").alias("viz_type"), F.col("ts").alias("created_at"))


VIZ_SQL = """(select event_id as viz_id, user_id as dashboard_id,
  event_id * 8 + event_id % 7 + 1 as sheet_id, event_type as viz_type, ts as created_at
  from events)"""


def _analyses(c: DataFrame, minutes: int) -> DataFrame:
    k = F.col("c_custkey")
    return c.select(F.concat(F.lit("a"), k.cast("string")).alias("analysis_id"),
                    F.col("c_nationkey").cast("long").alias("user_id"),
                    F.col("c_name").alias("name"),
                    F.concat(F.lit("analyses/"), k.cast("string"), F.lit(".parquet"))
                    .alias("storage_path"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                     + F.make_dt_interval(F.lit(0), F.lit(0), (k + minutes).cast("int")))
                    .alias("updated_at"))


def analyses(spark, sf_dir) -> DataFrame:
    """One saved analysis per customer."""
    return _analyses(table(spark, sf_dir, "customer"), 0)


ANALYSES_SQL = """(select 'a' || c_custkey as analysis_id, cast(c_nationkey as bigint) as user_id,
  c_name as name, 'analyses/' || c_custkey || '.parquet' as storage_path,
  timestamp '2024-01-01 00:00:00' + to_minutes(cast(c_custkey as bigint)) as updated_at
  from customer)"""


def analyses_old(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return _analyses(c.where(F.col("c_nationkey") < 15), 0)


def analyses_new(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").where(F.col("c_nationkey") >= 10)
    a = _analyses(c, 100000)
    third = F.substring("analysis_id", 2, 20).cast("long") % 3 == 0
    return a.withColumn("storage_path", F.when(third, F.lit(None)).otherwise(F.col("storage_path"))) \
            .withColumn("name", F.upper("name"))


ANALYSES_OLD_SQL = """(select 'a' || c_custkey as analysis_id, cast(c_nationkey as bigint) as user_id,
  c_name as name, 'analyses/' || c_custkey || '.parquet' as storage_path,
  timestamp '2024-01-01 00:00:00' + to_minutes(cast(c_custkey as bigint)) as updated_at
  from customer where c_nationkey < 15)"""

ANALYSES_NEW_SQL = """(select 'a' || c_custkey as analysis_id, cast(c_nationkey as bigint) as user_id,
  upper(c_name) as name,
  case when c_custkey % 3 = 0 then null else 'analyses/' || c_custkey || '.parquet' end
    as storage_path,
  timestamp '2024-01-01 00:00:00' + to_minutes(cast(c_custkey + 100000 as bigint)) as updated_at
  from customer where c_nationkey >= 10)"""


def sessions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("session_id"), "user_id",
                    F.col("ts").alias("last_activity"),
                    (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))


SESSIONS_SQL = """(select event_id as session_id, user_id, ts as last_activity,
  ts + interval 1 day as expires_at from events)"""

# Fixed value: the "now" of the session queries.
SESSION_NOW = "2024-01-25 00:00:00"

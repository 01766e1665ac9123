"""Scalar helpers (X5-X11) on literal values."""

import datetime as dt

from pyspark.sql import functions as F

from dashframe.functions import format as X
from dashframe.functions import text as XT


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_cut_and_title(spark):
    assert one(spark, XT.cut(F.col("v"), 5), "abcde") == "abcde"
    assert one(spark, XT.cut(F.col("v"), 5), "abcdef") == "abcde…"
    assert one(spark, XT.cut(F.col("v"), 5), None) is None
    assert one(spark, XT.title_of(F.col("v")), "column_chart") == "Column Chart"


def test_paths(spark):
    assert one(spark, XT.base_name(F.col("v")), "a/b/report.v2.xlsx") == "report.v2.xlsx"
    assert one(spark, XT.file_stem(F.col("v")), "a/b/report.v2.xlsx") == "report.v2"
    assert one(spark, XT.file_stem(F.col("v")), "dir/.hidden") == ".hidden"
    assert one(spark, XT.file_stem(F.col("v")), "plain") == "plain"


def test_short_numbers(spark):
    cases = {1234567.0: "1.23M", -2500.0: "-2.50K", 12.5: "12.50", 999.0: "999.00",
             1000.0: "1.00K", 2_500_000_000.0: "2500.00M"}
    for v, want in cases.items():
        assert one(spark, X.short_number(F.col("v")), v, "v double") == want
    assert one(spark, X.short_number(F.col("v"), is_float=False), 1234567, "v long") == "1,234,567"


def test_value_labels(spark):
    assert one(spark, X.value_label(F.col("v")), 1234.5, "v double") == "1,234.50"
    assert one(spark, X.value_label(F.col("v")), None, "v double") == ""
    assert one(spark, X.value_label(F.col("v"), is_float=False), 7, "v int") == "7"


def test_iso_parsing_and_formats(spark):
    p = X.parse_iso(F.col("v")).cast("timestamp_ntz")
    assert one(spark, p, "2024-03-05T10:20:30") == dt.datetime(2024, 3, 5, 10, 20, 30)
    assert one(spark, p, "2024-03-05 10:20:30") == dt.datetime(2024, 3, 5, 10, 20, 30)
    assert one(spark, p, "2024-03-05") == dt.datetime(2024, 3, 5)
    assert one(spark, p, "05/03/2024") is None
    ts = F.lit("2024-03-05 10:20:30").cast("timestamp_ntz")
    row = spark.range(1).select(X.format_ts(ts, "short").alias("s"), X.format_ts(ts, "iso").alias("i"),
                                X.format_ts(ts, "full").alias("f")).first()
    assert (row["s"], row["i"], row["f"]) == ("05/03 10:20", "2024-03-05 10:20", "05/03/2024 10:20")


def test_text_dates_day_first_and_invalid(spark):
    from dashframe.functions.clean import text_to_date
    d = text_to_date(F.col("v"))
    assert one(spark, d, "05/03/2024") == dt.date(2024, 3, 5)
    assert one(spark, d, "05-03-2024 10:00") == dt.date(2024, 3, 5)
    assert one(spark, d, "2024/03/05") == dt.date(2024, 3, 5)
    assert one(spark, d, "31/02/2024") is None
    assert one(spark, d, "2024-13-45") is None
    assert one(spark, d, "soon") is None


def test_locale_number_cleaning(spark):
    from dashframe.functions.clean import clean_numeric_text
    c = clean_numeric_text(F.col("v"))
    cases = {"R$ 1.234,56": 1234.56, "R$ 1.234,56": 1234.56, "-1.234,5": -1234.5,
             "12,5": 12.5, "1,2,3": None, "": None, "abc": None, "1 000": 1000.0}
    for text, want in cases.items():
        assert one(spark, c, text) == want, text

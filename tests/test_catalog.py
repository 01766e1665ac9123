"""Catalog operators on literal frames: missing links, owners, wildcards."""

import datetime as dt

from dashframe.operators import catalog as K

T0 = dt.datetime(2024, 1, 1)


def test_first_file_with_missing_sheet_gives_nulls(spark):
    viz = spark.createDataFrame([(1, 10, 100, "bar", T0), (2, 10, 200, "pie", T0),
                                 (3, 20, 999, "bar", T0)],
                                "viz_id long, dashboard_id long, sheet_id long, viz_type string, "
                                "created_at timestamp_ntz")
    sheets = spark.createDataFrame([(100, 7, "Sheet1")], "sheet_id long, file_id long, sheet_name string")
    files = spark.createDataFrame([(7, 1, "f7")], "file_id long, user_id long, file_name string")
    got = {r["dashboard_id"]: (r["viz_id"], r["file_name"])
           for r in K.first_file(viz, sheets, files).collect()}
    assert got == {10: (1, "f7"), 20: (3, None)}


def test_delete_needs_key_and_owner(spark):
    t = spark.createDataFrame([("a1", 1), ("a2", 2)], "analysis_id string, user_id long")
    req = spark.createDataFrame([("a1", 1), ("a2", 9)], "analysis_id string, user_id long")
    left = sorted(r[0] for r in K.delete_by_key_and_owner(t, req, "analysis_id", "user_id").collect())
    assert left == ["a2"]


def test_name_search_treats_wildcards_literally(spark):
    t = spark.createDataFrame([("50% off",), ("500 off",), ("a_b",), ("axb",)], "name string")
    assert [r[0] for r in K.search_names(t, "name", "0%").collect()] == ["50% off"]
    assert [r[0] for r in K.search_names(t, "name", "A_B").collect()] == ["a_b"]


def test_lookup_ignores_case(spark):
    t = spark.createDataFrame([("Alice",), ("BOB",), ("carol",)], "username string")
    want = spark.createDataFrame([("alice",), ("Bob",)], "q string")
    assert sorted(r[0] for r in K.lookup_ci(t, "username", want, "q").collect()) == ["Alice", "BOB"]


def test_cascade_from_users(spark):
    files = spark.createDataFrame([(1, 1), (2, 2)], "file_id long, user_id long")
    sheets = spark.createDataFrame([(11, 1), (21, 2)], "sheet_id long, file_id long")
    cols = spark.createDataFrame([(111, 11), (211, 21)], "column_id long, sheet_id long")
    viz = spark.createDataFrame([(5, 2, 11), (6, 1, 21)], "viz_id long, dashboard_id long, sheet_id long")
    gone = spark.createDataFrame([(1,)], "user_id long")
    left = K.cascade_delete_users(files, sheets, cols, viz, gone)
    assert [r["file_id"] for r in left["files"].collect()] == [2]
    assert [r["column_id"] for r in left["sheet_columns"].collect()] == [211]
    assert [r["viz_id"] for r in left["visualizations"].collect()] == [5]
    # viz 5 belongs to a surviving dashboard but points at user 1's sheet
    assert [r["viz_id"] for r in left["blocking_visualizations"].collect()] == [5]

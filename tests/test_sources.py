"""Sources and sinks: upload guard, store/reload, records, workbooks, bundle."""

import json
import os

from pyspark.sql import functions as F

from dashframe.operators.profile import column_profile_approx, measure_schema
from dashframe.plans.dashboard import write_bundle
from dashframe.plans.registered import EXPORT_FILTERS, EXPORT_VISUALS, FLAGSHIP_MEASURES
from dashframe.session import shared_dir
from dashframe.sources import tables as S
from dashframe.sources import workbook as W

SF = "/root/testdata/sf0.001"


def test_upload_guard(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"x" * 10)
    (tmp_path / "b.csv").write_bytes(b"y" * 200)
    (tmp_path / "c.exe").write_bytes(b"z")
    got = {os.path.basename(r["path"]): (r["accepted"], r["reason"])
           for r in S.list_uploads(spark, str(tmp_path), max_bytes=100).collect()}
    assert got == {"a.xlsx": (True, None), "b.csv": (False, "file too large"),
                   "c.exe": (False, "extension not allowed")}


def test_store_round_trip(spark):
    df = spark.read.parquet(f"{SF}/nation.parquet")
    kept = S.store(df, "nation-test")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))


def test_records(spark):
    df = spark.createDataFrame([(1, "a b", None)], "`k` int, `x y` string, z double")
    assert json.loads(S.records(df).first()[0]) == {"k": 1, "x y": "a b"}


def test_workbook_sheet_selection(spark):
    book = W.xlsx_bytes([("First", ["a", "b"], [(1, "x"), (2, "y")]),
                         ("Named", ["a", "c"], [(3.5, True)])])
    other = W.xlsx_bytes([("Only", ["a"], [(9,)])])
    files = spark.createDataFrame([("one.xlsx", book), ("two.xlsx", other)],
                                  "path string, content binary")
    cells = W.workbook_cells(files)
    names = {(r["path"], r["sheet_name"]) for r in W.sheet_names(cells).collect()}
    assert names == {("one.xlsx", "First"), ("one.xlsx", "Named"), ("two.xlsx", "Only")}
    named = W.sheet_table(cells, sheet="Named")
    got = sorted((r["path"], r["a"]) for r in named.collect())
    assert got == [("one.xlsx", 3.5), ("two.xlsx", 9.0)]
    first = W.sheet_table(cells)
    assert dict(first.dtypes)["a"] == "bigint"
    assert sorted(r["a"] for r in first.collect()) == [1, 2, 9]


def _edited(book: bytes, name: str, change) -> bytes:
    import io
    import zipfile
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as a, zipfile.ZipFile(out, "w") as b:
        for item in a.namelist():
            data = a.read(item)
            b.writestr(item, change(data) if item == name else data)
    return out.getvalue()


def test_what_cannot_be_read_is_reported_and_the_rest_is_read(spark):
    import re
    book = W.xlsx_bytes([("Broken", ["a"], [(1,)]), ("Good", ["v", "V", "v"], [(1, 2, 3), (4, 5, 6)])])
    book = _edited(book, "xl/worksheets/sheet1.xml", lambda x: x[:len(x) // 2])
    # Cells that don't state their place stand where they are.
    book = _edited(book, "xl/worksheets/sheet2.xml", lambda x: re.sub(rb' r="[A-Z]+[0-9]+"', b"", x))
    files = spark.createDataFrame([("bad.xlsx", b"not a zip"), ("half.xlsx", book)],
                                  "path string, content binary")
    cells = W.workbook_cells(files)
    errors = {(r.path, r.sheet_name) for r in W.read_errors(cells).collect()}
    assert errors == {("bad.xlsx", None), ("half.xlsx", "Broken")}
    table = W.sheet_table(cells, sheet="Good")
    assert sorted((r["v"], r["V_1"], r["v_2"]) for r in table.collect()) == [(1, 2, 3), (4, 5, 6)]


def test_bundle_writes_datasets_and_manifest(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    out = shared_dir(spark, "bundle-test")
    man = {r["viz_id"]: r for r in write_bundle(li, EXPORT_VISUALS, out, FLAGSHIP_MEASURES,
                                                 EXPORT_FILTERS).collect()}
    assert man["v1"]["status"] == "ok" and man["v5"]["status"] == "failed" and "no_such" in man["v5"]["error"]
    assert man["v1"]["rows"] == 3 and man["v1"]["skipped_measures"] == []
    assert "v4" not in man  # measures panels are not exported
    assert spark.read.parquet(man["v1"]["path"]).count() == 3


def test_measure_schema_and_approx_profile(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_quantity", "l_returnflag")
    sch = measure_schema(df, [{"name": "twice", "expression": "[l_quantity] * 2"}])
    assert sch[-1] == ("twice", "numeric")
    prof = {r["column_name"]: r for r in column_profile_approx(df).collect()}
    assert prof["l_returnflag"]["approx_unique_count"] == 3
    assert prof["l_quantity"]["null_count"] == 0


def test_file_sheet_names_fallback(spark):
    good = W.xlsx_bytes([("Data", ["a"], [(1,)])])
    files = spark.createDataFrame([("ok.xlsx", good), ("bad.xlsx", b"oops")],
                                  "path string, content binary")
    got = {r["path"]: r["sheet_name"] for r in W.file_sheet_names(files).collect()}
    assert got == {"ok.xlsx": "Data", "bad.xlsx": "Sheet1"}


def test_documents_write_and_read_back(spark):
    from dashframe.operators import documents as N
    from dashframe.plans import derived as D
    docs = N.parse(D.analysis_documents(spark, SF))
    out = shared_dir(spark, "docs-test")
    S.write_documents(docs.select(N.to_document(F.col("doc")).alias("data")), out)
    back = N.parse(spark.read.text(out).withColumnRenamed("value", "line")
                   .select(F.get_json_object("line", "$.data").alias("data")))
    assert back.count() == docs.count()
    assert back.select("doc.id").exceptAll(docs.select("doc.id")).count() == 0


def test_table_cache_reloads_from_store(spark):
    df = spark.read.parquet(f"{SF}/nation.parquet")
    cache = S.TableCache(spark)
    cache.put("a1", df)
    path = cache._paths["a1"]
    assert cache.get("a1").count() == 25
    cache.drop()
    assert cache.get("missing") is None
    fresh = S.TableCache(spark)  # a new driver: only the path is known
    assert fresh.get("a1", storage_path=path).count() == 25


def test_export_from_analysis_document(spark):
    from dashframe.plans.dashboard import export_analysis, visuals_of
    doc = {"id": "a", "measures": FLAGSHIP_MEASURES, "slides": [
        {"id": "s1", "visualizations": [
            {"id": "v1", "config": {"visualization_type": "column_chart",
                                    "x_column": "l_returnflag", "y_column": "revenue"}},
            {"id": "v2", "config": None}]},
        {"id": "s2", "visualizations": [
            {"id": "v3", "config": {"visualization_type": "metric_card",
                                    "y_column": "l_quantity", "aggregation": "count"}}]}]}
    visuals, measures = visuals_of(json.dumps(doc))
    assert [v["viz_id"] for v in visuals] == ["v1", "v3"] and measures == FLAGSHIP_MEASURES
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    out = export_analysis(li, doc).collect()
    assert {(r["viz_id"], r["measure"]) for r in out} == {("v1", "revenue"), ("v3", "l_quantity")}
    metric = [r["value"] for r in out if r["viz_id"] == "v3"]
    assert metric == [float(li.count())]

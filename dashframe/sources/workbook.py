"""Folders of .xlsx workbooks as Spark tables.

``spark.read.format("binaryFile")`` lists and loads the files; a Python UDTF
opens each file (one row = one workbook, bounded by the upload guard) and
emits long cells ``(path, sheet_index, sheet_name, row, col, value)``.  All
shaping after that -- header rows, picking a sheet, widening, the sheet and
column catalog -- is plain DataFrame work.  Scope: cell values of one table
per sheet with a header row; dates stay as the workbook stores them (serial
numbers unless written as text).  Legacy binary .xls is out of scope.
"""

from __future__ import annotations

import io
import re
import sys
import zipfile
from xml.etree import ElementTree as ET

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from dashframe.functions.columns import col
from dashframe.operators.order import asc
from dashframe.spec import MAX_UPLOAD_BYTES

# The parser and the writer run in Python workers.  Serialising this module's
# functions by value ships them with the job, so executors need no install of
# the package (it only uses the standard library, pandas and pyspark there).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
_CELL = re.compile(r"([A-Z]+)(\d+)")
CELLS_SCHEMA = ("sheet_index int, sheet_name string, row int, col int, value string, "
                "kind string")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n


def _col_letters(i: int) -> str:
    s = ""
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t"))


def parse_xlsx(content: bytes):
    """Yield (sheet_index, sheet_name, row, col, value, kind) for every
    non-empty cell; kind is ``n`` (number), ``s`` (text) or ``b`` (boolean)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            shared = [_text(si) for si in root.findall("m:si", _NS)]
        rels = {}
        if "xl/_rels/workbook.xml.rels" in names:
            for rel in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall("pr:Relationship", _NS):
                target = rel.get("Target", "").lstrip("/")
                rels[rel.get("Id")] = target if target.startswith("xl/") else f"xl/{target}"
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        sheets = wb.find("m:sheets", _NS)
        for idx, sheet in enumerate(sheets.findall("m:sheet", _NS) if sheets is not None else []):
            target = rels.get(sheet.get(f"{{{_NS['r']}}}id"), f"xl/worksheets/sheet{idx + 1}.xml")
            name = sheet.get("name")
            try:
                cells = list(_sheet_cells(z, target, shared))
            except (ET.ParseError, KeyError, IndexError, ValueError, zipfile.BadZipFile) as exc:
                # The sheet is left out and says so; those after it are read.
                yield idx, name, 0, 0, f"{type(exc).__name__}: {exc}", "x"
                continue
            for row, column, value, kind in cells:
                yield idx, name, row, column, value, kind


def _sheet_cells(z: zipfile.ZipFile, target: str, shared: list[str]):
    """(row, col, value, kind) of a sheet's non-empty cells.  A row or cell
    that doesn't state its place follows the one before it."""
    row_tag, cell_tag = f"{{{_NS['m']}}}row", f"{{{_NS['m']}}}c"
    row = column = 0
    for event, el in ET.iterparse(z.open(target), events=("start", "end")):
        if event == "start":
            if el.tag == row_tag:
                row, column = int(el.get("r", row + 1)), 0
            continue
        if el.tag != cell_tag:
            continue
        m = _CELL.fullmatch(el.get("r", ""))
        row, column = (int(m.group(2)), _col_index(m.group(1))) if m else (row, column + 1)
        value, kind = _cell_value(el, shared)
        el.clear()
        if value:
            yield row, column, value, kind


def _cell_value(el, shared: list[str]) -> tuple[str | None, str]:
    kind, v = el.get("t", "n"), el.find("m:v", _NS)
    if kind == "inlineStr":
        return _text(el), "s"
    if v is None or v.text is None or kind == "e":
        return None, kind
    if kind == "s":
        return shared[int(v.text)], "s"
    if kind == "b":
        return "true" if v.text == "1" else "false", "b"
    return v.text, "s" if kind == "str" else kind


@udtf(returnType=CELLS_SCHEMA)
class WorkbookCells:
    """One workbook file in, its cells out; what cannot be read, a sheet or the
    whole file, yields one row of kind ``x`` with the error (row 0, which no
    table holds)."""

    def eval(self, content: bytes):
        try:
            yield from parse_xlsx(bytes(content))
        except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError) as exc:
            yield None, None, 0, 0, f"{type(exc).__name__}: {exc}", "x"


def workbook_cells(files: DataFrame) -> DataFrame:
    """Cells of every workbook in a ``(path, content)`` frame (the shape
    ``binaryFile`` produces)."""
    return files.select("path", "content").lateralJoin(
        WorkbookCells(F.col("content").outer())).select(
        "path", "sheet_index", "sheet_name", "row", "col", "value", "kind")


def read_workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """S1 (folder form): every .xlsx under ``path``.  Shaping reads the cells
    more than once, so store them first (``sources.tables.store``) when the
    folder is large: the parse then runs once."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
             .option("recursiveFileLookup", "true").load(path)
             .where(F.col("length") <= MAX_UPLOAD_BYTES))
    return workbook_cells(files)


def read_errors(cells: DataFrame) -> DataFrame:
    """``(path, sheet_index, sheet_name, error)`` of what could not be read."""
    return cells.where(F.col("kind") == "x").select("path", "sheet_index", "sheet_name",
                                                    F.col("value").alias("error"))


def sheet_names(cells: DataFrame) -> DataFrame:
    """``(path, sheet_index, sheet_name)``."""
    return cells.where(F.col("sheet_index").isNotNull()) \
        .select("path", "sheet_index", "sheet_name").distinct()


def _headers(cells: DataFrame) -> DataFrame:
    """Row 1 of each sheet names its columns; a repeated name, whatever its
    case, gets ``_1``, ``_2``... from the second on."""
    again = F.row_number().over(Window.partitionBy(
        "path", "sheet_index", F.lower("value")).orderBy("col")) - 1
    return cells.where(F.col("row") == 1).withColumn("again", again).select(
        "path", "sheet_index", "col",
        F.when(F.col("again") > 0, F.concat_ws("_", "value", F.col("again").cast("string")))
        .otherwise(F.col("value")).alias("header"))


def sheet_table(cells: DataFrame, sheet: str | None = None,
                all_sheets: bool = False) -> DataFrame:
    """The table of one sheet per file -- the named one, or the first
    when the name is absent from that file -- or of all sheets.  Rows from
    different files are combined by header name; every value is text."""
    pick = cells
    if not all_sheets:
        names = sheet_names(cells)
        if sheet is not None:
            has = names.where(F.col("sheet_name") == sheet).select("path").distinct()
            named = cells.where(F.col("sheet_name") == sheet).join(has, "path", "left_semi")
            first = cells.where(F.col("sheet_index") == 0).join(has, "path", "left_anti")
            pick = named.unionByName(first)
        else:
            pick = cells.where(F.col("sheet_index") == 0)
    heads = _headers(pick)
    body = pick.where(F.col("row") > 1).join(heads, ["path", "sheet_index", "col"])
    # One small row per header name: its cell kinds decide the column type.
    kinds = (body.groupBy("header")
             .agg(F.count_if(F.col("kind") != "n").alias("other"),
                  F.count_if(~F.col("value").rlike(r"^-?\d{1,18}$")).alias("fractional"))
             .orderBy(asc("header")).collect())
    found = [r["header"] for r in kinds]
    wide = (body.groupBy("path", "sheet_name", "row").pivot("header", found)
            .agg(F.first("value")).drop("row"))
    typed = {r["header"]: ("long" if r["fractional"] == 0 else "double")
             for r in kinds if r["other"] == 0}
    return wide.select(*[col(c).try_cast(typed[c]).alias(c) if c in typed else col(c)
                         for c in wide.columns])


_INT = r"^-?\d+$"
_NUM = r"^-?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def sheet_catalog(cells: DataFrame) -> DataFrame:
    """One row per (file, sheet, column) with the header name, the
    storage type read from the cells below it, and the sheet's data rows."""
    heads = _headers(cells)
    body = cells.where(F.col("row") > 1)
    per_col = body.groupBy("path", "sheet_index", "col").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("value").rlike(_INT)).alias("ints"),
        F.count_if(F.col("value").rlike(_NUM)).alias("nums"))
    rows = body.groupBy("path", "sheet_index").agg(F.max("row").alias("last_row"))
    kind = (F.when(F.col("cells").isNull() | (F.col("cells") == 0), F.lit("String"))
            .when(F.col("ints") == F.col("cells"), F.lit("Int64"))
            .when(F.col("nums") == F.col("cells"), F.lit("Float64"))
            .otherwise(F.lit("String")))
    names = sheet_names(cells)
    return (heads.join(per_col, ["path", "sheet_index", "col"], "left")
            .join(rows, ["path", "sheet_index"], "left")
            .join(names, ["path", "sheet_index"])
            .select("path", "sheet_index", "sheet_name", "col",
                    F.col("header").alias("column_name"), kind.alias("data_type"),
                    (F.coalesce(F.col("last_row"), F.lit(1)) - 1).alias("row_count")))


# ------------------------------------------------------------------ writer

def _xml(s: str) -> str:
    return (s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            .replace('"', "&quot;"))


def xlsx_bytes(sheets: list[tuple[str, list[str], list[tuple]]]) -> bytes:
    """A minimal workbook: ``[(sheet_name, header, rows)]``; numbers become
    number cells, everything else inline text."""
    m = _NS["m"]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.'
                   'openxmlformats.org/package/2006/content-types"><Default Extension="xml" '
                   'ContentType="application/xml"/></Types>')
        sheet_tags, rel_tags = [], []
        for i, (name, header, rows) in enumerate(sheets, start=1):
            lines = []
            for r, values in enumerate([tuple(header)] + list(rows), start=1):
                cells = []
                for c, v in enumerate(values, start=1):
                    ref = f"{_col_letters(c)}{r}"
                    if v is None:
                        continue
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
                    else:
                        cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{_xml(str(v))}</t></is></c>')
                lines.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml",
                       f'<worksheet xmlns="{m}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
            sheet_tags.append(f'<sheet name="{_xml(name)}" sheetId="{i}" r:id="rId{i}"/>')
            rel_tags.append(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/'
                            f'officeDocument/2006/relationships/worksheet" '
                            f'Target="worksheets/sheet{i}.xml"/>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{_NS["r"]}"><sheets>'
                                      f'{"".join(sheet_tags)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<Relationships xmlns="{_NS["pr"]}">{"".join(rel_tags)}</Relationships>')
    return buf.getvalue()


def frame_to_workbooks(df: DataFrame, sheet_col: str, prefix: str = "book") -> DataFrame:
    """``df`` as workbooks -- one per Arrow batch of each partition (so a task
    holds one batch at a time), one sheet per value of ``sheet_col`` -- returned
    as ``(path, content)`` rows like ``binaryFile`` produces."""
    cols = [c for c in df.columns if c != sheet_col]

    def build(batches):
        import pandas as pd
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        for i, pdf in enumerate(batches):
            if pdf.empty:
                continue
            sheets = []
            for name, part in pdf.groupby(sheet_col, sort=True, dropna=False):
                rows = [tuple(None if pd.isna(v) else (v.item() if hasattr(v, "item") else v)
                              for v in rec) for rec in part[cols].itertuples(index=False)]
                sheets.append((str(name), cols, rows))
            yield pd.DataFrame({"path": [f"{prefix}-{pid:05d}-{i:05d}.xlsx"],
                                "content": [xlsx_bytes(sheets)]})

    return df.mapInPandas(build, "path string, content binary")


# Fixed value: the sheet name reported for a file whose sheets cannot be read.
FALLBACK_SHEET = "Sheet1"


def file_sheet_names(files: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """S2 per file: its sheet names, or the fallback name when the file
    yields no readable sheet."""
    cells = cells if cells is not None else workbook_cells(files)
    names = sheet_names(cells)
    return (files.select("path").join(names, "path", "left")
            .select("path", F.coalesce("sheet_index", F.lit(0)).alias("sheet_index"),
                    F.coalesce("sheet_name", F.lit(FALLBACK_SHEET)).alias("sheet_name")))

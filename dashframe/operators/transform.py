"""Row-level table changes: measures (M1), typed casts (C4), rename."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.utils import AnalysisException

from dashframe.functions.clean import to_date, to_number, to_text
from dashframe.functions.columns import col
from dashframe.functions.measures import MeasureError, parse_measure, referenced_columns
from dashframe.schema import is_numeric
from dashframe.spec import ColumnType, Measure


def compute_measures(df: DataFrame, measures: list) -> tuple[DataFrame, list[str]]:
    """M1: add measures in order; a later one may use an earlier one; a name
    already present is replaced.  Blank, unparsable, non-numeric or unresolved
    measures are skipped and their names returned.  Each candidate is resolved
    against the schema (analysis only, no job) before it is kept."""
    skipped: list[str] = []
    for m in measures or []:
        name = ((m.name if isinstance(m, Measure) else m.get("name")) or "").strip()
        expr = ((m.expression if isinstance(m, Measure) else m.get("expression")) or "").strip()
        if not name or not expr:
            skipped.append(name or "<blank>")
            continue
        try:
            refs = referenced_columns(expr)
            types = {f.name: f.dataType for f in df.schema.fields}
            if any(r not in types or not is_numeric(types[r]) for r in refs):
                raise MeasureError("unknown or non-numeric column")
            candidate = df.withColumn(name, parse_measure(expr))
            candidate.schema  # resolve now
            df = candidate
        except (MeasureError, AnalysisException):
            skipped.append(name)
    return df, skipped


def apply_types(df: DataFrame, overrides: dict) -> DataFrame:
    """C4: one projection applying ``{column: ColumnType}``; unknown columns are
    ignored and boolean/unknown targets leave the column as it is."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in df.columns:
        target = overrides.get(name)
        target = ColumnType(target) if target is not None else None
        c = col(name)
        if target == ColumnType.NUMERIC:
            c = to_number(c, types[name])
        elif target == ColumnType.DATETIME:
            c = to_date(c, types[name])
        elif target in (ColumnType.CATEGORICAL, ColumnType.TEXT):
            c = to_text(c)
        out.append(c.alias(name))
    return df.select(*out)


def dedupe_names(columns: list[str], mapping: dict[str, str]) -> list[str]:
    """Mapped names in column order, a repeat gets ``_1``, ``_2``...; the
    suffix is the first one free among all names (kept and new)."""
    taken: set[str] = {c for c in columns if c not in mapping}
    counters: dict[str, int] = {}
    result: list[str] = []
    for c in columns:
        if c not in mapping:
            result.append(c)
            continue
        want = mapping[c]
        if want not in taken:
            new = want
            counters.setdefault(want, 0)
        else:
            k = counters.get(want, 0)
            while True:
                k += 1
                new = f"{want}_{k}"
                if new not in taken:
                    break
            counters[want] = k
        taken.add(new)
        result.append(new)
    return result


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.toDF(*dedupe_names(df.columns, mapping))

"""Predicates.

Two families, both AND their conditions:

* typed conditions (:class:`FilterCondition`): values are used as given;
  ``contains`` is a regular expression;
* dashboard filters (``{"col", "op", "val"}`` dicts): the value is coerced to
  the column type, text operators work on the text form of the column,
  ``contains`` is literal, and a filter that cannot apply is skipped and
  reported instead of failing the visual.

Every predicate is a built-in Column expression, so Catalyst pushes the
comparisons into the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dashframe.functions.columns import col
from dashframe.schema import is_datetime, is_integral, is_numeric, is_string
from dashframe.spec import FilterCondition


# ---------------------------------------------------------------- typed form

# A whole number beyond 64 bits compares like this one with any integer column.
_BEYOND = 10 ** 30


def _literal(v) -> Column:
    """A literal; whole numbers that no long holds become decimals."""
    if isinstance(v, int) and not isinstance(v, bool) and not -(1 << 63) <= v < 1 << 63:
        return F.lit(Decimal(max(-_BEYOND, min(_BEYOND, v))))
    return F.lit(v)


def condition_predicate(cond: FilterCondition) -> Column:
    c, op, v = col(cond.column_name), cond.operator, cond.value
    if op == "eq":
        return c == _literal(v)
    if op == "ne":
        return c != _literal(v)
    if op == "gt":
        return c > _literal(v)
    if op == "lt":
        return c < _literal(v)
    if op == "gte":
        return c >= _literal(v)
    if op == "lte":
        return c <= _literal(v)
    if op == "contains":
        return c.rlike(str(v))
    if op == "starts_with":
        return c.startswith(str(v))
    if op == "ends_with":
        return c.endswith(str(v))
    if op in ("in", "not_in"):
        values = list(v) if isinstance(v, (list, tuple, set)) else [v]
        test = c.isin([_literal(x) for x in values]) if values else F.lit(False)
        return test if op == "in" else ~test
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    raise ValueError(f"unknown filter operator: {op!r}")


def apply_filters(df: DataFrame, conditions: list[FilterCondition]) -> DataFrame:
    """Typed API: AND of all conditions (a NULL predicate drops the row)."""
    if not conditions:
        return df
    return df.filter(reduce(lambda a, b: a & b, (condition_predicate(c) for c in conditions)))


# ------------------------------------------------------------ dashboard form

# Operators offered per column kind.
NUMERIC_OR_DATE_OPS = ("eq", "ne", "gt", "lt", "gte", "lte", "is_null", "is_not_null")
TEXT_OPS = ("eq", "ne", "contains", "in", "starts_with", "is_null", "is_not_null")


def offered_operators(dtype: T.DataType) -> tuple[str, ...]:
    return NUMERIC_OR_DATE_OPS if (is_numeric(dtype) or is_datetime(dtype)) else TEXT_OPS


class _Skip(Exception):
    pass


def _as_number(value, whole: bool):
    if isinstance(value, bool):
        raise _Skip("non-numeric value for a numeric column")
    try:
        number = float(value)
        return int(number) if whole else number
    except (TypeError, ValueError, OverflowError):
        raise _Skip("non-numeric value for a numeric column") from None


def _as_date(value, dtype: T.DataType) -> Column:
    """The value as a date literal; text that doesn't read as one is skipped
    (it would make the predicate NULL for every row)."""
    if not isinstance(value, (str, _dt.date, _dt.datetime)):
        raise _Skip("value is not a date")
    literal = F.lit(value).try_cast(dtype)
    one_row = SparkSession.active().sql("select 1")      # planned away: no job
    if isinstance(value, str) and one_row.select(literal).first()[0] is None:
        raise _Skip("value is not a date")
    return literal


def comparable_literal(dtype: T.DataType, value) -> Column:
    """The value as a literal of the column's kind -- a number (cut to
    a whole one for an integral column, however large), text, a date or a
    boolean -- or ``_Skip`` with the reason why it is none."""
    if value is None or isinstance(value, (list, tuple, set, dict)):
        raise _Skip("value does not fit the column")
    if is_numeric(dtype):
        return _literal(_as_number(value, is_integral(dtype)))
    if is_datetime(dtype):
        return _as_date(value, dtype)
    for kind, own, reason in ((T.BooleanType, bool, "non-boolean value for a boolean column"),
                              (T.StringType, str, "non-text value for a text column")):
        if isinstance(dtype, kind):
            if not isinstance(value, own):
                raise _Skip(reason)
            return F.lit(value)
    raise _Skip("column type cannot be compared")


def dashboard_predicate(dtype: T.DataType, name: str, op: str, val) -> Column:
    c = col(name)
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    text = c.cast("string")
    if op == "in":
        wanted = set(map(str.strip, str(val).split(","))) - {""}
        return text.isin(sorted(wanted)) if wanted else F.lit(False)
    if op == "contains":
        return text.contains(str(val))
    if op == "starts_with":
        return text.startswith(str(val))
    if op == "eq" and isinstance(val, (list, tuple)):
        values = [str(v) for v in val]
        return text.isin(values) if values else F.lit(False)
    lit = comparable_literal(dtype, val)
    if op == "eq":
        return c == lit
    if op == "ne":
        return c != lit
    if op == "gt":
        return c > lit
    if op == "lt":
        return c < lit
    if op == "gte":
        return c >= lit
    if op == "lte":
        return c <= lit
    raise _Skip(f"unknown operator {op!r}")


@dataclass(frozen=True)
class Skipped:
    index: int
    reason: str


def apply_dashboard_filters(df: DataFrame, filters: list[dict]) -> tuple[DataFrame, list[Skipped]]:
    """AND of the valid filters; invalid ones (unknown column, value that does
    not fit the column type, unknown operator) are skipped and returned."""
    types = {f.name: f.dataType for f in df.schema.fields}
    preds: list[Column] = []
    skipped: list[Skipped] = []
    for i, f in enumerate(filters or []):
        name, op, val = f.get("col"), f.get("op"), f.get("val")
        if name not in types:
            skipped.append(Skipped(i, f"unknown column {name!r}"))
            continue
        try:
            preds.append(dashboard_predicate(types[name], name, op, val))
        except _Skip as exc:
            skipped.append(Skipped(i, str(exc)))
    if preds:
        df = df.filter(reduce(lambda a, b: a & b, preds))
    return df, skipped


# ------------------------------------------------------------------- search

def search_table(df: DataFrame, query: str | None) -> DataFrame:
    """case-insensitive literal match on any text column; no text column
    or an empty query -> no filter."""
    if not query:
        return df
    text_cols = [f.name for f in df.schema.fields if is_string(f.dataType)]
    if not text_cols:
        return df
    q = query.lower()
    return df.filter(reduce(lambda a, b: a | b,
                            (F.lower(col(c)).contains(q) for c in text_cols)))


def search_column(df: DataFrame, column: str | None, query: str | None) -> DataFrame:
    """same test on the text form of one column (the chart's x)."""
    if not query or not column or column not in df.columns:
        return df
    return df.filter(F.lower(col(column).cast("string")).contains(query.lower()))

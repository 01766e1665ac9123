"""Spark type -> semantic column type and catalog storage type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dashframe.spec import ColumnType

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, _INTEGRAL + _FRACTIONAL)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, _INTEGRAL)


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, _DATETIME)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def semantic_type(dt: T.DataType) -> ColumnType:
    """One rule for every physical type; text is refined by profiling."""
    if is_numeric(dt):
        return ColumnType.NUMERIC
    if is_datetime(dt):
        return ColumnType.DATETIME
    if isinstance(dt, T.BooleanType):
        return ColumnType.BOOLEAN
    if is_string(dt):
        return ColumnType.CATEGORICAL
    return ColumnType.UNKNOWN


# Catalog storage type names.
STORAGE_TYPES = ("Int64", "Float64", "String", "Boolean", "Date", "Datetime", "Time")


def storage_type(dt: T.DataType) -> str:
    """P10: physical type -> storage type recorded in the column catalog."""
    if is_integral(dt):
        return "Int64"
    if isinstance(dt, _FRACTIONAL):
        return "Float64"
    if isinstance(dt, T.BooleanType):
        return "Boolean"
    if isinstance(dt, T.DateType):
        return "Date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "Datetime"
    return "String"


def schema_types(df: DataFrame) -> dict[str, ColumnType]:
    return {f.name: semantic_type(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Column pickers: numeric / categorical / datetime / all."""
    types = schema_types(df)
    if kind == "all":
        return list(df.columns)
    wanted = {"numeric": {ColumnType.NUMERIC},
              "categorical": {ColumnType.CATEGORICAL, ColumnType.TEXT,
                              ColumnType.BOOLEAN},
              "datetime": {ColumnType.DATETIME}}[kind]
    return [c for c in df.columns if types[c] in wanted]

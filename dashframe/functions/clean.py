"""Lenient per-column casts (C1-C3).  ANSI stays on; every cast is ``try_*``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dashframe.schema import is_datetime, is_numeric, is_string

# Date shapes recognised in text, in the order they are tried.
# Slash and dash forms with the year last are read day first (dd/MM/yyyy).
DATE_TEXT_PATTERNS = (
    (r"^\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"^\d{2}/\d{2}/\d{4}", "dd/MM/yyyy"),
    (r"^\d{2}-\d{2}-\d{4}", "dd-MM-yyyy"),
    (r"^\d{4}/\d{2}/\d{2}", "yyyy/MM/dd"),
)


def looks_like_date(c: Column) -> Column:
    """True when the text starts with one of the four date shapes."""
    test = None
    for regex, _ in DATE_TEXT_PATTERNS:
        hit = c.rlike(regex)
        test = hit if test is None else (test | hit)
    return test


def clean_numeric_text(c: Column) -> Column:
    """Drop every R, $, (Unicode) whitespace and '.', turn the first ',' into
    '.', then cast leniently: ``"R$ 1.234,56"`` -> 1234.56, junk -> NULL."""
    stripped = F.regexp_replace(c, r"(?U)[R$\s.]", "")
    first_comma = F.regexp_replace(stripped, r"^([^,]*),", "$1.")
    return first_comma.try_cast("double")


def to_number(c: Column, dtype: T.DataType) -> Column:
    """Numeric target: text is cleaned (C1), numbers keep their value, booleans
    become 1.0 / 0.0.  Other types go through the text cleaner."""
    if is_numeric(dtype):
        return c.cast("double")
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), F.lit(None).cast("double")).when(c, 1.0).otherwise(0.0)
    return clean_numeric_text(c.cast("string"))


def text_to_date(c: Column) -> Column:
    """C2 on text: first of the four shapes that parses, on the first 10 chars."""
    head = F.substring(c, 1, 10)
    return F.coalesce(*[F.try_to_timestamp(head, F.lit(fmt)).cast("date")
                        for _, fmt in DATE_TEXT_PATTERNS])


def to_date(c: Column, dtype: T.DataType) -> Column:
    """Dates and timestamps keep their day; text is parsed leniently."""
    if is_datetime(dtype):
        return c.cast("date")
    if is_string(dtype):
        return text_to_date(c)
    return F.lit(None).cast("date")


def to_text(c: Column) -> Column:
    """C3."""
    return c.cast("string")

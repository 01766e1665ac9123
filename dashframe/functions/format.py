"""Number, label and date formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display formats for timestamps.
DATE_FORMATS = {
    "short": "dd/MM HH:mm",
    "iso": "yyyy-MM-dd HH:mm",
    "full": "dd/MM/yyyy HH:mm",
}


def _no_number(v: Column) -> Column:
    """``nan``, ``inf`` and ``-inf`` as text; NULL for any number."""
    return (F.when(F.isnan(v), F.lit("nan")).when(v == float("inf"), F.lit("inf"))
            .when(v == float("-inf"), F.lit("-inf")))


def _plain(c: Column, digits: int = 2) -> Column:
    return F.regexp_replace(F.format_number(c, digits), ",", "")


def short_number(value: Column, is_float: bool = True) -> Column:
    """>= 1e6 -> ``1.23M``, >= 1e3 -> ``1.23K``, else two decimals.
    Integer results keep all digits with thousands separators.  NaN reads
    ``nan``, and infinities are large: ``infM``."""
    if not is_float:
        return F.format_number(value, 0)
    v = value.cast("double")
    return (F.when(v.isNull(), F.lit(None))
            .when(F.isnan(v), F.lit("nan"))
            .when(F.abs(v) == float("inf"), F.concat(_no_number(v), F.lit("M")))
            .when(F.abs(v) >= 1_000_000, F.concat(_plain(v / 1_000_000), F.lit("M")))
            .when(F.abs(v) >= 1_000, F.concat(_plain(v / 1_000), F.lit("K")))
            .otherwise(_plain(v)))


def value_label(value: Column, is_float: bool = True) -> Column:
    """Null -> '', floats -> ``1,234.50``, anything else -> its text."""
    text = F.coalesce(_no_number(value.cast("double")), F.format_number(value, 2)) if is_float \
        else value.cast("string")
    return F.coalesce(text, F.lit(""))


def round2(value: Column) -> Column:
    """X10."""
    return F.bround(value, 2)


def parse_iso(text: Column) -> Column:
    """X11: ISO text -> timestamp, NULL when it does not parse."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
                      F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
                      F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def format_ts(ts: Column, style: str = "iso") -> Column:
    return F.date_format(ts, DATE_FORMATS[style])

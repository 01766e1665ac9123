"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def cut(c: Column, n: int, marker: str = ELLIPSIS) -> Column:
    """Keep the first n characters, add a marker when the text was longer."""
    s = c.cast("string")
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(marker))).otherwise(s)


def title_of(c: Column) -> Column:
    """Enum name in title case (``column_chart`` -> ``Column Chart``)."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def base_name(path: Column) -> Column:
    """Last path segment."""
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """Base name without its last extension (a leading dot is kept)."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")

"""Column references for names that come from spreadsheets.

Names may hold spaces, dots, brackets or backticks, so every reference is
backtick-quoted instead of being parsed as a nested field path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))

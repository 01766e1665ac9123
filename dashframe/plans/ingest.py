"""L3: read -> profile -> confirm/override types -> cast -> store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from dashframe.operators.profile import detect_types, table_profile
from dashframe.operators.transform import apply_types
from dashframe.sources.tables import store
from dashframe.spec import ColumnType


@dataclass
class Ingested:
    table: DataFrame
    types: dict
    profile: DataFrame | None = None


def ingest(df: DataFrame, name: str, overrides: dict | None = None,
           keep: bool = True, approx_types: bool = False) -> Ingested:
    """Detect column types (one job over a frequency table, or over sketches
    with ``approx_types``), let the caller's overrides win, cast in one
    projection, and (``keep``) store the typed table under the shared folder,
    returning the stored copy and the profile of what was read."""
    profile = None if approx_types else table_profile(df)
    found = detect_types(df, approx=True) if approx_types else profile
    # One row per column comes to the driver.
    detected = {r["column_name"]: r["column_type"]
                for r in found.select("column_name", "column_type").collect()}
    chosen = {c: ColumnType((overrides or {}).get(c, detected.get(c, "unknown")))
              for c in df.columns}
    typed = apply_types(df, chosen)
    return Ingested(store(typed, name) if keep else typed, chosen, profile)

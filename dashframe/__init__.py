"""dashframe: dashboard analytics (profile, clean, measure, filter, aggregate,
chart datasets, catalog) as Spark DataFrame -> DataFrame operators."""

from dashframe.session import get_session, shared_dir
from dashframe.spec import (
    AggregationConfig,
    ChartSpec,
    ColumnType,
    FilterCondition,
    Measure,
    VisualizationType,
)

__all__ = [
    "AggregationConfig",
    "ChartSpec",
    "ColumnType",
    "FilterCondition",
    "Measure",
    "VisualizationType",
    "get_session",
    "shared_dir",
]

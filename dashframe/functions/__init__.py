"""Column-level expressions (JVM-side ``pyspark.sql.functions`` only)."""

from dashframe.functions.columns import col
from dashframe.functions.measures import parse_measure, compose_expression

__all__ = ["col", "parse_measure", "compose_expression"]

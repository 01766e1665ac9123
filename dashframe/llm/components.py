"""Connected components of an edge table by distributed min-contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dashframe.llm.common import stored


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a``, ``b``);
    the component is the smallest node reachable.

    Each round links every neighbour of a node to the smallest of them and
    keeps distinct links, until the links are stars around the smallest node.
    Rounds are written to the shared folder; the driver sees two numbers each.
    """
    links = stored(edges.where(F.col("a") != F.col("b"))
                   .select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("m")).distinct(),
                   f"{name}-links")
    state = _state(links)
    while state[0]:
        both = links.select(F.col("x").alias("u"), F.col("m").alias("v")).unionAll(
            links.select(F.col("m").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select(
            "u", F.least("u", "v").alias("m"))
        links = stored(both.join(least, "u").select(F.col("v").alias("x"), "m")
                       .unionAll(least.select(F.col("u").alias("x"), "m"))
                       .where("x != m").distinct(), f"{name}-links")
        now = _state(links)
        if now == state:
            break
        state = now
    nodes = links.select(F.col("x").alias("node"), F.col("m").alias("component"))
    return nodes.unionAll(links.select(F.col("m").alias("node"), F.col("m").alias("component"))
                          .distinct())


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "m").cast("decimal(38,0)"))).first()
    return r[0], r[1]

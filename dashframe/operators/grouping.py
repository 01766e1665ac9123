"""What a visual asks of its table, apart from how it is answered.

Column, bar, line, area, pie and heatmap charts and metric cards all read
``group by keys, aggregate measures``.  A :class:`Grouping` states that; it is
answered by an aggregate of its own (:func:`grouped`) or, with those of other
visuals over the same rows, by one scan with grouping sets
(:func:`grouped_together`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dashframe.functions.columns import col
from dashframe.operators.aggregate import chart_agg_expr


@dataclass(frozen=True)
class Grouping:
    """``keys``: (name, column) pairs; ``measures``: (name, column, function)
    triples.  ``as_text`` groups by the keys' text and leaves NULL keys out."""
    keys: tuple[tuple[str, str], ...]
    measures: tuple[tuple[str, str, str], ...]
    as_text: bool = False


def _key(column: str, as_text: bool) -> Column:
    return col(column).cast("string") if as_text else col(column)


def grouped(df: DataFrame, g: Grouping) -> DataFrame:
    """The rows of one grouping: its keys and measures by name."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if g.as_text:
        for _, c in g.keys:
            df = df.where(col(c).isNotNull())
    return df.groupBy(*[_key(c, g.as_text).alias(k) for k, c in g.keys]).agg(
        *[chart_agg_expr(col(y), fn, types[y]).alias(name) for name, y, fn in g.measures])


def _sets(groupings: list[Grouping]):
    """Key columns, wanted key sets and aggregates, each once."""
    keys = list(dict.fromkeys((c, g.as_text) for g in groupings for _, c in g.keys))
    sets = list(dict.fromkeys(tuple(sorted(keys.index((c, g.as_text)) for _, c in g.keys)) for g in groupings))
    aggs = list(dict.fromkeys((y, fn) for g in groupings for _, y, fn in g.measures))
    return keys, sets, aggs


def grouping_sets(df: DataFrame, groupings: list[Grouping]) -> DataFrame:
    """All groupings' rows from one scan: ``set`` (which key set a row is of),
    ``k0 ...`` and ``a0 ...``.  Rows are expanded once a key set and aggregated
    before they are shuffled."""
    keys, sets, aggs = _sets(groupings)
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = list(dict.fromkeys(y for y, _ in aggs))
    rows = df.select(*[_key(c, t).alias(f"k{i}") for i, (c, t) in enumerate(keys)],
                     *[col(y).alias(f"m{i}") for i, y in enumerate(columns)])
    values = [chart_agg_expr(F.col(f"m{columns.index(y)}"), fn, types[y]).alias(f"a{i}")
              for i, (y, fn) in enumerate(aggs)]
    names = [f"k{i}" for i in range(len(keys))]
    # A key outside the set of a row has its bit, counted from the last key, set.
    mark = {sum(1 << (len(keys) - 1 - i) for i in range(len(keys)) if i not in s): n for n, s in enumerate(sets)}
    if not keys:
        return rows.agg(*values).select(F.lit(0).alias("set"), "*")
    out = rows.groupingSets([[F.col(f"k{i}") for i in s] for s in sets], *names).agg(
        F.grouping_id(*names).alias("__mark"), *values)
    marks = F.create_map(*[F.lit(x) for m, n in mark.items() for x in (m, n)])
    return out.select(marks[F.col("__mark").cast("int")].alias("set"), *names,
                      *[f"a{i}" for i in range(len(aggs))])


def one_of(together: DataFrame, groupings: list[Grouping], g: Grouping) -> DataFrame:
    """The rows of ``g`` among those of :func:`grouping_sets`."""
    keys, sets, aggs = _sets(groupings)
    at = [keys.index((c, g.as_text)) for _, c in g.keys]
    rows = together.where(F.col("set") == sets.index(tuple(sorted(at))))
    if g.as_text:
        for i in at:
            rows = rows.where(F.col(f"k{i}").isNotNull())
    values = [F.col(f"a{aggs.index((y, fn))}") for _, y, fn in g.measures]
    if not g.keys:
        # An empty table has no row of the empty set, but one of results.
        none = F.count(F.lit(1)) == 0
        values = [F.when(none, F.lit(0)).otherwise(F.max(v)) if fn in ("sum", "count") else F.max(v)
                  for v, (_, _, fn) in zip(values, g.measures)]
        return rows.agg(*[v.alias(n) for v, (n, _, _) in zip(values, g.measures)])
    return rows.select(*[F.col(f"k{i}").alias(n) for i, (n, _) in zip(at, g.keys)],
                       *[v.alias(n) for v, (n, _, _) in zip(values, g.measures)])

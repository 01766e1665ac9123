"""Exact order statistics per group without gathering a group in one task.

Medians, quartiles and box-plot positions all need "the value at sorted
position k of group g".  Shuffling a near-unique column to sort it costs the
whole column, so the position is bracketed first:

1. one pass makes a mergeable KLL sketch per group.  Of a group with more than
   ``LEAST`` values, and among those with most values (``HEAVY`` at most, so that
   they can be broadcast), the sketch gives *thresholds*: the values a little
   below, at and a little above every wanted fraction, and some of equal depth.
   Any other group is light: it holds at most ``LEAST`` values or less than a
   ``HEAVY``-th of all rows, and is sorted as it is;
2. a second pass counts.  The thresholds cut a group into *cells*; a value inside
   a bracket is kept with its count, of values outside only their number and
   range are, before anything is shuffled.  The cells' counts place every cell
   in its group, and a running count inside a cell places its values.  A wanted
   position falls on a value, or, where the sketch was further off than the
   margin, on the range of a cell's other values;
3. a third pass looks these ranges up among the rows of the heavy groups: one
   value mostly, the range's values in order otherwise.

The answer is exact whatever the sketches say; they only decide how many values
are shuffled: ``2 * MARGIN`` of a heavy group for every fraction.  All of it is
one lazy plan.  Sketches are random, so two evaluations (without reuse of an
exchange, or after the loss of an executor) may cut differently; hence each of
a plan's branches reads the thresholds once, and what it hands on (a value's or
a range's place in the group) is true whichever they were.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dashframe.functions.columns import col

K = 2048              # of the KLL sketches: a rank error of 0.14 % with 99 % confidence
MARGIN = 0.003        # of a bracket on either side of its fraction
DEPTHS = 4            # equal parts that a missed position is looked for in
LEAST = 4096          # values above which a group is bracketed
HEAVY = 1024          # bracketed groups

# A wanted position: about which fraction of the group it is, and the 0-based
# position itself, a function of the group's size.
Position = tuple[float, "callable"]


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
               also: str | None = None) -> DataFrame:
    """Join on keys that may be NULL (and on a condition)."""
    named = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    on = " AND ".join([f"{k} <=> {k}__r" for k in keys] + ([also] if also else []))
    return left.join(named, F.expr(on), how).drop(*[f"{k}__r" for k in keys])


def _number(kind: T.DataType, v: Column) -> Column | None:
    """The value as a double in the same order; None for types without one."""
    if isinstance(kind, T.NumericType):
        return v.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(v).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(v.cast("timestamp")).cast("double")
    return None


def _base(df: DataFrame, group_cols: list[str], value_col: str) -> tuple[DataFrame, list[str], bool]:
    """``gk, __v, __x`` of the non-null values, the keys' names, and whether
    there is a number ``__x`` to sketch.  A whole table is one group, under a
    key that is no literal, as joins on literals lose their key."""
    gk = [f"__g{i}" for i in range(max(1, len(group_cols)))]
    keys = [col(k) for k in group_cols] or [F.spark_partition_id() < 0]
    rows = df.where(col(value_col).isNotNull())
    rows = rows.select(*[k.alias(g) for g, k in zip(gk, keys)], col(value_col).alias("__v"))
    x = _number(rows.schema["__v"].dataType, F.col("__v"))
    return rows.withColumn("__x", F.lit(None).cast("double") if x is None else x), gk, x is not None


def _ranks(fractions: list[float]) -> list[float]:
    around = {min(1.0, max(0.0, q + m)) for q in fractions for m in (-MARGIN, 0.0, MARGIN)}
    return sorted(around | {i / DEPTHS for i in range(1, DEPTHS)} | {0.0, 1.0})


def _thresholds(base: DataFrame, gk: list[str], ranks: list[float]) -> DataFrame:
    """``gk, __t0 ...`` of the heavy groups, ``HEAVY`` rows at most."""
    sketch = base.groupBy(*gk).agg(F.count(F.lit(1)).alias("__size"),
                                   F.kll_sketch_agg_double("__x", F.lit(K)).alias("__kll"))
    # NaN is no part of a sketch; a group of nothing else has no thresholds.
    known = F.when(F.kll_sketch_get_n_double("__kll") > 0,
                   F.kll_sketch_get_quantile_double("__kll", F.array(*map(F.lit, ranks))))
    most = sketch.where(F.col("__size") > LEAST).select(*gk, "__size", known.alias("__at")) \
        .orderBy(F.desc("__size"), *gk).limit(HEAVY)
    return most.selectExpr(*gk, *[f"__at[{i}] AS __t{i}" for i in range(len(ranks))],
                           "TRUE AS __heavy")


def _celled(base: DataFrame, gk: list[str], fractions: list[float]) -> DataFrame:
    """``gk, __v, __cell, __inside, __light``; a light group is one cell, all
    inside."""
    ranks = _ranks(fractions)
    t = {r: f"__t{i}" for i, r in enumerate(ranks)}

    def within(q):
        if q <= 0.0:
            return f"__x <= {t[0.0]}"
        if q >= 1.0:
            return f"__x >= {t[1.0]}"
        return f"__x BETWEEN {t[max(0.0, q - MARGIN)]} AND {t[min(1.0, q + MARGIN)]}"

    cell = " + ".join(f"IF(__x >= {c}, 1, 0)" for c in t.values())
    inside = " OR ".join(["__heavy IS NULL", *map(within, fractions)])
    rows = _null_safe(base, F.broadcast(_thresholds(base, gk, ranks)), gk, "left")
    return rows.selectExpr(*gk, "__v", f"{cell} AS __cell", f"COALESCE({inside}, FALSE) AS __inside",
                           "__heavy IS NULL AS __light")


def _frequencies(rows: DataFrame, gk: list[str]) -> DataFrame:
    """``gk, __cell, __v, __cnt, __lo, __hi, __light``: values inside a bracket
    with their counts, and NULL with the number and range of the cell's other
    values, which follow them."""
    return rows.groupBy(*gk, "__cell", F.when(F.col("__inside"), F.col("__v")).alias("__v")).agg(
        F.count(F.lit(1)).alias("__cnt"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
        F.bool_and("__light").alias("__light"))


def cell_sizes(df: DataFrame, group_cols: list[str], value_col: str,
               fractions: list[float]) -> DataFrame:
    """Per (group, cell): its rows, and how many distinct values of it are
    shuffled -- how a hot group is spread over tasks."""
    base, gk, _ = _base(df, group_cols, value_col)
    return _frequencies(_celled(base, gk, fractions), gk).groupBy(*gk, "__cell").agg(
        F.sum("__cnt").alias("rows"), F.count("__v").alias("shuffled"))


def _placed(freq: DataFrame, gk: list[str], last_cell: int) -> DataFrame:
    """``freq`` with the group's size ``__n`` and the positions ``[__start,
    __end)`` of every row.  Each row also tells all cells of its group whether it
    lies before them; these tellings are summed before they are shuffled, so
    that a cell is placed without a second look at the counts."""
    told = (f"TRANSFORM(SEQUENCE(0, IF(__light, 0, {last_cell})), c -> STRUCT(c AS __cell, 0 AS __own,"
            " CAST(NULL AS {kind}) AS __v, CAST(NULL AS {kind}) AS __lo, CAST(NULL AS {kind}) AS __hi, 0L AS __cnt,"
            " IF(__cell < c, __cnt, 0L) AS __before, __cnt AS __n))"
            ).format(kind=freq.schema["__v"].dataType.simpleString())
    own = ("ARRAY(STRUCT(__cell, 1 AS __own, __v, __lo, __hi, __cnt, 0L AS __before, 0L AS __n))")
    rows = freq.selectExpr(*gk, "__light", f"INLINE(CONCAT({own}, {told}))")
    rows = rows.groupBy(*gk, "__cell", "__own", "__v").agg(
        F.bool_and("__light").alias("__light"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"),
        *[F.sum(c).alias(c) for c in ("__cnt", "__before", "__n")])
    w = (Window.partitionBy(*gk, "__cell").orderBy("__own", F.asc_nulls_last("__v"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.select(*gk, "__own", "__light", "__v", "__lo", "__hi", "__cnt", F.sum("__n").over(w).alias("__n"),
                        (F.sum("__before").over(w) + F.sum("__cnt").over(w)).alias("__end"))
            .where("__own = 1").withColumn("__start", F.col("__end") - F.col("__cnt")))


def rank_select(df: DataFrame, group_cols: list[str], value_col: str,
                positions: dict[str, Position]) -> DataFrame:
    """For each group: ``n`` (non-null count) and, per entry of ``positions``,
    the value at its 0-based sorted position."""
    base, gk, numbers = _base(df, group_cols, value_col)
    fractions = sorted({q for q, _ in positions.values()})
    at = {name: fn(F.col("__n")) for name, (_, fn) in positions.items()}
    covers = reduce(lambda a, b: a | b,
                    ((F.col("__start") <= p) & (p < F.col("__end")) for p in at.values()))
    rows = _celled(base, gk, fractions) if numbers else base.selectExpr(
        *gk, "__v", "0 AS __cell", "TRUE AS __inside", "TRUE AS __light")
    hits = _placed(_frequencies(rows, gk), gk, len(_ranks(fractions))).where(covers)
    # Both branches read the same columns, so that Spark can share what is below.
    found = hits.where("__light").select(*gk, "__n", "__start", "__end",
                                         F.when(F.col("__lo") <= F.col("__hi"), F.col("__v")).alias("__v"))
    if numbers:
        ranges = hits.where("NOT __light").select(*gk, "__n", F.col("__start").alias("__from"), "__lo", "__hi")
        # HEAVY groups, a row a position.
        rest = _null_safe(base, F.broadcast(ranges), gk, also="__v BETWEEN __lo AND __hi") \
            .groupBy(*gk, "__from", "__n", "__v").agg(F.count(F.lit(1)).alias("__cnt"))
        w = (Window.partitionBy(*gk, "__from").orderBy("__v")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rest = rest.withColumn("__end", F.col("__from") + F.sum("__cnt").over(w)) \
            .withColumn("__start", F.col("__end") - F.col("__cnt")).where(covers)
        found = found.unionByName(rest.select(*gk, "__n", "__start", "__end", "__v"))
    aggs = [F.max(F.when((F.col("__start") <= p) & (p < F.col("__end")), F.col("__v"))).alias(name)
            for name, p in at.items()]
    out = found.groupBy(*gk).agg(F.max("__n").alias("n"), *aggs)
    return out.select(*[F.col(f"__g{i}").alias(k) for i, k in enumerate(group_cols)], "n",
                      *positions.keys())


def quantile_positions(name: str, q: float) -> dict[str, Position]:
    """Positions for a linearly interpolated quantile at fraction q:
    ``(n - 1) * q`` rounded down and up."""
    return {
        f"{name}__lo": (q, lambda n: F.floor((n - 1) * F.lit(q)).cast("long")),
        f"{name}__hi": (q, lambda n: F.ceil((n - 1) * F.lit(q)).cast("long")),
    }


def interpolate(name: str, q: float) -> Column:
    lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
    frac = (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    return (lo + (hi - lo) * frac).alias(name)


def grouped_quantiles(df: DataFrame, group_cols: list[str], value_col: str,
                      quantiles: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles (``median`` = 0.5) per group:
    columns ``group_cols + [n] + list(quantiles)``."""
    positions: dict = {}
    for name, q in quantiles.items():
        positions.update(quantile_positions(name, q))
    picked = rank_select(df.withColumn("__qv", col(value_col).cast("double")),
                         group_cols, "__qv", positions)
    return picked.select(*[col(k) for k in group_cols], "n",
                         *[interpolate(name, q) for name, q in quantiles.items()])


def box_positions() -> dict[str, Position]:
    """Sorted values at n//4, n//2, 3n//4, plus first and last."""
    return {
        "lower": (0.0, lambda n: F.lit(0).cast("long")),
        "q1": (0.25, lambda n: F.floor(n / 4).cast("long")),
        "median": (0.5, lambda n: F.floor(n / 2).cast("long")),
        "q3": (0.75, lambda n: F.floor(n * 3 / 4).cast("long")),
        "upper": (1.0, lambda n: (n - 1).cast("long")),
    }


def approx_grouped_quantiles(df: DataFrame, group_cols: list[str], value_col: str,
                             quantiles: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """Approximate quantiles per group (``percentile_approx``: bounded memory
    per group, rank error about 1/accuracy).  Named approximate on purpose;
    the exact path is :func:`grouped_quantiles`."""
    names, qs = list(quantiles), [quantiles[k] for k in quantiles]
    v = col(value_col).cast("double")
    agg = df.where(v.isNotNull()).groupBy(*[col(k) for k in group_cols]).agg(
        F.count(v).alias("n"), F.percentile_approx(v, qs, accuracy).alias("__q"))
    return agg.select(*[col(k) for k in group_cols], "n",
                      *[F.col("__q")[i].alias(name) for i, name in enumerate(names)])

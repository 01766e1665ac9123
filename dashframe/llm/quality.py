"""Quality rules with robust multivariate outliers (operator 8).

Per document: word and line counts of the whole text (:func:`text_stats`), two
fixed rules (``base_failed``), and a verdict by the minimum covariance
determinant: within each language and source, the mean and covariance of the
``H`` share of documents whose covariance has the least determinant, searched
by concentration steps from ``STARTS`` starts: median and MAD, three robust
shapes of all documents, and covariances of eight documents drawn by hash.  All
make ``WARM`` steps, the ``BEST`` of them go on until they settle, and the one
of least determinant is taken.  It is then reweighted; a document whose
transformed statistics lie in squared Mahalanobis distance beyond the
``CUTOFF`` point of the chi-square of their number is rejected.

Every step is a grouped aggregate over all documents of a group: moments, and
a histogram of log distances whose bins give the nearest ``H`` share (documents
in the bin where it is reached weigh what is left of it), so no group meets in
one task and ties don't depend on the order of rows.  Tasks take the distances
and sum by batch; the aggregates add the batches up.  Groups that hold much of
the rows meet their estimates by a broadcast, the others by a shuffle.
Groups of fewer than ``LEAST`` documents are pooled by language, pools that
are still smaller over all languages; a last pool that is too small has no
estimate and rejects nothing.

Defined cases: NULL text has no words; empty and wordless texts fail the base
rules; NULL language and NULL source are groups of their own; repeated rows
count and return as often as they occur; a NULL id is an id like another; an
empty table gives an empty result; texts are read whole, however long; other
columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dashframe.llm.common import (binary_values, gram_hashes, join_by_key, slices, stored, text_key,
                                  word_hashes)

REPEAT = 8            # words of a repeat window
H = 0.75              # share of a group that the estimate rests on
STARTS = 8            # starts a group: four from all its documents, four drawn
WARM = 2              # concentration steps that every start makes
BEST = 2              # starts that go on until they settle
SETTLED = 1e-3        # least fall of the determinant's logarithm that counts
BINS = 1024           # histogram bins per factor e of a squared distance
LEAST = 50            # documents of a group with an estimate of its own
CUTOFF = 0.9999       # chi-square share beyond which a squared distance is rejected
# Least standard deviation per statistic.  Most documents have no symbol, no
# repeated line and no repeated window, so the subset's own spread is nil.  One
# repeated line in 285 words is 0.3, a repeated window of 9 in 900 words 0.1.
FLOOR = (0.1, 0.02, 0.1, 0.3, 0.1, 0.05, 0.05)
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_DIM = 7
_PAIRS = [(i, j) for i in range(_DIM) for j in range(i, _DIM)]


def repeated_words(h: np.ndarray) -> int:
    """Words inside windows of REPEAT words that the text has twice or more."""
    g = gram_hashes(h, REPEAT)
    if len(g) < 2:
        return 0
    _, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    if not len(at):
        return 0
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + REPEAT, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def stats_of(text: bytes | None) -> tuple[int, ...]:
    """The values of _STATS; n_upper counts A-Z, n_marks ASCII punctuation."""
    if not text:
        return (0,) * len(_STATS)
    words = text.split()
    joined = b"".join(words)
    follow = np.frombuffer(joined, np.uint8) & 0xC0 == 0x80
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(joined) - int(follow.sum()),
            len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(word_hashes(words)), len(text) - len(text.translate(None, _UPPER)),
            len(text) - len(text.translate(None, _MARKS)))


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_upper", "n_marks")


def text_stats(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, lang, source`` and the statistics per row."""

    def run(batches):
        for b in slices(batches):
            rows = [stats_of(t) for t in binary_values(b, "text")]
            cols = list(zip(*rows)) if rows else [()] * len(_STATS)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "text_key", "lang", "source")]
                + [pa.array(c, pa.int64()) for c in cols],
                names=["doc_id", "text_key", "lang", "source", *_STATS])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, text_key long, lang string, source string, "
             + ", ".join(f"{c} long" for c in _STATS))


def _vector() -> list[Column]:
    n = F.col("n_words")
    return [F.log1p(n), F.log(F.col("word_chars") / n),
            F.log1p(100 * F.col("n_symbols") / F.col("word_chars")),
            F.log1p(100 * F.col("n_dup_lines") / n),
            F.asin(F.sqrt(F.col("n_repeat_words") / n)),
            F.asin(F.sqrt(F.col("n_upper") / F.col("word_chars"))),
            F.asin(F.sqrt(F.col("n_marks") / F.col("word_chars")))]


def _x(i: int) -> Column:
    return F.col(f"x{i}")


def _pools(rows: DataFrame) -> DataFrame:
    """``g0, g, n``: the group that an estimate comes from for each language
    and source, and their documents."""
    sizes = rows.groupBy("g0", "g1").agg(F.count(F.lit(1)).alias("n"))
    pool = sizes.withColumn(
        "n1", F.sum(F.when(F.col("n") < LEAST, F.col("n"))).over(Window.partitionBy("g1")))
    return pool.select("g0", F.when(F.col("n") >= LEAST, F.col("g0"))
                       .when(F.col("n1") >= LEAST, F.concat(F.col("g1"), F.lit("\tpool")))
                       .otherwise(F.lit("pool")).alias("g"), "n")


def _distance() -> Column:
    """Squared distance from the estimate in columns ``mean`` and ``inverse``."""
    d = [_x(i) - F.col("mean")[i] for i in range(_DIM)]
    terms = [F.col("inverse")[k] * d[i] * d[j] * (1 if i == j else 2)
             for k, (i, j) in enumerate(_PAIRS)]
    return F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, terms))


def _distances(b: pa.RecordBatch) -> np.ndarray:
    """``_distance`` of a batch's rows: 0 where a value is NULL."""

    def columns(name, n):
        return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, n).T

    d = _values(b) - columns("mean", _DIM)
    terms = [v * d[i] * d[j] * (1 if i == j else 2)
             for v, (i, j) in zip(columns("inverse", len(_PAIRS)), _PAIRS)]
    return np.fmax(0.0, reduce(lambda x, y: x + y, terms))


def _values(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(_DIM)])


def _bins(b: pa.RecordBatch) -> np.ndarray:
    return np.floor(np.log(_distances(b) + 1e-9) * BINS)


def _by_start(b: pa.RecordBatch, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(``g`` and ``s`` of the kinds of the batch's rows ``at``; of each row its kind)"""
    g = b.column("g").dictionary_encode(null_encoding="encode")
    s = b.column("s").to_numpy(zero_copy_only=False).astype(np.int64)
    codes = (g.indices.to_numpy(zero_copy_only=False).astype(np.int64) * STARTS + s)[at]
    kinds, kind = np.unique(codes, return_inverse=True)
    return g.dictionary.take(pa.array(kinds // STARTS)), kinds % STARTS, kind


def _histogram(batches):
    """Rows of ``_at_starts``: ``g, s, bin, c``, counts by batch."""
    for b in batches:
        g, s, kind = _by_start(b, np.arange(b.num_rows))
        pairs, count = np.unique(np.stack([kind, _bins(b).astype(np.int64)]), axis=1, return_counts=True)
        of, bins = pairs
        yield pa.RecordBatch.from_arrays(
            [g.take(pa.array(of)), pa.array(s[of], pa.int32()), pa.array(bins, pa.int64()),
             pa.array(count, pa.int64())], names=["g", "s", "bin", "c"])


_SUMS = [f"s{i}" for i in range(_DIM)] + [f"s{i}{j}" for i, j in _PAIRS]


def _sums(weight):
    """Rows of ``_at_starts``, each of the weight that ``weight`` gives it:
    the weighted sums ``g, s, w, s0 ...``, by batch."""

    def run(batches):
        for b in batches:
            w = weight(b)
            at = np.flatnonzero(w > 0)
            g, s, kind = _by_start(b, at)
            w, x = w[at], np.nan_to_num(_values(b)[:, at])   # NULL adds nothing
            columns = [w, *[w * v for v in x], *[w * x[i] * x[j] for i, j in _PAIRS]]
            yield pa.RecordBatch.from_arrays(
                [g, pa.array(s, pa.int32()), *[pa.array(np.bincount(kind, c, len(s))) for c in columns]],
                names=["g", "s", "w", *_SUMS])

    return run


def _nearest(b: pa.RecordBatch) -> np.ndarray:
    """1 below the bin where the H share is reached, the rest of it within."""
    bins, edge = _bins(b), b.column("edge").to_numpy(zero_copy_only=False)
    share = b.column("share").to_numpy(zero_copy_only=False)
    return np.where(bins < edge, 1.0, np.where(bins == edge, share, 0.0))


def _moments(rows: DataFrame) -> DataFrame:
    """Weighted sums of each group and start, for rows with a weight ``w``."""
    return rows.groupBy("g", "s").agg(
        F.sum("w").alias("w"), *[F.sum(F.col("w") * _x(i)).alias(f"s{i}") for i in range(_DIM)],
        *[F.sum(F.col("w") * _x(i) * _x(j)).alias(f"s{i}{j}") for i, j in _PAIRS])


def _shape(r) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from a row of sums."""
    mean = np.array([getattr(r, f"s{i}") for i in range(_DIM)]) / r.w
    cov = np.zeros((_DIM, _DIM))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = getattr(r, f"s{i}{j}") / r.w - mean[i] * mean[j]
    return mean, cov


def _upper_of(m: np.ndarray) -> list[float]:
    return [float(m[i, j]) for i, j in _PAIRS]


def _weighted(rows: DataFrame, weight) -> DataFrame:
    """As ``_moments`` of rows of ``_at_starts``, whose weights tasks take from
    their distances: no plan repeats the distance's terms."""
    parts = rows.mapInArrow(_sums(weight), "g string, s int, w double, " + ", ".join(f"{c} double" for c in _SUMS))
    return parts.groupBy("g", "s").agg(*[F.sum(c).alias(c) for c in ("w", *_SUMS)])


_ESTIMATE = "g string, s int, w double, mean array<double>, inverse array<double>, logdet double"


def _estimates(moments: DataFrame, scale: float) -> DataFrame:
    """``_ESTIMATE`` from the sums of each group and start: the covariance with
    the floors on its diagonal, and the logarithm of its determinant."""

    def run(parts):
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                mean, cov = _shape(r)
                cov = cov * scale + np.diag(np.square(FLOOR))
                out.append((r.g, int(r.s), float(r.w), mean.tolist(), _upper_of(np.linalg.inv(cov)),
                            float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(out, columns=["g", "s", "w", "mean", "inverse", "logdet"])

    return moments.where("w > 0").mapInPandas(run, _ESTIMATE)


def _by_group(estimates: DataFrame, sizes: DataFrame) -> DataFrame:
    """``g, n, starts``: one row a group, its starts (at most STARTS) in an array."""
    named = F.struct(*[c for c in estimates.columns if c != "g"])
    return sizes.join(estimates.groupBy("g").agg(F.collect_list(named).alias("starts")), "g")


def _at_starts(rows: DataFrame, side: DataFrame) -> DataFrame:
    """Each row once for every start of its group, beside the start's columns."""
    return join_by_key(rows, side, "g", "n").select(
        "g", *[f"x{i}" for i in range(_DIM)], F.explode("starts").alias("e")).select(
        "g", *[f"x{i}" for i in range(_DIM)], "e.*")


def _first(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The starts of every group as ``_ESTIMATE`` (shapes; no determinant yet).

    0: median and MAD.  1 to 3, on values standardised by these: the covariance
    of their tanh, of their directions, and of those within the normal half.
    From 4 on: the covariance of ``_DIM + 1`` documents drawn by hash."""
    mid = stored(_by_columns(rows, [F.percentile_approx(_x(i), 0.5, 1000) for i in range(_DIM)],
                             "mid").join(sizes, "g"), "op8-middle")
    dev = _by_columns(join_by_key(rows, mid, "g", "n"), [
        F.percentile_approx(F.abs(_x(i) - F.col("mid")[i]), 0.5, 1000) for i in range(_DIM)], "mad")
    unit = F.array(*[F.sqrt(F.pow(1.4826 * F.col("mad")[i], F.lit(2)) + FLOOR[i] ** 2)
                     for i in range(_DIM)])
    mid = stored(mid.join(dev, "g").select("g", "n", "mid", unit.alias("unit")), "op8-scale")
    z = [(_x(i) - F.col("mid")[i]) / F.col("unit")[i] for i in range(_DIM)]
    norm = F.sqrt(reduce(lambda a, b: a + b, [v * v for v in z]))
    placed = join_by_key(rows, mid.withColumn("size", F.col("n")), "g", "n").select(
        "g", "h", "size", norm.alias("norm"), *[v.alias(f"x{i}") for i, v in enumerate(z)])

    def with_values(s, f):
        return F.struct(F.lit(s).alias("s"), *[f(_x(i)).alias(f"x{i}") for i in range(_DIM)])

    shapes = F.array(
        with_values(1, F.tanh),
        with_values(2, lambda v: F.when(F.col("norm") > 0, v / F.col("norm") * _DIM ** 0.5).otherwise(0.0)),
        F.when(F.col("norm") ** 2 <= _chi2_point(0.5), with_values(3, lambda v: v)))
    whole = placed.select("g", F.explode(F.filter(shapes, lambda e: e.isNotNull())).alias("e")) \
        .select("g", "e.*")
    # A few dozen rows a group and start, by the group's size; the first of them are drawn.
    draw = F.pmod(F.xxhash64("h", "s"), F.lit(1 << 40))
    few = placed.withColumn("s", F.explode(F.array(*[F.lit(s) for s in range(4, STARTS)]))) \
        .withColumn("draw", draw).where(F.col("draw") * F.col("size") < float(32 << 40))
    order = Window.partitionBy("g", "s").orderBy("draw", "h", *[f"x{i}" for i in range(_DIM)])
    drawn = few.withColumn("at", F.row_number().over(order)).where(F.col("at") <= _DIM + 1)
    columns = ["g", "s", *[f"x{i}" for i in range(_DIM)]]
    sums = _moments(whole.select(columns).unionAll(drawn.select(columns)).withColumn("w", F.lit(1.0)))

    def run(parts):
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                mean, cov = _shape(r)
                if r.s in (1, 2):
                    mean = np.zeros(_DIM)
                unit = np.array(r.unit)
                cov = cov * np.outer(unit, unit) + np.diag(np.square(FLOOR))
                out.append((r.g, int(r.s), float(r.w), (np.array(r.mid) + mean * unit).tolist(),
                            _upper_of(np.linalg.inv(cov)), float("inf")))
            yield pd.DataFrame(out, columns=["g", "s", "w", "mean", "inverse", "logdet"])

    precision = [F.pow(F.col("unit")[i], F.lit(-2)) if i == j else F.lit(0.0) for i, j in _PAIRS]
    plain = mid.select("g", F.lit(0).alias("s"), F.col("n").cast("double").alias("w"),
                       F.col("mid").alias("mean"), F.array(*precision).alias("inverse"),
                       F.lit(float("inf")).alias("logdet"))
    return sums.join(mid.drop("n"), "g").mapInPandas(run, _ESTIMATE).unionAll(plain)


def _by_columns(rows: DataFrame, values: list[Column], name: str) -> DataFrame:
    return rows.groupBy("g").agg(F.array(*values).alias(name))


def _concentrated(rows: DataFrame, side: DataFrame, sizes: DataFrame) -> DataFrame:
    """``_ESTIMATE`` of the H share of each group nearest to each of its starts.
    Rows in the bin where the share is reached weigh what is left of it."""
    counts = _at_starts(rows, side).mapInArrow(_histogram, "g string, s int, bin long, c long") \
        .groupBy("g", "s", "bin").agg(F.sum("c").alias("c"))
    upto = Window.partitionBy("g", "s").orderBy("bin")
    left = H * F.sum("c").over(Window.partitionBy("g", "s")) - (F.sum("c").over(upto) - F.col("c"))
    edge = (counts.withColumn("left", left).where("left > 0").groupBy("g", "s")
            .agg(F.max("bin").alias("edge"), F.min_by(F.least(F.lit(1.0), F.col("left") / F.col("c")),
                                                      -F.col("bin")).alias("share")))
    starts = side.select("g", F.explode("starts").alias("e")).select("g", "e.*")
    side = stored(_by_group(starts.join(edge, ["g", "s"]), sizes), "op8-edges")
    return _estimates(_weighted(_at_starts(rows, side), _nearest), _consistency(H))


def least_determinant(rows: DataFrame) -> DataFrame:
    """``_ESTIMATE`` and ``n`` per group ``g`` of rows ``g, h, x0..x6``: of all
    starts the estimate whose covariance has the least determinant.

    All starts make WARM concentration steps; then the BEST of each group go on
    until a step no longer lowers the logarithm of the determinant by SETTLED,
    which a determinant bounded by the floors can do a finite number of times."""
    sizes = stored(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "op8-sizes")
    now = stored(_first(rows, sizes).withColumn("going", F.lit(True)), "op8-starts")
    step = 0
    while not now.where("going").isEmpty():
        side = stored(_by_group(now.where("going").drop("going"), sizes), "op8-side")
        new = _concentrated(rows, side, sizes)
        old = now.select("g", "s", F.struct("w", "mean", "inverse", "logdet").alias("old"), "going")
        both = old.join(new.select("g", "s", F.struct("w", "mean", "inverse", "logdet").alias("new")),
                        ["g", "s"], "left")
        fell = F.coalesce(F.col("new.logdet") < F.col("old.logdet") - SETTLED, F.lit(False))
        now = both.select("g", "s", F.when(F.coalesce(F.col("new.logdet") < F.col("old.logdet"), F.lit(False)),
                                           F.col("new")).otherwise(F.col("old")).alias("e"),
                          fell.alias("going")).select("g", "s", "e.*", "going")
        step += 1
        if step == WARM:
            now = now.withColumn("place", F.row_number().over(
                Window.partitionBy("g").orderBy("logdet", "s"))).where(F.col("place") <= BEST).drop("place")
        now = stored(now, "op8-step")
    best = now.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("logdet", "s")))
    return best.where("place = 1").drop("place", "going").join(sizes, "g")


def _chi2_cdf(x: float, k: int) -> float:
    """Lower regularised gamma by its series."""
    from math import exp, gamma
    a, z = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 500):
        term *= z / (a + i)
        total += term
    return total * z ** a * exp(-z) / gamma(a)


def _chi2_point(share: float) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, _DIM) < share else (lo, mid)
    return lo


def _consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` of a normal
    sample estimate the whole's."""
    return share / _chi2_cdf(_chi2_point(share), _DIM + 2)


REWEIGHT = 0.975


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key``, the statistics, ``base_failed``, ``distance``
    (squared, NULL without an estimate) and ``kept`` for every row."""
    n = F.col("n_words")
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    stats = stored(text_stats(docs).withColumn(
        "base_failed", (n < 20) | (100 * F.col("n_repeat_words") > 30 * n))
        .withColumn("g0", F.concat_ws("\t", name("lang"), name("source")))
        .withColumn("g1", name("lang")).drop("lang", "source"), "op8-stats")
    judged = stats.where(~F.col("base_failed"))
    rows = stored(join_by_key(judged, stored(_pools(judged), "op8-pools"), "g0", "n").drop("g0", "g1")
                  .select("*", F.xxhash64("doc_id", "text_key").alias("h"),
                          *[x.alias(f"x{i}") for i, x in enumerate(_vector())]), "op8-vectors")
    best = stored(least_determinant(rows), "op8-least")
    near = join_by_key(rows, best.select("g", "s", "mean", "inverse", "n"), "g", "n") \
        .select("g", "s", *[f"x{i}" for i in range(_DIM)], "mean", "inverse")
    point = _chi2_point(REWEIGHT)
    final = _estimates(_weighted(near, lambda b: (_distances(b) <= point).astype(float)),
                       _consistency(REWEIGHT)).where(F.col("w") >= LEAST // 2)
    side = stored(best.select("g", "n").join(final.select("g", "mean", "inverse"), "g", "left"),
                  "op8-final")
    scored = join_by_key(rows, side, "g", "n").select(
        "doc_id", "text_key", *_STATS, "base_failed",
        F.when(F.col("mean").isNotNull(), _distance()).alias("distance"))
    failed = stats.where("base_failed").select(
        "doc_id", "text_key", *_STATS, "base_failed", F.lit(None).cast("double").alias("distance"))
    return scored.unionAll(failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(
        F.col("distance") <= _chi2_point(CUTOFF), F.lit(True)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns as they were.  Rows of
    one id and text in several languages or sources are kept if one of them
    is."""
    good = quality(docs).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    return docs.join(good, docs["doc_id"].cast("long").eqNullSafe(good["__id"])
                     & (text_key(docs["text"]) == good["__key"]), "left_semi")

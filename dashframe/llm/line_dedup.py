"""Fuzzy line dedup by MinHash (operator 6, DataFrame functions only).

Lines (lower case, trimmed) are reduced to distinct ones; each gets the
minimum of ``BANDS * ROWS`` keyed hashes over all its shingles of ``SHINGLE``
characters (a shorter line is one shingle).  Only ids and minima are dealt, not
the lines.  Lines with an equal band meet in a bucket; every member is compared
with a head of the bucket, its line of most copies, and where that leaves lines
of several components, with a second one.  Buckets that still hold several
components are resolved whole: in small ones all pairs of different components
are compared, in crowded ones those that share a shingle of their prefixes (the
rarest shingles, one of which two similar lines must share).  Comparisons are by
the exact Jaccard similarity of the whole shingle sets; pairs whose marks (bits
of their shingles' hashes) differ by more than similar sets can are refuted
without making the sets.
Verified links go through distributed union-find, and one line per component
stays: its first in the document with the smallest id (of equal ids, the
document whose text has the smallest hash).

A pair of similarity 0.8 shares a band with probability
``1 - (1 - 0.8 ** ROWS) ** BANDS`` = 99.7 %, a pair of 0.9 with 99.999 %; what
shares a band is found.

Defined cases: blank lines are never dropped; NULL text has no line and stays
NULL, empty text has one blank line; a document without an id comes last;
rows with equal id and text are treated alike; other columns pass through.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dashframe.llm.common import nearly_among, stored, text_key
from dashframe.llm.components import components

SHINGLE = 9           # UTF-16 code units
ROWS = 3
BANDS = 8
HEAD_ROUNDS = 2
SMALL = 64            # lines of a bucket whose pairs are all compared
BEFORE = 8            # shingles ahead of one that tell whether a pair has met
CHUNK = 8             # shingles of a line that a row of the signing holds, a power of two
WORDS = 16            # longs of a line's marks
BLANKS = " \t\r\x0b\x0c"
_RANDOM = random.Random(7)
_BAND_KEYS = [b * (1 << 64) // BANDS - (1 << 63) + _RANDOM.getrandbits(60) for b in range(BANDS)]


def _trimmed(line: Column) -> Column:
    """Trimming counts all characters of a line: only where there are blanks."""
    ends = [f(line, F.lit(c)) for f in (F.startswith, F.endswith) for c in BLANKS]
    return F.when(reduce(Column.__or__, ends), F.btrim(line, F.lit(BLANKS))).otherwise(line)


def line_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, pos, norm, id`` of every non-blank line; ``id`` is a
    64-bit hash of the normalised line."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"),
                       F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line"))
    return rows.select("doc_id", "text_key", "pos", _trimmed(F.col("line")).alias("norm")) \
        .where("norm != ''").withColumn("id", F.xxhash64("norm"))


def _units(norm: str) -> Column:
    """UTF-16, of which a part is read without counting from the start."""
    return F.encode(norm, "UTF-16BE")


def _last(units: Column | str) -> Column:
    return F.greatest((F.octet_length(units) / 2).cast("int") - SHINGLE, F.lit(0))


def _shingle(units: str, byte: Column) -> Column:
    return F.xxhash64(F.substring(units, byte + 1, F.lit(2 * SHINGLE)))


def _shingles(units: str) -> Column:
    """The set of a line's shingle hashes."""
    # The lambda is interpreted: its argument is the place to read, without
    # arithmetic, and the units are an argument too, as a column of bytes would
    # be copied whole for every shingle.
    hashes = F.transform(F.array(units), lambda line: F.transform(
        F.sequence(F.lit(1), 2 * _last(line) + 1, F.lit(2)),
        lambda at: F.xxhash64(F.substring(line, at, F.lit(2 * SHINGLE)))))
    return F.array_distinct(F.element_at(hashes, 1))


def _chunks(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``h0_0 ...``, the hashes of CHUNK shingles a row;
    behind a line's last shingle it stands again, which no minimum or mark shows."""
    # Outer, although no array is empty: else a filter that makes the units and
    # the array once more is put below.
    rows = rows.select("*", _last("units").alias("last")) \
        .select("*", F.explode_outer(F.sequence(F.lit(0), F.col("last"), F.lit(CHUNK))).alias("at"))
    return rows.select(*keep, *[_shingle("units", 2 * F.least(F.col("at") + i, F.col("last"))).alias(f"h0_{i}")
                                for i in range(CHUNK)])


def _place() -> Column:
    """Orders documents: by id, those without one last, equal ids by their text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("of"), F.col("text_key").alias("key"))


def _least(row: int, band: int) -> Column:
    """The minimum of a band's row: each row has a hash of its own, and under
    the bands' keys, which lead to as many parts of its range, a minimum is the
    hash nearest to a key."""
    least = [F.col(f"h{row}_{i}").bitwiseXOR(F.lit(_BAND_KEYS[band])) for i in range(CHUNK)]
    while len(least) > 1:
        least = [F.least(*least[i:i + 2]) for i in range(0, len(least), 2)]
    return F.min(least[0]).alias(f"m{row}_{band}")


def _distinct(rows: DataFrame) -> DataFrame:
    """``id, first_doc, copies, units`` of every distinct line."""
    lines = rows.groupBy("id").agg(F.min(_place()).alias("first_doc"), F.count(F.lit(1)).alias("copies"),
                                   F.min("norm").alias("norm"))
    return lines.select("id", "first_doc", "copies", _units("norm").alias("units"))


def _signed(rows: DataFrame) -> DataFrame:
    """``id, first_doc, copies, b0 ...`` of every distinct line: of every band,
    the hash of its minima.  Lines are dealt once, by id, and what their shingles
    are reduced to holds numbers only: the shingles are neither dealt nor sorted."""
    # No struct among the keys: numbers take the faster map of a task's hash aggregate.
    keys = ["id", "no_id", "of", "key", "copies"]
    rows = _chunks(_distinct(rows).select("id", "first_doc.*", "copies", "units"), *keys)
    for r in range(1, ROWS):
        rows = rows.select("*", *[F.xxhash64(f"h{r - 1}_{i}").alias(f"h{r}_{i}") for i in range(CHUNK)])
    lines = rows.groupBy(*keys).agg(*[_least(r, b) for b in range(BANDS) for r in range(ROWS)])
    return lines.select("id", F.struct("no_id", "of", "key").alias("first_doc"), "copies", *[
        F.xxhash64(F.lit(b), *[f"m{r}_{b}" for r in range(ROWS)]).alias(f"b{b}") for b in range(BANDS)])


def _texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, norm`` of the lines with these ids."""
    near = nearly_among(rows.select("id", "norm"), ids, "id")
    return near.groupBy("id").agg(F.min("norm").alias("norm")).join(ids, "id", "left_semi")


def _marks(text: DataFrame) -> DataFrame:
    """``id, n, w0 ...``: of every line the number of its shingles, repeated ones
    included, and WORDS longs in which each shingle has set a bit."""
    rows = _chunks(text.select("id", _units("norm").alias("units")), "id", "last")
    rows = rows.select("id", "last", *[F.shiftrightunsigned(f"h0_{i}", 6).bitwiseAND(F.lit(WORDS - 1)).alias(f"word{i}")
                                       for i in range(CHUNK)],
                       *[F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"h0_{i}").bitwiseAND(F.lit(63)).cast("int"))
                         .alias(f"bit{i}") for i in range(CHUNK)])
    none = F.lit(0).cast("long")
    return rows.groupBy("id").agg((F.max("last") + 1).alias("n"), *[
        F.bit_or(reduce(Column.bitwiseOR, [F.when(F.col(f"word{i}") == j, F.col(f"bit{i}")).otherwise(none)
                                           for i in range(CHUNK)])).alias(f"w{j}") for j in range(WORDS)])


def _near(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """``a, b, near``: whether the marks allow a Jaccard similarity of 0.8.  A bit
    that one line alone has set is of a shingle that the other has not, and of
    similar sets at most a ninth of both sizes' sum is in one alone."""
    def side(s: str) -> DataFrame:
        return marks.withColumnsRenamed({"id": s, **{c: f"{s}_{c}" for c in marks.columns if c != "id"}})
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"a_w{j}").bitwiseXOR(F.col(f"b_w{j}"))) for j in range(WORDS)])
    return both.select("a", "b", (9 * apart <= F.col("a_n") + F.col("b_n")).alias("near"))


def _similar(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """``a, b`` of those pairs of line ids whose exact Jaccard similarity is 0.8 or more."""
    both = pairs.join(text.withColumnsRenamed({"id": "a", "norm": "a_norm"}), "a") \
        .join(text.withColumnsRenamed({"id": "b", "norm": "b_norm"}), "b")
    sets = both.select("a", "b", _units("a_norm").alias("s"), _units("b_norm").alias("t")) \
        .select("a", "b", _shingles("s").alias("s"), _shingles("t").alias("t"))
    tested = sets.select("a", "b", (9 * F.size(F.array_intersect("s", "t"))
                                    >= 4 * (F.size("s") + F.size("t"))).alias("similar"))
    # Stored first: a filter on it would be put below the sets and make them again.
    return stored(tested, "op6-compared").where("similar").select("a", "b")


def _mixed(met: DataFrame, parts: DataFrame) -> DataFrame:
    """The buckets that hold lines of several components, with ``part`` and
    their number of lines ``n``."""
    named = met.join(parts.select(F.col("node").alias("id"), F.col("component").alias("part")),
                     "id", "left").withColumn("part", F.coalesce("part", "id"))
    several = named.groupBy("bucket").agg(
        F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("n")) \
        .where("p != q").select("bucket", "n")
    return named.join(several, "bucket").select("bucket", "id", "part", "copies", "n")


def _prefixes(ids: DataFrame, text: DataFrame) -> DataFrame:
    """``id, token, pos, size, before``: of every line the shingles, rare before
    frequent, one of which any similar line has in its own prefix; ``before``:
    those of the last ``BEFORE`` ahead of it that another line has too."""
    sets = stored(text.join(ids, "id", "left_semi").select("id", _units("norm").alias("units"))
                  .select("id", _shingles("units").alias("s"))
                  .select("id", F.size("s").alias("size"), F.explode_outer("s").alias("token")), "op6-tokens")
    count = sets.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("id").orderBy("c", "token")
    shared = F.collect_list(F.when(F.col("c") > 1, F.col("token")))
    return sets.join(count, "token").withColumn("pos", F.row_number().over(order) - 1) \
        .where(5 * F.col("pos") <= F.col("size")) \
        .withColumn("before", shared.over(order.rowsBetween(-BEFORE, -1))) \
        .where("c > 1").select("id", "token", "pos", "size", "before")


def _met(mixed: DataFrame, text: DataFrame) -> DataFrame:
    """``a, b`` of the lines of different components that share a crowded bucket
    and there a shingle of their prefixes, and can be similar.  A pair leaves the
    join at its first common shingle (again where none was common for BEFORE
    shingles) and in the least of its common buckets, not once for every one."""
    crowd = stored(mixed.where(F.col("n") > SMALL).groupBy("id", "part").agg(F.collect_set("bucket").alias("buckets")),
                   "op6-crowd")
    index = stored(_prefixes(crowd.select("id"), text).join(crowd, "id")
                   .withColumn("bucket", F.explode("buckets")), "op6-index")
    other = index.withColumnsRenamed({c: f"{c}2" for c in ("id", "part", "pos", "size", "before", "buckets")})
    # Behind their first common shingle both lines must hold the rest of the overlap.
    ahead = F.least(F.col("size") - F.col("pos"), F.col("size2") - F.col("pos2"))
    # One condition, the cheap parts first.
    return index.join(other, ["bucket", "token"]).where(
        (F.col("id") < F.col("id2")) & (F.col("part") != F.col("part2"))
        & (5 * F.least("size", "size2") >= 4 * F.greatest("size", "size2"))
        & (9 * ahead >= 4 * (F.col("size") + F.col("size2")))
        & ~F.arrays_overlap("before", "before2")
        & (F.array_min(F.array_intersect("buckets", "buckets2")) == F.col("bucket"))
    ).select(F.col("id").alias("a"), F.col("id2").alias("b"))


def _rest(mixed: DataFrame, tested: DataFrame, text: DataFrame) -> DataFrame:
    """``a, b`` of the lines of different components that meet in a bucket, are
    not compared yet and can be similar."""
    few = mixed.where(F.col("n") <= SMALL).select("bucket", "id", "part")
    other = few.withColumnsRenamed({"id": "id2", "part": "part2"})
    pairs = few.join(other, "bucket").where("id < id2 and part != part2") \
        .select(F.col("id").alias("a"), F.col("id2").alias("b"))
    return pairs.unionAll(_met(mixed, text)).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")


def _links(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges ``a, b`` whose components are those of all similar lines that share
    a band."""
    bands = F.array(*[f"b{b}" for b in range(BANDS)])
    # One exchange serves the count and the join: both read the same columns.
    dealt = lines.select("id", "copies", F.explode(bands).alias("bucket")).repartition("bucket")
    shared = dealt.groupBy("bucket").agg(
        F.min("id").alias("least"), F.max("id").alias("most"), F.max("copies").alias("top")) \
        .where("least != most").select("bucket", "top")
    met = stored(dealt.join(shared.hint("shuffle_hash"), "bucket"), "op6-buckets")
    text = stored(_texts(rows, met.select("id").distinct()), "op6-texts")
    marks = stored(_marks(text), "op6-marks")
    tested = edges = parts = None
    for turn in range(HEAD_ROUNDS):
        if parts is None:
            members = met
            heads = met.where("copies = top").groupBy("bucket").agg(F.max(F.struct(
                F.xxhash64("bucket", "id").alias("order"), "id")).alias("h"))
            faced = members.join(heads, "bucket").where(F.col("id") != F.col("h.id"))
        else:
            members = stored(_mixed(met, parts), "op6-mixed")
            heads = members.groupBy("bucket").agg(F.min(F.struct(
                F.xxhash64("bucket", "id", F.lit(turn)).alias("order"), "id", "part")).alias("h"))
            faced = members.join(heads, "bucket").where(F.col("part") != F.col("h.part"))
        pairs = faced.select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        seen = stored(_near(pairs, marks), "op6-tested")
        tested = seen if tested is None else tested.unionAll(seen)
        found = _similar(seen.where("near").select("a", "b"), text)
        edges = found if edges is None else edges.unionAll(found)
        parts = components(edges, "op6-heads")
    rest = stored(_near(_rest(stored(_mixed(met, parts), "op6-mixed"), tested, text), marks).where("near"), "op6-rest")
    return edges.unionAll(_similar(rest.select("a", "b"), text))


def similar_lines(rows: DataFrame) -> DataFrame:
    """``id, component, first_doc`` of every line that is not the only one of
    its kind; ``first_doc`` is the place of the first document with one."""
    lines = stored(_signed(rows), "op6-lines")
    parts = components(_links(lines, rows), "op6")
    grouped = lines.select("id", "first_doc", "copies").join(
        parts.withColumnRenamed("node", "id"), "id", "left") \
        .where("copies > 1 or component is not null") \
        .withColumn("component", F.coalesce("component", "id"))
    firsts = grouped.groupBy("component").agg(F.min("first_doc").alias("first_doc"))
    return grouped.select("id", "component").join(firsts, "component")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, dropped array<int>`` (0-based line numbers,
    ascending) of the documents that lose lines."""
    rows = stored(line_rows(docs), "op6-rows")
    kinds = stored(similar_lines(rows), "op6-kinds")
    places = rows.select("doc_id", "text_key", "pos", "id").join(kinds, "id")
    by_kind = places.groupBy("doc_id", "text_key", "component").agg(
        F.min("pos").alias("first"), F.collect_set("pos").alias("places"),
        F.first("first_doc").alias("first_doc"))
    own = _place() == F.col("first_doc")
    gone = F.when(own, F.array_remove("places", F.col("first"))).otherwise(F.col("places"))
    return by_kind.select("doc_id", "text_key", gone.alias("gone")).where(F.size("gone") > 0) \
        .groupBy("doc_id", "text_key").agg(
            F.array_sort(F.flatten(F.collect_list("gone"))).alias("dropped"))


def _joined(docs: DataFrame, drops: DataFrame) -> DataFrame:
    drops = drops.withColumnsRenamed({"doc_id": "__id", "text_key": "__key", "dropped": "__dropped"})
    return docs.join(drops, docs["doc_id"].cast("long").eqNullSafe(drops["__id"])
                     & (text_key(docs["text"]) == drops["__key"]), "left").drop("__id", "__key")


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_kept, dropped`` for every row."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"),
                        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    drops = dropped_lines(docs).withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    rows = lines.join(drops, lines["doc_id"].eqNullSafe(drops["id"])
                      & (lines["text_key"] == drops["key"]), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    n = F.greatest("n_lines", F.lit(0))
    return rows.select("doc_id", n.cast("long").alias("n_lines"),
                       (n - F.size(dropped)).cast("long").alias("n_kept"), dropped.alias("dropped"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without their dropped lines, all columns kept; a document
    that loses its last word goes."""
    rows = _joined(docs, dropped_lines(docs))
    lines = F.split("text", "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    text = F.array_join(F.transform(keep, lambda i: F.element_at(lines, i + 1)), "\n")
    rows = rows.withColumn("text", F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__dropped").isNull(), F.col("n_chars"))
                               .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.where(F.col("__dropped").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")) \
        .select(*docs.columns)

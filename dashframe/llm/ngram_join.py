"""N-gram Jaccard join by set relations (operator 5).

Documents are sets of word shingles (``Rule``: three words in the operator);
two sets link at a Jaccard similarity of ``num / den`` (9/10) or more.  Equal sets are collapsed first, and only distinct sets
are joined.

Index: shingles have one global order, rare before frequent by a fixed-size
count sketch.  A set's prefix in that order holds so many shingles that two
linked sets share at least ``need`` of them, so sets that share fewer with all
others drop out.  An inverted list is cut into blocks by set size and by
position: two sets whose first common shingle stands beyond
``size * (den - num) / (den + num)`` (``size / 19``) in both cannot link, so blocks of far positions are never joined with each other,
and within blocks only places that sum to at most ``(size + size) / 19`` meet.

Answers: in every list, all sets are compared with one head set and their
overlaps with it kept.  What is linked forms components, and sets of one
component need no further comparison.  Other pairs of a list derive their
answer from the overlaps with the common head where these bound it
(``o1 + o2 - |head| <= |x & y| <= min(o1, o2) + min(|x| - o1, |y| - o2)``) and
only the rest is compared.  A group of thousands of near copies thus costs one
comparison per set and list head, not one per pair.

Defined cases: a text of fewer words than a shingle's is one shingle, its whole
sequence; NULL and wordless texts have the empty set and link with nothing;
component_id is the smallest id of the component, NULLs apart; repeated rows
give repeated rows; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dashframe.llm.common import (binary_values, gram_hashes, mix, nearly_among, slices, stored,
                                  text_key, word_hashes)
from dashframe.llm.components import components

SKETCH_BITS = 17
HEAD_ROUNDS = 2
BEFORE = 8            # entries ahead of one that tell whether a pair has met
PARITIES = 16         # 64-bit words of a set's parities


class Rule(NamedTuple):
    """Words of a shingle and the least Jaccard similarity, ``num / den``."""
    words: int = 3
    num: int = 9
    den: int = 10

    def linked(self, overlap: Column, a: Column, b: Column) -> Column:
        return (self.num + self.den) * overlap >= self.num * (a + b)

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return self.den * F.least(a, b) >= self.num * F.greatest(a, b)

    def differ_fits(self, differ: Column, a: Column, b: Column) -> Column:
        """Whether sets that differ in so many shingles can link."""
        return (self.num + self.den) * differ <= (self.den - self.num) * (a + b)

    def places_fit(self, pos: Column, size: Column) -> Column:
        return pos * (self.den + self.num) <= size * (self.den - self.num)


def shingle_set(text: bytes | None, words: int = Rule().words) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    h = word_hashes(text.lower().split()) if text else np.empty(0, np.uint64)
    if 0 < len(h) < words:
        return mix(gram_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(gram_hashes(h, words))


def set_id(tokens: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


def _sets_and_sketch(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, text_key, size, sid`` per row, and rows ``cell, n`` of the
    count sketch with the other columns NULL."""
    kinds = ["doc_id", "text_key", "size", "sid", "cell", "n"]
    types = [pa.int64()] * 6

    def run(batches):
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in slices(batches):
            sizes, sids = [], []
            for text in binary_values(b, "text"):
                s = shingle_set(text, rule.words)
                cells += np.bincount((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64),
                                     minlength=len(cells))
                sizes.append(len(s))
                sids.append(set_id(s))
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(sizes, pa.int64()),
                 pa.array(sids, pa.int64()), none, none], names=kinds)
        used = np.flatnonzero(cells)
        for i in range(0, len(used), 1 << 15):
            part = used[i:i + (1 << 15)]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(part, pa.int64()), pa.array(cells[part])], names=kinds)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in kinds))


def _need(size):
    """Prefix shingles that a set of this size shares with any linked one."""
    return np.maximum(1, size // 25)


def _prefixes(docs: DataFrame, order, rule: Rule) -> DataFrame:
    """``token, sid, size, pos`` of every set's prefix; ``order``: broadcast
    count per sketch cell."""

    def run(batches):
        count = order.value
        for b in slices(batches):
            cols = [[], [], [], []]
            seen = set()
            for text in binary_values(b, "text"):
                s = shingle_set(text, rule.words)
                sid = set_id(s)
                if sid is None or sid in seen:
                    continue
                seen.add(sid)
                n = len(s)
                keep = min(n, n - (rule.num * n + rule.den - 1) // rule.den + int(_need(n)))
                c = count[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                head = s[np.lexsort((s, c))[:keep]]
                cols[0].append(head.view(np.int64))
                cols[1].append(np.full(keep, sid, np.int64))
                cols[2].append(np.full(keep, n, np.int32))
                cols[3].append(np.arange(keep, dtype=np.int32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols],
                                                 names=["token", "sid", "size", "pos"])

    return docs.select("text").mapInArrow(run, "token long, sid long, size int, pos int")


def _overlaps(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """``a, b, overlap, sa, sb`` of pairs of set ids, from the texts."""
    both = pairs.join(texts.withColumnsRenamed({"sid": "a", "text": "ta"}), "a") \
        .join(texts.withColumnsRenamed({"sid": "b", "text": "tb"}), "b")

    def run(batches):
        last: dict[int, np.ndarray] = {}

        def tokens(sid, text):
            if sid not in last:
                if len(last) >= 64:
                    last.clear()
                last[sid] = shingle_set(text, rule.words)
            return last[sid]

        for part in slices(batches, "ta"):
            o, n, m = [], [], []
            for a, b, ta, tb in zip(part.column("a").to_pylist(), part.column("b").to_pylist(),
                                    binary_values(part, "ta"), binary_values(part, "tb")):
                x, y = tokens(a, ta), tokens(b, tb)
                o.append(len(np.intersect1d(x, y, assume_unique=True)))
                n.append(len(x))
                m.append(len(y))
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b")] + [pa.array(x, pa.int64()) for x in (o, n, m)],
                names=["a", "b", "overlap", "sa", "sb"])

    return both.select("a", "b", "ta", "tb").mapInArrow(
        run, "a long, b long, overlap long, sa long, sb long")


def _index(docs: DataFrame, sketch: DataFrame, rule: Rule) -> DataFrame:
    """The prefix entries that can matter: shared shingles of the sets that
    share enough of them, ``token, sid, size, pos``."""
    count = np.zeros(1 << SKETCH_BITS, np.int64)
    for cell, n in sketch.groupBy("cell").agg(F.sum("n")).collect():   # at most 2 ** SKETCH_BITS rows
        count[cell] = n
    entries = _prefixes(docs, docs.sparkSession.sparkContext.broadcast(count), rule)
    # Entries are dealt once, by their shingle, and not written before.
    holders = Window.partitionBy("token")
    kept = stored(entries.withColumns({"lo": F.min("sid").over(holders), "hi": F.max("sid").over(holders)})
                  .where("lo != hi").drop("lo", "hi"), "op5-shared")
    enough = F.greatest(F.lit(1), F.floor(F.floor(F.col("size") * rule.num / rule.den) / 25))
    sets = kept.groupBy("sid", "size").agg(F.count_distinct("token").alias("k")) \
        .where(F.col("k") >= enough).select("sid")
    return stored(kept.join(sets, "sid", "left_semi").distinct(), "op5-index")


def _lists(index: DataFrame, rule: Rule) -> DataFrame:
    """Index lists cut into windows of two adjacent size blocks; sets that may
    link meet in window ``greatest(block, block)``, so one that holds a single
    set, none of its own block or no near place goes."""
    block = F.floor(F.log("size") / F.log(F.lit(rule.den / rule.num))).cast("int")
    entries = index.withColumn("block", block).withColumn(
        "window", F.explode(F.array("block", F.col("block") + 1))) \
        .withColumn("near", rule.places_fit(F.col("pos"), F.col("size")))
    of = Window.partitionBy("token", "window")
    return entries.withColumns({"lo": F.min("sid").over(of), "hi": F.max("sid").over(of),
                                "own": F.max("block").over(of), "some": F.max("near").over(of)}) \
        .where("lo != hi and own = window and some").drop("lo", "hi", "own", "some")


def links(docs: DataFrame, rule: Rule = Rule()) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, text_key, size, sid`` per row, edges ``a, b`` between distinct
    sets whose components are those of all links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       text_key("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    first = stored(_sets_and_sketch(docs, rule), "op5-sets")
    rows = first.where("cell is null").select("doc_id", "text_key", "size", "sid")
    index = _index(docs, first.where("cell is not null"), rule)
    holders = stored(rows.join(index.select("sid").distinct(), "sid", "left_semi")
                     .groupBy("sid").agg(F.min(F.struct("doc_id", "text_key")).alias("d"))
                     .select("sid", F.col("d.doc_id").alias("id"), F.col("d.text_key").alias("key")), "op5-holders")
    # Of the other texts few are dealt.
    near = nearly_among(docs, holders.select(F.col("key").alias("text_key")), "text_key")
    texts = stored(near.join(holders, near["doc_id"].eqNullSafe(holders["id"])
                             & (near["text_key"] == holders["key"]))
                   .groupBy("sid").agg(F.first("text").alias("text")), "op5-texts")

    lists = stored(_lists(index, rule), "op5-lists")
    parts = None
    tested = None
    roles = None
    chosen = []
    for turn in range(HEAD_ROUNDS):
        entries = lists if parts is None else _mixed(lists, parts)
        heads = entries.where("near").groupBy("token", "window").agg(F.min(F.struct(
            F.xxhash64("sid", F.lit(turn)).alias("order"), "sid", "size", "pos",
            *([] if parts is None else ["part"]))).alias("h"))
        met = entries.join(heads, ["token", "window"]).where(
            (F.col("sid") != F.col("h.sid")) & rule.sizes_fit(F.col("size"), F.col("h.size"))
            & rule.places_fit(F.col("pos") + F.col("h.pos"), F.col("size") + F.col("h.size")))
        if parts is not None:
            met = met.where(F.col("part") != F.col("h.part"))
        chosen.append(stored(heads.select("token", "window", F.col("h.sid").alias("head")), "op5-list-heads"))
        faced = stored(met.select("sid", F.col("h.sid").alias("head")).distinct(), "op5-faced")
        roles = faced if roles is None else roles.unionAll(faced)
        pairs = faced.select(F.least("sid", "head").alias("a"), F.greatest("sid", "head").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        seen = stored(_overlaps(pairs, texts, rule), "op5-tested")
        tested = seen if tested is None else tested.unionAll(seen)
        edges = tested.where(rule.linked(F.col("overlap"), F.col("sa"), F.col("sb"))).select("a", "b")
        parts = components(edges, "op5")

    rest = stored(_rest(_mixed(lists, parts), texts, tested, roles, chosen, rule), "op5-rest")
    derived = rest.where("sure").select("a", "b")
    seen = stored(_overlaps(rest.where(~F.col("sure")).select("a", "b"), texts, rule), "op5-tested")
    more = seen.where(rule.linked(F.col("overlap"), F.col("sa"), F.col("sb"))).select("a", "b")
    return rows, edges.unionAll(derived).unionAll(more)


def _mixed(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """The lists that hold sets of several components, with ``part``."""
    named = lists.join(parts.select(F.col("node").alias("sid"), F.col("component").alias("part")),
                       "sid", "left").withColumn("part", F.coalesce("part", "sid"))
    several = named.groupBy("token", "window").agg(F.min("part").alias("p"), F.max("part").alias("q")) \
        .where("p != q").select("token", "window")
    return named.join(several, ["token", "window"], "left_semi")


def _parities(texts: DataFrame, rule: Rule) -> DataFrame:
    """``sid, q0 ...`` of every set: of each of 64 * PARITIES classes of shingles
    (by hash) whether the set holds an odd number.  Where the parities of two
    sets differ, a shingle is in one of them only."""
    names = [f"q{i}" for i in range(PARITIES)]
    drop = np.uint64(64 - (64 * PARITIES).bit_length() + 1)

    def run(batches):
        for b in slices(batches):
            odd = [np.packbits((np.bincount((shingle_set(t, rule.words) >> drop).astype(np.int64),
                                            minlength=64 * PARITIES) & 1).astype(np.uint8)).view(np.int64)
                   for t in binary_values(b, "text")]
            odd = np.array(odd, np.int64).reshape(-1, PARITIES)
            yield pa.RecordBatch.from_arrays(
                [b.column("sid")] + [pa.array(np.ascontiguousarray(odd[:, i])) for i in range(PARITIES)],
                names=["sid", *names])

    return texts.select("sid", "text").mapInArrow(run, "sid long, " + ", ".join(f"{q} long" for q in names))


def _bounds(batches):
    """Of a pair the least and the most that the overlaps with common heads
    leave for its own: ``a, b, s1, s2, least, most`` (NULL without one)."""
    for b in batches:
        least, most = [], []
        for s1, s2, one, two in zip(b.column("s1").to_pylist(), b.column("s2").to_pylist(),
                                    b.column("h1"), b.column("h2")):
            low = high = None
            if one.is_valid and two.is_valid:
                x, y = ([one.values.field(i).to_numpy() for i in range(3)],
                        [two.values.field(i).to_numpy() for i in range(3)])
                _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
                if len(i):
                    o1, o2 = x[1][i], y[1][j]
                    low = int((o1 + o2 - x[2][i]).max())
                    high = int((np.minimum(o1, o2) + np.minimum(s1 - o1, s2 - o2)).min())
            least.append(low)
            most.append(high)
        yield pa.RecordBatch.from_arrays(
            [b.column(c) for c in ("a", "b", "s1", "s2")] + [pa.array(x, pa.int64()) for x in (least, most)],
            names=["a", "b", "s1", "s2", "least", "most"])


def _rest(mixed: DataFrame, texts: DataFrame, tested: DataFrame, roles: DataFrame, chosen: list[DataFrame],
          rule: Rule) -> DataFrame:
    """Pairs of sets of different components that meet in an index block, are
    not tested yet and are not refuted by the overlaps with a common head:
    ``a, b, sure`` (link proven by them).  Entries bring their overlaps with the
    heads of their own list and their sets' parities, so that pairs these refute
    never leave the join.
    For the others, a set's heads are one array in its row (they are those of
    its own lists); a pair takes its sets' arrays and is judged in its row."""
    sides = roles.distinct().withColumns({"a": F.least("sid", "head"), "b": F.greatest("sid", "head")}) \
        .join(tested, ["a", "b"])
    heads = stored(sides.groupBy("sid").agg(F.collect_list(F.struct(
        "head", "overlap", F.when(F.col("head") == F.col("a"), F.col("sa")).otherwise(F.col("sb")).alias("n")))
        .alias("h")), "op5-heads")
    overlaps = [f"o{i}_" for i in range(len(chosen))]
    for o, of in zip(overlaps, chosen):
        mixed = mixed.join(of.withColumnRenamed("head", f"{o}head"), ["token", "window"], "left")
    mixed = mixed.join(heads, "sid", "left")
    marks = stored(_parities(texts.join(mixed.select("sid").distinct(), "sid", "left_semi"), rule), "op5-parities")
    mixed = stored(mixed.withColumns({o: F.expr(
        f"IF(sid = {o}head, CAST(size AS BIGINT), GET(FILTER(h, x -> x.head = {o}head), 0).overlap)")
        for o in overlaps}).drop("h", *[f"{o}head" for o in overlaps]), "op5-mixed")
    order = Window.partitionBy("sid", "window").orderBy("pos")
    mixed = mixed.withColumn("before", F.collect_list("token").over(order.rowsBetween(-BEFORE, -1))).join(marks, "sid")
    parities = [f"q{i}" for i in range(PARITIES)]
    carried = ("block", "near", "sid", "size", "pos", "part", "before", *overlaps, *parities)
    # Both sides name their columns alike: one exchange serves them.
    x, y = (mixed.select("token", "window", *[F.col(c).alias(f"{c}{i}") for c in carried]) for i in (1, 2))
    possible = F.lit(True)
    for o in overlaps:
        o1, o2, s1, s2 = (F.col(c) for c in (f"{o}1", f"{o}2", "size1", "size2"))
        most = F.when(o1.isNotNull() & o2.isNotNull(), F.least(o1, o2) + F.least(s1 - o1, s2 - o2))
        possible = possible & F.coalesce(rule.linked(most, s1, s2), F.lit(True))
    differ = sum((F.bit_count(F.col(f"{q}1").bitwiseXOR(F.col(f"{q}2"))) for q in parities), F.lit(0))
    met = x.join(y, ["token", "window"]).where((
        (F.col("sid1") < F.col("sid2")) & (F.col("part1") != F.col("part2"))
        & (F.col("near1") | F.col("near2")) & (F.col("window") == F.greatest("block1", "block2"))
        & rule.places_fit(F.col("pos1") + F.col("pos2"), F.col("size1") + F.col("size2"))
        & rule.sizes_fit(F.col("size1"), F.col("size2"))
        & rule.differ_fits(differ, F.col("size1"), F.col("size2")) & possible
        # A pair leaves the join at its first common entry (again where none was common for
        # BEFORE entries), not at every one.
        & ~F.arrays_overlap("before1", "before2")))
    pairs = stored(met.select(F.col("sid1").alias("a"), F.col("sid2").alias("b"),
                              F.col("size1").cast("long").alias("s1"), F.col("size2").cast("long").alias("s2"))
                   .distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), "op5-pairs")
    both = pairs.join(heads.withColumnsRenamed({"sid": "a", "h": "h1"}), "a", "left") \
        .join(heads.withColumnsRenamed({"sid": "b", "h": "h2"}), "b", "left")
    judged = both.mapInArrow(_bounds, "a long, b long, s1 long, s2 long, least long, most long")
    return judged.where(F.col("most").isNull() | rule.linked(F.col("most"), F.col("s1"), F.col("s2"))) \
        .select("a", "b", F.coalesce(rule.linked(F.col("least"), F.col("s1"), F.col("s2")), F.lit(False))
                .alias("sure"))


def classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_key, class`` for every row;
    ``class`` is NULL for the empty set and else the same for linked sets."""
    rows, edges = links(docs, rule)
    parts = components(edges, "op5-all").select(F.col("node").alias("sid"), "component")
    named = stored(rows.join(parts, "sid", "left").withColumn("component", F.coalesce("component", "sid")),
                   "op5-classes")
    least = named.where("sid is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component", "left").select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        "text_key", F.col("component").alias("class"))


def one_per_class(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One document of every class, and those without a word; all columns kept.
    The one that stays has the smallest id (NULL is the last), of equal ids the
    smallest hash of its text; of rows with equal id and text any one stays."""
    found = stored(classes(docs, rule), "op5-found")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    stays = (found.where("class is not null").groupBy("class").agg(F.min(place).alias("d"))
             .select("d.doc_id", "d.text_key"))
    rows_of = found.where("class is not null").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    same = rows_of["doc_id"].eqNullSafe(stays["doc_id"]) & (rows_of["text_key"] == stays["text_key"])
    names = rows_of.join(stays, same, "left_semi").unionAll(
        found.where("class is null").select("doc_id", F.coalesce("text_key", F.lit(0)), F.lit(1).cast("long"))
        .distinct()).withColumnsRenamed({"doc_id": "__d", "text_key": "__k", "n": "__n"})
    row = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": F.coalesce(text_key("text"), F.lit(0))})
    kept = row.join(names, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")))
    # Only rows that share id and text have to meet.
    return kept.where("__n = 1").unionAll(kept.where("__n > 1").dropDuplicates(["__id", "__key"])) \
        .select(*docs.columns)


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
           ELSE array_to_string(list_slice(w, i, i + 2), ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT link.a, reach.r FROM reach JOIN link ON link.b = reach.doc_id),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN least ON least.doc_id = w.doc_id
"""

"""Benchmark decontamination by winnowing (operator 4).

A window is 13 consecutive words of an item (an item of fewer words is one
window).  Of every run of ``13 - K + 1`` consecutive K-gram hashes the minimum
is kept, on both sides; any 13 equal words hold such a run, so they share a
kept hash at the same place.  Fingerprints of documents and items meet in a
join; each hit is then extended word by word in both directions, and spans of
a window's length or more are the occurrences.  Nothing rests on the hashes
but the choice of places to look at.

Items shorter than a window have one fingerprint, the hash of all their words;
documents add the hashes of all their runs of those lengths.

As long as the items have at most ``prefilter`` fingerprints, the map side
drops document fingerprints that no item has (8 bytes each are broadcast);
with more, all go into the same join.  The results are the same.

Defined cases: NULL or wordless texts have no words and are never hit; a NULL
item or one without words has no window; items are told apart by item_id, and
an item without an id still hits but is not listed; repeated rows give
repeated rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dashframe.llm.common import (binary_values, gram_hashes, mix, slices, stored, text_key,
                                  word_hashes)

WINDOW = 13
K = 7
RUN = WINDOW - K + 1
PREFILTER = 1 << 20   # fingerprints, 8 bytes each

# A-Z to a-z; every other byte outside 0-9, a-z and the non-ASCII ones to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def winnow(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) kept of a text's word hashes: the last minimum of each
    run of K-grams."""
    g = gram_hashes(h, K)
    if len(g) < RUN:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = np.lib.stride_tricks.sliding_window_view(g, RUN)
    at = np.unique(np.arange(len(runs)) + RUN - 1 - runs[:, ::-1].argmin(axis=1))
    return at, g[at]


def _short_hashes(h: np.ndarray, n: int) -> np.ndarray:
    return mix(gram_hashes(h, n) + np.uint64(n))


def item_marks(benchmark: DataFrame) -> DataFrame:
    """``item_id, item_key, text, n_words, fps array<long>, places array<int>``."""

    def run(batches):
        for b in batches:
            n, fps, places = [], [], []
            for text in binary_values(b, "text"):
                h = word_hashes(words(text))
                at, f = winnow(h) if len(h) >= WINDOW else (
                    (np.zeros(1, np.int64), _short_hashes(h, len(h))) if len(h) else winnow(h))
                n.append(len(h))
                fps.append(f.view(np.int64))
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id"), b.column("item_key"), b.column("text"), pa.array(n, pa.int32()),
                 pa.array(fps, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                names=["item_id", "item_key", "text", "n_words", "fps", "places"])

    cols = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                            F.xxhash64(F.col("item_id").cast("string"), "text").alias("item_key"),
                            F.col("text").cast("string").alias("text"))
    return cols.distinct().mapInArrow(
        run, "item_id string, item_key long, text string, n_words int, "
             "fps array<long>, places array<int>").where("n_words > 0")


def document_marks(docs: DataFrame, short: list[int], known) -> DataFrame:
    """``doc_id, text_key, n_words, fps, places``; ``known``: a broadcast sorted
    array of the fingerprints to keep, or None for all."""

    def run(batches):
        keep = None if known is None else known.value
        for b in slices(batches):
            n, fps, places = [], [], []
            for text in binary_values(b, "text"):
                h = word_hashes(words(text))
                at, f = winnow(h)
                if short:
                    more = [_short_hashes(h, k) for k in short]
                    at = np.concatenate([at, *(np.arange(len(x)) for x in more)])
                    f = np.concatenate([f, *more])
                if keep is not None:
                    if len(keep):
                        i = np.searchsorted(keep, f)
                        hit = keep[np.minimum(i, len(keep) - 1)] == f
                    else:
                        hit = np.zeros(len(f), bool)
                    at, f = at[hit], f[hit]
                n.append(len(h))
                fps.append(f.view(np.int64))
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()),
                 pa.array(fps, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                names=["doc_id", "text_key", "n_words", "fps", "places"])

    return docs.mapInArrow(run, "doc_id long, text_key long, n_words long, "
                                "fps array<long>, places array<int>")


def extend(doc: list[bytes], item: list[bytes], hits: list[tuple[int, int]],
           least: int) -> list[tuple[int, int]]:
    """Maximal equal word spans (start, end in the document) of at least
    ``least`` words through the hits (document place, item place)."""
    done: dict[int, int] = {}
    spans = []
    for p, q in sorted(hits):
        if p < done.get(p - q, -1):
            continue
        a, c = p, q
        while a and c and doc[a - 1] == item[c - 1]:
            a, c = a - 1, c - 1
        e, f = p, q
        while e < len(doc) and f < len(item) and doc[e] == item[f]:
            e, f = e + 1, f + 1
        done[p - q] = max(e, p + 1)
        if e - a >= least:
            spans.append((a, e))
    return spans


def occurrences(docs: DataFrame, benchmark: DataFrame,
                prefilter: int = PREFILTER) -> tuple[DataFrame, DataFrame]:
    """(base ``doc_id, text_key, n_words`` for every row, spans ``doc_id,
    text_key, item_id, spans array<struct<start,end>>`` for every document and
    item that share a window)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       text_key("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    items = stored(item_marks(benchmark), "op4-items")
    item_fps = items.select("item_key", F.explode(F.arrays_zip("fps", "places")).alias("m")) \
        .select("item_key", F.col("m.fps").alias("fp"), F.col("m.places").alias("q"))
    short = [r[0] for r in items.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect()]
    known = None
    distinct = item_fps.select("fp").distinct()
    if distinct.limit(prefilter + 1).count() <= prefilter:
        kept = np.array([r[0] for r in distinct.collect()], np.int64).view(np.uint64)
        known = spark.sparkContext.broadcast(np.sort(kept))
    marks = stored(document_marks(docs, sorted(short), known), "op4-marks")
    seeds = marks.select("doc_id", "text_key", F.explode(F.arrays_zip("fps", "places")).alias("m")) \
        .select("doc_id", "text_key", F.col("m.fps").alias("fp"), F.col("m.places").alias("p")) \
        .join(item_fps, "fp")
    pairs = stored(seeds.groupBy("doc_id", "text_key", "item_key")
                   .agg(F.collect_set(F.struct("p", "q")).alias("hits")), "op4-pairs")
    whole = docs.withColumnRenamed("doc_id", "id").withColumnRenamed("text_key", "key")
    facing = (pairs.join(whole, pairs["doc_id"].eqNullSafe(whole["id"])
                         & (pairs["text_key"] == whole["key"]))
              .drop("id", "key")
              .join(items.select("item_key", "item_id", F.col("text").alias("item_text")), "item_key"))

    def run(batches):
        for b in batches:
            out = []
            for text, item, hits in zip(binary_values(b, "text"), binary_values(b, "item_text"),
                                        b.column("hits").to_pylist()):
                w = words(item)
                found = extend(words(text), w, [(x["p"], x["q"]) for x in hits],
                               min(WINDOW, len(w)))
                out.append([{"start": s, "end": e} for s, e in found])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), b.column("item_id"),
                 pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "text_key", "item_id", "spans"])

    spans = facing.select("doc_id", "text_key", "item_id", "text", "item_text", "hits").mapInArrow(
        run, "doc_id long, text_key long, item_id string, spans array<struct<start:int,end:int>>")
    return marks.select("doc_id", "text_key", "n_words"), spans.where(F.size("spans") > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, prefilter: int = PREFILTER) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated`` and its ``text_key``."""
    base, spans = occurrences(docs, benchmark, prefilter)
    by_doc = spans.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    covered = F.aggregate(
        "spans", zero,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            (acc["sum"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"])))
            .alias("sum")),
        lambda acc: acc["sum"])
    hit = by_doc.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "items",
                        covered.cast("long").alias("hit_words"))
    joined = base.join(hit, base["doc_id"].eqNullSafe(hit["id"]) & (base["text_key"] == hit["key"]),
                       "left")
    n_hit = F.coalesce("hit_words", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns kept."""
    bad = contamination(docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__id"])
                     & (text_key(docs["text"]) == bad["__key"]), "left_anti")


SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bi AS (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
  FROM bw WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM bi),
lengths AS (SELECT DISTINCT n FROM windows),
di AS (
  SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM dw, lengths),
hits AS (
  SELECT d.doc_id, d.i, d.n, v.item_id
  FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM di) d
  JOIN windows v ON v.n = d.n AND v.s = d.s),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

"""Deleted interpolation bigram model over all documents (operator 9).

``p(w | v) = a(v) c(vw) / c(v) + b(v) c(w) / N + g(v) / (V + 1)``: maximum
likelihood estimates of two orders and a uniform one, mixed with weights that
depend on the context's frequency bucket (powers of two of ``c(v)``).  Counts
are those of the training documents.  The weights are learned by expectation
maximisation on deleted counts: each training token is held out of the counts
that predict it.  A document's start is a context, its end a token.

Plan: the corpus is cut into chunks of about ``CHUNK`` bytes whose tokens are
written once.  A chunk asks for the corpus counts of its distinct words and
word pairs (64-bit hashes, sorted, in ranges of the hash); each range is
counted in one task and answers every chunk.  Ranges are cut so that one holds
about ``RANGE_KEYS`` of the asked keys, and a key is asked once a chunk, so
frequent words and pairs weigh no more than rare ones.  A chunk has requests
for the ranges it has keys in alone: they grow with the keys, not with chunks
times ranges.  The EM reads the training tokens' estimates from a table of log
bins (``_STEP`` a factor e), so its weights are those of the bins' centres;
scores are computed from the counts themselves.

Defined cases: NULL and empty texts have one token, the end; a NULL id is not
in training and not held out; with no training token at all every estimate is
the uniform one; an empty table gives an empty result; a text longer than a
chunk is a chunk of its own, read whole; repeated rows count and return as
often as they occur; other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dashframe.llm.common import binary_values, mix, remainder, slices, stored, word_hashes

CHUNK = 6 << 20
RANGE_KEYS = 2_000_000
BUCKETS = 24
EM_STEPS = 60
_START, _END = np.uint64(0x5157A127), np.uint64(0xE2D0F7E7)
_STEP = 4                   # bins per factor e of an estimate, for the EM table
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _squeeze(x: np.ndarray) -> bytes:
    """Sorted or small integers by byte planes of their differences."""
    wide = np.ascontiguousarray(x, np.uint64)
    planes = wide.view(np.uint8).reshape(-1, 8).T.tobytes() if len(wide) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(np.uint64)


def squeeze_keys(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data), dtype=np.uint64)


def _chunks(docs: DataFrame) -> DataFrame:
    """``chunk, doc_ids, lengths, training, words`` (distinct word hashes,
    sorted) ``, places`` (of each token among the words)."""

    def run(batches):
        for b in slices(batches, chars=CHUNK):
            hashes = []
            for text in binary_values(b, "text"):
                h = word_hashes(text.lower().split()) if text else np.empty(0, np.uint64)
                hashes.append(np.append(h, _END))
            words, places = np.unique(np.concatenate(hashes), return_inverse=True)
            yield pa.RecordBatch.from_pydict({
                "chunk": [uuid.uuid4().hex], "doc_ids": [b.column("doc_id").to_pylist()],
                "lengths": [[len(h) for h in hashes]], "training": [b.column("training").to_pylist()],
                "held_out": [b.column("held_out").to_pylist()],
                "words": [squeeze_keys(words)], "places": [_squeeze(places)]},
                schema=pa.schema([("chunk", pa.string()), ("doc_ids", pa.list_(pa.int64())),
                                  ("lengths", pa.list_(pa.int64())), ("training", pa.list_(pa.bool_())),
                                  ("held_out", pa.list_(pa.bool_())),
                                  ("words", pa.binary()), ("places", pa.binary())]))

    return docs.mapInArrow(run, "chunk string, doc_ids array<long>, lengths array<long>, "
                                "training array<boolean>, held_out array<boolean>, "
                                "words binary, places binary")


def _unfold(row: dict):
    """(words, place of each token, place of each context among words + start,
    pairs, pair of each token, training mask) of a chunk."""
    words = expand_keys(row["words"])
    places = _expand(row["places"]).astype(np.int64)
    lengths = np.array(row["lengths"], np.int64)
    context = np.empty_like(places)
    context[1:] = places[:-1]
    context[np.cumsum(lengths) - lengths] = len(words)
    known = np.append(words, _START)
    pairs, pair = np.unique(mix(known[context] * _PAIR + words[places]), return_inverse=True)
    training = np.repeat(np.array(row["training"], bool), lengths)
    return words, places, context, pairs, pair, training


_CHUNK_SCHEMA = ("chunk", "lengths", "training", "words", "places")


def _part(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each key: the hash's upper half, scaled."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _requests(chunks: DataFrame, ranges: int) -> DataFrame:
    """``range, chunk, words, word_counts, pairs, pair_counts``: keys of the
    range in a chunk, with the chunk's training counts.  Only ranges in which
    the chunk has a key: at most a row for each of its keys, whatever the
    number of ranges, which grows with the corpus."""

    def cut(keys, part, asked, counts):
        first = np.searchsorted(part, asked)
        last = np.searchsorted(part, asked, side="right")
        return ([squeeze_keys(keys[i:j]) for i, j in zip(first, last)],
                [_squeeze(counts[i:j]) for i, j in zip(first, last)])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in _CHUNK_SCHEMA}
                words, places, _, pairs, pair, training = _unfold(row)
                in_words, in_pairs = _part(words, ranges), _part(pairs, ranges)
                asked = np.union1d(in_words, in_pairs)
                w, wc = cut(words, in_words, asked,
                            np.bincount(places[training], minlength=len(words)))
                p, pc = cut(pairs, in_pairs, asked,
                            np.bincount(pair[training], minlength=len(pairs)))
                yield pa.RecordBatch.from_pydict({
                    "range": pa.array(asked.astype(np.int32)), "chunk": [row["chunk"]] * len(asked),
                    "words": w, "word_counts": wc, "pairs": p, "pair_counts": pc})

    return chunks.select(*_CHUNK_SCHEMA).mapInArrow(
        run, "range int, chunk string, words binary, word_counts binary, pairs binary, "
             "pair_counts binary")


def _totals(keys: list[bytes], counts: list[bytes]) -> tuple[list[np.ndarray], int]:
    """Corpus count of every asked key, by chunk, and how many keys have one."""
    ks = [expand_keys(k) for k in keys]
    key, at = np.unique(np.concatenate(ks), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([_expand(c) for c in counts]).astype(float),
                        minlength=len(key)).astype(np.int64)
    ends = np.cumsum([len(k) for k in ks])
    return np.split(total[at], ends[:-1]), int((total > 0).sum())


def _answers(requests: DataFrame) -> DataFrame:
    """``chunk, range, words, pairs`` (corpus counts), and for each range one
    row without a chunk whose ``vocabulary`` is its number of known words."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        words, known = _totals(list(pdf["words"]), list(pdf["word_counts"]))
        pairs, _ = _totals(list(pdf["pairs"]), list(pdf["pair_counts"]))
        out = pd.DataFrame({"chunk": pdf["chunk"].astype(object), "range": pdf["range"],
                            "words": [_squeeze(x) for x in words],
                            "pairs": [_squeeze(x) for x in pairs], "vocabulary": 0})
        tail = pd.DataFrame({"chunk": [None], "range": [pdf["range"].iloc[0]], "words": [b""],
                             "pairs": [b""], "vocabulary": [known]})
        return pd.concat([out, tail], ignore_index=True)

    return requests.groupBy("range").applyInPandas(
        count, "chunk string, range int, words binary, pairs binary, vocabulary long")


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + log2 of its count, at most BUCKETS - 1."""
    return np.where(count > 0, np.minimum(BUCKETS - 1, 1 + np.log2(np.maximum(count, 1)).astype(int)), 0)


def _counted(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """``doc_ids, lengths, training, held_out, places, counts, pair_counts,
    pair`` per chunk: the corpus counts of its words and pairs, and the place
    of each token among them."""
    found = answers.where("chunk is not null").groupBy("chunk").agg(
        F.array_sort(F.collect_list(F.struct("range", "words", "pairs"))).alias("found"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                words, places, context, pairs, pair, _ = _unfold(row)
                w = np.concatenate([_expand(x["words"]) for x in row["found"]]).astype(np.int64)
                p = np.concatenate([_expand(x["pairs"]) for x in row["found"]]).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    **{c: [row[c]] for c in ("doc_ids", "lengths", "training", "held_out", "places")},
                    "counts": [_squeeze(w)], "pair_counts": [_squeeze(p)], "pair": [_squeeze(pair)]},
                    schema=pa.schema([("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                                      ("training", pa.list_(pa.bool_())),
                                      ("held_out", pa.list_(pa.bool_())), ("places", pa.binary()),
                                      ("counts", pa.binary()), ("pair_counts", pa.binary()),
                                      ("pair", pa.binary())]))

    return chunks.join(found, "chunk").mapInArrow(
        run, "doc_ids array<long>, lengths array<long>, training array<boolean>, "
             "held_out array<boolean>, places binary, counts binary, pair_counts binary, pair binary")


def _token_counts(row: dict, starts: int):
    """(count of each token, of its context, of the pair, training mask,
    document offsets)."""
    counts = np.append(_expand(row["counts"]).astype(np.int64), starts)
    places = _expand(row["places"]).astype(np.int64)
    lengths = np.array(row["lengths"], np.int64)
    context = np.empty_like(places)
    context[1:] = places[:-1]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    context[offsets[:-1]] = len(counts) - 1
    pair = _expand(row["pair_counts"]).astype(np.int64)[_expand(row["pair"]).astype(np.int64)]
    return counts[places], counts[context], pair, np.repeat(np.array(row["training"], bool), lengths), \
        offsets


def _bins(x: np.ndarray) -> np.ndarray:
    """Log bin of an estimate; -1000 for nought."""
    return np.where(x > 0, np.floor(np.log(np.maximum(x, 1e-300)) * _STEP), -1000).astype(np.int64)


def _centre(b: np.ndarray) -> np.ndarray:
    return np.where(b == -1000, 0.0, np.exp((b + 0.5) / _STEP))


def mixture(table: np.ndarray, vocabulary: int) -> np.ndarray:
    """Weights by bucket (pair, word, uniform) from rows ``bucket, pair bin,
    word bin, tokens`` of deleted estimates, by expectation maximisation."""
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    if not len(table):
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    bucket, n = table[:, 0].astype(int), table[:, 3].astype(float)
    p = np.stack([np.minimum(1, _centre(table[:, 1])), np.minimum(1, _centre(table[:, 2])),
                  np.full(len(table), 1 / (vocabulary + 1))], axis=1)
    for _ in range(EM_STEPS):
        part = weights[bucket] * p
        part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        total = np.stack([np.bincount(bucket, part[:, k], BUCKETS) for k in range(3)], axis=1)
        seen = total.sum(axis=1) > 0
        weights[seen] = total[seen] / total[seen].sum(axis=1, keepdims=True)
    weights = np.maximum(weights, [0.0, 0.0, 1e-6])
    return weights / weights.sum(axis=1, keepdims=True)


def _deleted(counted: DataFrame, tokens: int, starts: int) -> DataFrame:
    """``bucket, pair, word, n``: training tokens by bins of the estimates that
    the rest of the training counts give for them."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                word, context, pair, training, _ = _token_counts(row, starts)
                word, context, pair = word[training] - 1, context[training] - 1, pair[training] - 1
                cells = np.stack([_bucket(context), _bins(pair / np.maximum(context, 1)),
                                  _bins(word / max(tokens - 1, 1))], axis=1)
                cells, n = np.unique(cells, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells[:, k]) for k in range(3)]
                                                 + [pa.array(n)], names=["bucket", "pair", "word", "n"])

    return counted.mapInArrow(run, "bucket long, pair long, word long, n long") \
        .groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n"))


def scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    for every row."""
    r = remainder("doc_id", 10)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(r != 0, F.lit(False)).alias("training"),
                       F.coalesce(r == 0, F.lit(False)).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    chunks = stored(_chunks(rows), "op9-chunks")
    size = chunks.select(F.explode(F.arrays_zip("lengths", "training")).alias("d")).agg(
        F.coalesce(F.sum("d.lengths"), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("d.training"), F.col("d.lengths"))), F.lit(0)),
        F.count_if("d.training")).first()
    every, tokens, starts = (int(x) for x in size)
    answers = stored(_answers(_requests(chunks, 1 + 2 * every // RANGE_KEYS)), "op9-answers")
    vocabulary = int(answers.agg(F.coalesce(F.sum("vocabulary"), F.lit(0))).first()[0])
    counted = stored(_counted(chunks, answers), "op9-counted")
    cells = _deleted(counted, tokens, starts).select("bucket", "pair", "word", "n").collect()
    weights = mixture(np.array([tuple(c) for c in cells], np.int64).reshape(-1, 4), vocabulary)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                word, context, pair, _, offsets = _token_counts(row, starts)
                base = np.log10((word + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
                w = weights[_bucket(context)]
                p = (w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1)
                     + w[:, 2] / (vocabulary + 1))
                at = offsets[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()),
                     pa.array(np.diff(offsets)), pa.array(np.add.reduceat((word > 0).astype(np.int64), at)),
                     pa.array(np.full(len(at), tokens, np.int64)), pa.array(np.add.reduceat(base, at)),
                     pa.array(np.add.reduceat(np.log10(p), at))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                           "score"])

    return counted.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, "
                                   "train_tokens long, base_score double, score double")

"""Vector code compression with per-dimension value dictionaries (operator 11).

Vectors become integers, are cut into consecutive parts, and every part is
replaced by the index of the nearest entry of its position's codebook.  The
vectors are stored once as dictionary codes: a chunk of at most ``CHUNK``
vectors holds, for every dimension, the distinct integers that occur in it and
each vector's place among them.  A pass over the chunks tabulates, for every
distinct integer of a dimension, the squared difference to that dimension of
all entries; the distance of a part to all entries is then a gather from these
tables and an add per dimension.  Sums for new entries come from counts of
(entry, dictionary code) times the dictionary, so no vector is decoded again.

Chunks are rows of a table in the shared folder: tasks read them in any order,
and what a task keeps is bounded by one chunk.  The driver holds the codebooks
only (entries times dimensions integers).

Defined cases: rows whose vector is NULL or holds NULL, NaN or an infinity are
left out; the dimension is that of the first starting vector, and kept vectors
of another length stay with NULL code and error and take no part in training;
with a dimension that the number of parts doesn't divide, parts are as equal as
possible (part p begins at p * dimension // parts); an integer beyond 2^27 is
held at 2^27, so that a distance fits into a long; with fewer kept vectors than
entries, the codebook has as many entries as vectors; vectors of equal id start
in the order of their components, and NULL ids come last; repeated rows are
vectors of their own; the error of a label with no coded vector is NULL; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dashframe.llm.common import join_by_key, ship_package, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256.0
CHUNK = 4096          # vectors in a chunk: dictionary codes fit into 16 bits
LIMIT = 1 << 27


def finite(vector):
    """Column: the vector has only finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                               & (F.abs(x) != float("inf"))), F.lit(False))


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values), -LIMIT, LIMIT).astype(np.int64)


def bounds(dimension: int, parts: int) -> list[int]:
    return [p * dimension // parts for p in range(parts + 1)]


def _chunks(dimension: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                b = batch.slice(at, CHUNK)
                flat = b.column("vector").flatten().to_numpy(zero_copy_only=False)
                x = integers(flat.reshape(b.num_rows, dimension))
                sizes, values, codes = [], [], np.empty((dimension, b.num_rows), np.uint16)
                for d in range(dimension):
                    distinct, place = np.unique(x[:, d], return_inverse=True)
                    sizes.append(len(distinct))
                    values.append(distinct)
                    codes[d] = place
                one = [0, b.num_rows]
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(one, b.column("vec_id")),
                    pa.ListArray.from_arrays(one, b.column("label")),
                    pa.array([sizes], pa.list_(pa.int32())),
                    pa.array([np.concatenate(values or [np.empty(0, np.int64)])], pa.list_(pa.int64())),
                    pa.array([codes.tobytes()], pa.binary())], schema=schema)
    return run


class _Coder:
    """Assigns the vectors of a chunk to the nearest entries of every part."""

    def __init__(self, books: np.ndarray, parts: int):
        self.books, self.cuts = books, bounds(books.shape[1], parts)

    def read(self, sizes, values: np.ndarray, codes: bytes):
        dims = self.books.shape[1]
        n = len(codes) // (2 * dims) if dims else 0
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return ([values[ends[d]:ends[d + 1]] for d in range(dims)],
                np.frombuffer(codes, np.uint16).reshape(dims, n))

    def assign(self, dictionary, codes, n: int):
        """(n, parts) entry of every part and its squared distance."""
        parts = len(self.cuts) - 1
        entry, distance = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
        for p in range(parts):
            total = np.zeros((n, len(self.books)), np.int64)
            for d in range(self.cuts[p], self.cuts[p + 1]):
                table = (dictionary[d][:, None] - self.books[:, d][None, :]) ** 2
                total += table[codes[d]]
            entry[:, p] = total.argmin(axis=1)      # the first of equals
            distance[:, p] = total.min(axis=1)
        return entry, distance


def _sums(books: np.ndarray, parts: int, schema: pa.Schema):
    def run(batches):
        coder = _Coder(books, parts)
        k, dims = books.shape
        total, used = np.zeros((k, dims), np.int64), np.zeros((k, parts), np.int64)
        for b in batches:
            for ids, sizes, values, codes in zip(*(b.column(c) for c in ("ids", "sizes", "distinct", "codes"))):
                dictionary, place = coder.read(sizes.values.to_numpy(), values.values.to_numpy(), codes.as_py())
                entry, _ = coder.assign(dictionary, place, len(ids))
                for p in range(parts):
                    used[:, p] += np.bincount(entry[:, p], minlength=k)
                    for d in range(coder.cuts[p], coder.cuts[p + 1]):
                        u = len(dictionary[d])
                        seen = np.bincount(entry[:, p] * u + place[d], minlength=k * u).reshape(k, u)
                        total[:, d] += seen @ dictionary[d]
        of = np.searchsorted(coder.cuts, np.arange(dims), side="right") - 1
        entries, dim = np.nonzero(used[:, of]) if dims else (np.empty(0, int), np.empty(0, int))
        yield pa.RecordBatch.from_arrays([
            pa.array(dim, pa.int32()), pa.array(entries, pa.int32()),
            pa.array(total[entries, dim], pa.int64()), pa.array(used[entries, of[dim]], pa.int64())],
            schema=schema)
    return run


def _coded(books: np.ndarray, parts: int, schema: pa.Schema):
    def run(batches):
        coder = _Coder(books, parts)
        for b in batches:
            for i in range(b.num_rows):
                ids, labels, sizes, values, codes = (b.column(c)[i] for c in (
                    "ids", "labels", "sizes", "distinct", "codes"))
                dictionary, place = coder.read(sizes.values.to_numpy(), values.values.to_numpy(), codes.as_py())
                entry, distance = coder.assign(dictionary, place, len(ids))
                names = [row.tobytes().hex() for row in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([
                    ids.values, labels.values, pa.array(names, pa.string()),
                    pa.array(distance.sum(axis=1), pa.int64())], schema=schema)
    return run


def train(chunks: DataFrame, books: np.ndarray, parts: int) -> np.ndarray:
    """One round: every used entry becomes the floor of the mean of its parts."""
    schema = "dim int, entry int, total long, used long"
    arrow = pa.schema([("dim", pa.int32()), ("entry", pa.int32()),
                       ("total", pa.int64()), ("used", pa.int64())])
    rows = (chunks.drop("labels").mapInArrow(_sums(books, parts, arrow), schema)
            .groupBy("dim", "entry").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
                                         F.sum("used").alias("used")))
    new = books.copy()
    for r in rows.collect():      # at most entries times dimensions
        new[r["entry"], r["dim"]] = int(r["total"]) // r["used"]
    return new


def digest(books: np.ndarray, parts: int) -> str:
    cuts = bounds(books.shape[1], parts)
    return hashlib.sha256(",".join(
        str(x) for p in range(parts) for entry in books[:, cuts[p]:cuts[p + 1]] for x in entry
    ).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every
    kept row of ``embeddings`` (columns ``vec_id``, ``embedding``, ``label``)."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    spark = embeddings.sparkSession
    ship_package(spark)
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                              F.col("embedding").cast("array<double>").alias("vector"), "label")
            .where(finite(F.col("vector"))))
    first = [r["vector"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()]
    dimension = len(first[0]) if first else 0
    first = [v for v in first if len(v) == dimension]
    books = integers(np.array(first, np.float64).reshape(len(first), dimension))

    label_type = rows.schema["label"].dataType
    chunk_type = T.StructType([
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("labels", T.ArrayType(label_type)),
        T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("distinct", T.ArrayType(T.LongType())),
        T.StructField("codes", T.BinaryType())])
    arrow_label = _arrow_type(label_type)
    chunk_arrow = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(arrow_label)),
                             ("sizes", pa.list_(pa.int32())), ("distinct", pa.list_(pa.int64())),
                             ("codes", pa.binary())])
    alike = F.size("vector") == dimension
    coded_type = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label_type),
                               T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded_arrow = pa.schema([("vec_id", pa.int64()), ("label", arrow_label),
                             ("code", pa.string()), ("error", pa.int64())])
    chunks = stored(rows.where(alike).mapInArrow(_chunks(dimension, chunk_arrow), chunk_type), "vector-chunks")
    for _ in range(rounds if len(books) else 0):
        books = train(chunks, books, parts)
    coded = stored(chunks.mapInArrow(_coded(books, parts, coded_arrow), coded_type)
                   .unionAll(rows.where(~alike).select(
                       "vec_id", "label", F.lit(None).cast("string"), F.lit(None).cast("long"))),
                   "vector-codes")
    totals = stored(coded.groupBy("label").agg(
        F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"),
        F.count(F.lit(1)).alias("n")), "label-errors")
    return (join_by_key(coded, totals, "label", "n")
            .select("vec_id", "label", "code", "error", "label_error",
                    F.lit(digest(books, parts)).alias("codebooks_sha256")))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


_ASSIGN = """
{name} AS (SELECT vec_id, rn, p, min(d * 64 + e) AS m FROM (
    SELECT s.vec_id, s.rn, s.p, c.e, CAST(sum((s.x - c.x) * (s.x - c.x)) AS BIGINT) AS d
    FROM piece s JOIN {books} c ON s.p = c.p AND s.pos = c.pos GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""

_UPDATE = """
{name} AS (SELECT c.p, c.e, c.pos, coalesce(n.x, c.x) AS x FROM {books} c LEFT JOIN (
    SELECT s.p, a.m % 64 AS e, s.pos, CAST(floor(sum(s.x) / count(*)) AS BIGINT) AS x
    FROM piece s JOIN {assigned} a ON s.rn = a.rn AND s.p = a.p GROUP BY 1, 2, 3) n
    ON c.p = n.p AND c.e = n.e AND c.pos = n.pos)"""

SQL = ("""
WITH kept AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rn,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT vec_id, rn, len(v) AS dims, unnest(v) AS x, unnest(range(len(v))) AS d FROM kept),
piece AS MATERIALIZED (SELECT vec_id, rn, d // (dims // 16) AS p, d % (dims // 16) AS pos, x FROM flat),
book0 AS (SELECT p, rn AS e, pos, x FROM piece WHERE rn < 64),"""
       + _ASSIGN.format(name="a0", books="book0") + "," + _UPDATE.format(name="book1", books="book0", assigned="a0")
       + "," + _ASSIGN.format(name="a1", books="book1") + ","
       + _UPDATE.format(name="book2", books="book1", assigned="a1") + ","
       + _ASSIGN.format(name="a2", books="book2") + """,
coded AS (SELECT vec_id, rn, string_agg(printf('%02x', CAST(m % 64 AS INTEGER)), '' ORDER BY p) AS code,
                 CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY 1, 2)
SELECT k.vec_id, code, error,
       CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, pos)) FROM book2) AS codebooks_sha256
FROM kept k JOIN coded c ON k.rn = c.rn""")

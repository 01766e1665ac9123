"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dashframe.session import shared_dir

MASK64 = (1 << 64) - 1
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once per application), so Python tasks
    find it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    # The driver's own folder: Spark copies the file to every executor.
    path = os.path.join(tempfile.mkdtemp(prefix="dashframe-py-"), "dashframe_pkg.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage at files that
    outlive any executor."""
    spark = df.sparkSession
    path = shared_dir(spark, name, temporary=True)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HOT_SHARE = 1024


def join_by_key(rows: DataFrame, side: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with the columns of ``side``, which holds one row for every
    ``key`` (NULL included) of ``rows`` and in ``n`` how many of them there are.

    Keys with more than a ``HOT_SHARE``-th of the rows, fewer than ``HOT_SHARE``
    by that, are joined by a broadcast; a shuffle deals the others.  Where all
    keys are of one kind, the plan holds that kind's join alone.  Both frames
    are stored ones: they are read more than once."""
    total, least, most = side.agg(F.sum(n), F.min(n), F.max(n)).first()
    side = side.withColumnRenamed(key, "__key")
    on = F.col(key).eqNullSafe(F.col("__key"))
    if total and least * HOT_SHARE > total:
        return rows.join(F.broadcast(side), on).drop("__key", n)
    if not total or most * HOT_SHARE <= total:
        return rows.join(side, on).drop("__key", n)
    hot = F.broadcast(side.where(F.col(n) * HOT_SHARE > total))
    dealt = rows.join(hot.select("__key"), on, "left_anti").join(
        side.where(F.col(n) * HOT_SHARE <= total), on)
    return rows.join(hot, on).unionAll(dealt).drop("__key", n)


# Cells of the bitmap of hashes, 1 MB.
CELLS = 1 << 23


def _cell(key: str) -> Column:
    return F.col(key).bitwiseAND(F.lit(CELLS - 1)) + 1


def nearly_among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key``, a 64-bit hash, is in ``keys``, and a few others
    that share its cell, for a join to deal no more than them.  A bitmap of the
    keys' cells (CELLS bits, whatever the number of keys) is broadcast."""
    part, bit = F.bitmap_bucket_number(_cell(key)), F.bitmap_bit_position(_cell(key))
    bitmap = keys.groupBy(part.alias("__part")).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return rows.withColumns({"__part": part, "__bit": bit}).join(F.broadcast(bitmap), "__part") \
        .where(F.getbit(byte.cast("int"), (F.col("__bit") % 8).cast("int")) == 1).drop("__part", "__bit", "__bits")


def lowest(rows: DataFrame, draw: Column, size: int) -> DataFrame:
    """Rows among which are the ``size`` ones of smallest ``draw`` (a 64-bit
    hash): those below a bound taken from one count, so that ordering them
    moves a few times ``size`` rows and not ``size`` rows of every partition.
    Too few below it (rows that share a hash) raise the bound, up to all rows."""
    share = min(1.0, 4 * size / max(rows.count(), 1))
    while share < 1:
        few = rows.where(draw < int(share * 2.0 ** 64) - (1 << 63))
        if few.count() >= size:
            return few
        share = min(1.0, 4 * share)
    return rows


def remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, mod ``mod`` (NULL for a NULL id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % mod


def text_key(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(c)


def binary_values(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding them."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def slices(batches, text_col: str = "text", chars: int = 4 << 20):
    """Arrow batches cut so that each holds at most ``chars`` bytes of text (or
    one row): bounds a task's memory whatever the batch size."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        at = 0
        while at < b.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + chars, side="right")))
            yield b.slice(at, end - at)
            at = end


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (uint64 arrays, wrapping)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
    return mix(g)


def with_schema(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) for f in schema], schema=schema)

"""Tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dashframe.functions.columns import col
from dashframe.session import shared_dir
from dashframe.spec import ALLOWED_EXTENSIONS, MAX_UPLOAD_BYTES


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             sep: str = ",") -> DataFrame:
    """CSV with a header row.  A declared schema avoids the inference pass
    (which reads the data once more); without one, types are inferred."""
    reader = spark.read.option("header", "true").option("sep", sep).option("mode", "PERMISSIVE")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", "true").csv(path)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Parquet (default), CSV or JSON at any Hadoop path."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "json" if path.endswith(".json")
                  else "parquet")
    if fmt == "csv":
        return read_csv(spark, path, options.get("schema"))
    return spark.read.format(fmt).options(**options).load(path)


def list_uploads(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES,
                 extensions=ALLOWED_EXTENSIONS) -> DataFrame:
    """Every file under ``path`` with its size and whether it is accepted
    (allowed extension and at most ``max_bytes``).  Only file metadata is read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "length", "modificationTime"))
    ext_ok = F.lower(F.col("path")).rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions)
                                         + ")$")
    size_ok = F.col("length") <= max_bytes
    reason = (F.when(~ext_ok, F.lit("extension not allowed"))
              .when(~size_ok, F.lit("file too large")))
    return files.withColumn("accepted", ext_ok & size_ok).withColumn("reason", reason)


def store(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write the cleaned table to the shared store and read it back
    (the stored copy is the source of truth; it survives executor loss and
    cuts lineage)."""
    target = path or shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def records(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as one JSON record."""
    return df.select(F.to_json(F.struct(*[col(c) for c in df.columns])).alias(name))


def write_documents(docs: DataFrame, path: str) -> None:
    """Analysis documents as JSON lines."""
    docs.write.mode("overwrite").json(path)


class TableCache:
    """Cleaned tables by analysis id.  The stored Parquet copy is the
    source of truth; the cache only keeps DataFrame handles, so a miss -- a new driver, an evicted entry -- reloads the typed
    table from its path instead of re-parsing the raw upload."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._frames: dict[str, DataFrame] = {}
        self._paths: dict[str, str] = {}

    def put(self, analysis_id: str, df: DataFrame, path: str | None = None) -> DataFrame:
        target = path or shared_dir(self.spark, f"analysis-{analysis_id}")
        stored = store(df, analysis_id, target)
        self.drop(analysis_id)
        self._frames[analysis_id], self._paths[analysis_id] = stored, target
        return stored

    def get(self, analysis_id: str, storage_path: str | None = None) -> DataFrame | None:
        if analysis_id in self._frames:
            return self._frames[analysis_id]
        path = storage_path or self._paths.get(analysis_id)
        if not path:
            return None
        df = read_table(self.spark, path)
        self._frames[analysis_id], self._paths[analysis_id] = df, path
        return df

    def drop(self, analysis_id: str | None = None) -> None:
        """Forget one entry (or all); the stored copies stay."""
        ids = [analysis_id] if analysis_id else list(self._frames)
        for i in ids:
            self._frames.pop(i, None)

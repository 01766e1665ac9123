"""Session construction and the shared work folder.

On a cluster the session is handed to us already configured; we only read
settings from it.  Defaults are applied only where a setting is unset (tests,
local runs).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings applied only when the running session has none of its own.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "dashframe",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    A value is set here only when the session has none, which happens in
    local tests; on a cluster the setting names a shared filesystem path.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root:
        if sc is not None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        root = os.path.join(os.environ.get("TMPDIR", "/tmp"), "dashframe-checkpoints")
        try:
            spark.conf.set("spark.checkpoint.dir", root)
        except Exception:  # static in some deployments; the value is still used below
            pass
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def _context(spark):
    """The SparkContext when the session has one (not under Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:
        return None


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Path) of a path; driver side."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()), target


def shared_dir(spark: SparkSession, name: str, temporary: bool = False) -> str:
    """A fresh, unique folder under the shared checkpoint root; a temporary one
    is removed when the application ends."""
    path = f"{checkpoint_root(spark)}/dashframe/{name}-{uuid.uuid4().hex[:12]}"
    if temporary and _context(spark) is not None:
        fs, target = file_system(spark, path)
        fs.deleteOnExit(target)
    return path


def tasks_for(spark: SparkSession, rows: int, most: int) -> int:
    """Partitions for ``rows`` of which a task gets about ``most``: given to
    ``repartition``, adaptive execution does not merge them.  Few rows keep the
    session's parallelism, very few go to fewer tasks."""
    few = min(spark.sparkContext.defaultParallelism, rows * 16 // most)
    return max(1, few, -(-rows // most))


def store(df, name: str):
    """Write ``df`` once to the shared folder and read it back: whatever uses
    the result sees the same rows, however often it is evaluated."""
    path = shared_dir(df.sparkSession, name, temporary=True)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

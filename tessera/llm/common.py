"""Helpers that the corpus operators share: shared storage, lineage cuts, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship  # noqa: F401

#: Rows up to which a side of a join of a few narrow columns is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of one Arrow batch (a row is never split): what a Python worker holds of a stage's input at a time.
ARROW_BYTES = 4 << 20
_UNBOUND = "67108864b"  # Spark's own value
_fresh: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    _fresh.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _fresh[-1]


def release(spark: SparkSession) -> None:
    """Delete all that ``fresh_path`` has named in this application: for the end of a job, when no result is read any more."""
    while _fresh:
        forget(spark, _fresh[-1])


def forget(spark: SparkSession, at: str) -> None:
    """Delete one of the paths that ``fresh_path`` has named, when nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if at in _fresh:
        _fresh.remove(at)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (df must be narrow and already cut), else df."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession) -> None:
    """Before a Python stage: ship the package, bound Arrow batches by bytes. A setting of the caller's own stays.

    The bound stays set in the session, as a stage's plan reads it only when it runs.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == _UNBOUND:
        spark.conf.set(key, str(ARROW_BYTES))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))

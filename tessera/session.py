"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package through Spark's own file server, once for an application."""
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    _shipped.add(app)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(), "tessera_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "tessera")):
            for f in sorted(names):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(at)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; where none is set and the master is local, in one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checked_broadcast(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else df: the same join then shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows that a task of ``dealt`` gets.
TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str, rows: DataFrame | int | None = None) -> DataFrame:
    """df by hash of keys, in as many partitions as give a task about TASK_ROWS rows, so that its memory doesn't grow with the table.

    Aggregations and windows over these keys (and more) then need no further shuffle. rows: a frame that is cheaper to count and has about as many rows, or
    their number; df itself where none is given.
    """
    n = rows if isinstance(rows, int) else (df if rows is None else rows).count()
    return df.repartition(max(1, -(-n // TASK_ROWS)), *keys)


def local_session(name: str = "tessera", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and small runs; on a cluster the caller brings their own."""
    b = SparkSession.builder.appName(name).master(f"local[{cores}]")
    for k, v in {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "8g", **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()

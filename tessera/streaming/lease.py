"""One writer for each source, by a lease with a fencing number (ST8), and sinks that check it.

A folder holds a file for each term: ``000000007`` with the holder's name and the time until which it holds. A term is taken by creating the next file,
which only one can; a holder that stops renewing is taken over when its time is up. The number grows with each term: a sink commits
a batch under it and refuses a lesser one than it has seen, so what a former holder writes late never shows.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TTL_S = 60.0


class LeaseLost(RuntimeError):
    """Another writer has taken over, or the time is up."""


class _Folder:
    """A few file operations of Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        if not self.fs.exists(self._at("")):
            return []
        return sorted(n for x in self.fs.listStatus(self._at("")) if (n := x.getPath().getName()).isdigit())

    def create(self, name: str) -> bool:
        self.fs.mkdirs(self._at(""))
        try:
            return self.fs.createNewFile(self._at(name))
        except Exception as e:  # some stores raise where others say no
            if "AlreadyExists" in str(e):
                return False
            raise

    def put(self, name: str, value: dict) -> None:
        out = self.fs.create(self._at(name), True)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()

    def get(self, name: str) -> dict | None:
        """None: just created, or being written right now."""
        stream = self.fs.open(self._at(name))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        except ValueError:
            return None
        finally:
            stream.close()

    def age_s(self, name: str, now: float) -> float:
        return now - self.fs.getFileStatus(self._at(name)).getModificationTime() / 1000


class Lease:
    """A held term."""

    def __init__(self, folder: _Folder, name: str, owner: str, ttl_s: float, clock):
        self.folder, self.name, self.owner, self.ttl_s, self.clock = folder, name, owner, ttl_s, clock
        self.number = int(name)
        self.renew()

    def renew(self) -> None:
        until = self.clock() + self.ttl_s
        self.folder.put(self.name, {"owner": self.owner, "until": until})
        self.until = until

    def check(self) -> None:
        if self.folder.names()[-1] != self.name:
            raise LeaseLost(f"term {self.number} of {self.owner} was taken over")
        if self.until < self.clock():
            raise LeaseLost(f"term {self.number} of {self.owner} has run out")

    def release(self) -> None:
        self.until = 0.0
        if self.folder.names()[-1] == self.name:
            self.folder.put(self.name, {"owner": self.owner, "until": 0})


def acquire(spark: SparkSession, path: str, owner: str | None = None, ttl_s: float = TTL_S, clock=time.time) -> Lease | None:
    """A lease, or None while another holds it."""
    folder, owner = _Folder(spark, path), owner or uuid.uuid4().hex
    names = folder.names()
    if names:
        held = folder.get(names[-1])
        # a holder that died between creating its file and writing it counts from the file's time
        if held["until"] >= clock() if held else folder.age_s(names[-1], clock()) < ttl_s:
            return None
    name = f"{int(names[-1]) + 1 if names else 1:09d}"
    return Lease(folder, name, owner, ttl_s, clock) if folder.create(name) else None


@contextmanager
def source_lease(spark: SparkSession, path: str, mode: str = "fail", ttl_s: float = TTL_S, wait_s: float = 0.2, most_s: float = 600.0):
    """ST8: a lease that renews itself. mode: skip (gives None), fail (an error) or wait."""
    end = time.monotonic() + most_s
    while (lease := acquire(spark, path, ttl_s=ttl_s)) is None:
        if mode == "skip":
            break
        if mode == "fail" or time.monotonic() > end:
            raise RuntimeError(f"another writer holds {path}")
        time.sleep(wait_s)
    stop = threading.Event()

    def beat() -> None:
        while not stop.wait(ttl_s / 3):
            if lease.folder.names()[-1] != lease.name:
                return
            lease.renew()

    pulse = threading.Thread(target=beat, daemon=True)
    if lease is not None:
        pulse.start()
    try:
        yield lease
    finally:
        stop.set()
        if lease is not None:
            pulse.join()
            lease.release()


def commit(df: DataFrame, table: str, lease: Lease) -> int:
    """df as the table's next batch. The rows are written aside; a commit file, which only one can create, makes them count. Gives the batch's number.

    Refused (``LeaseLost``) if the lease is lost or a later term has committed.
    """
    spark = df.sparkSession
    lease.check()
    at = f"rows-{uuid.uuid4().hex}"
    df.write.parquet(f"{table.rstrip('/')}/{at}")
    log = _Folder(spark, f"{table.rstrip('/')}/_commits")
    while True:
        lease.check()
        names = log.names()
        if any((log.get(n) or {}).get("term", 0) > lease.number for n in names[-1:]):
            raise LeaseLost(f"a later term than {lease.number} has committed")
        name = f"{int(names[-1]) + 1 if names else 1:09d}"
        if log.create(name):
            log.put(name, {"term": lease.number, "at": at})
            return int(name)


def committed(spark: SparkSession, table: str) -> DataFrame | None:
    """The rows of all commits; None if there are none. Of two that got in each other's way, the one of a lesser term than one before it doesn't count."""
    log, paths, term = _Folder(spark, f"{table.rstrip('/')}/_commits"), [], 0
    for n in log.names():
        if (c := log.get(n)) and c["term"] >= term:
            term = c["term"]
            paths.append(f"{table.rstrip('/')}/{c['at']}")
    return spark.read.parquet(*paths) if paths else None

"""JSON-lines logs as a splittable source (SC10-SC12, SC14-SC15, ST7): batch and stream readers over byte ranges of files.

A file is dealt out in ranges; a range owns the lines that begin in it, so a task reads a range and the rest of its last line, whatever the
size of the file. Only what is asked for is read: a tail costs the tail. The stream's offset is a map of file to byte: all up to
the last line end. A file that has shrunk, or whose offset is no line's begin (rotation, a rewrite), is read anew.

``spark.dataSource.register(LogSource)``, then ``spark.read`` or ``spark.readStream`` with format ``tessera_logs`` and the options path, layout (a key of
``LAYOUTS``) or pattern (a regular expression for relative paths), split (bytes of a range), since and until (microseconds of modification, exclusive and inclusive). ``read`` and ``tails`` do that for DataFrames.

Files are opened through pyarrow's file systems, which know local paths and the common stores by URI.

Defined cases: an empty file has no line; a last line without an end is a line of a batch and waits in a stream and in tails; blank lines are lines (readers of
events pass over them); bytes are kept as they are; a missing folder is empty; files that vanish while they are read fail the task, which is tried again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.session import ship

#: Which files below a source's folder are logs (relative paths).
LAYOUTS = {
    "claude-code": r"history\.jsonl|projects/[^/]+/[^/]+\.jsonl",
    "codex": r"history\.jsonl|sessions/(?:.+/)?[^/]+\.jsonl",
    "all": r"(?:.+/)?[^/]+\.jsonl",
}
SPLIT = 64 << 20
CHUNK = 1 << 20
BATCH = 4 << 20
SCHEMA = "ref string, part long, n long, byte long, raw binary"
_ARROW = pa.schema([("ref", pa.string()), ("part", pa.int64()), ("n", pa.int64()), ("byte", pa.int64()), ("raw", pa.binary())])


@dataclass
class ByteRange(InputPartition):
    """Lines that begin at ``start`` or later and before ``stop``; the file counts up to ``end``."""

    uri: str
    ref: str
    start: int
    stop: int
    end: int


def opened(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def lines_of(r: ByteRange) -> Iterator[tuple[int, bytes]]:
    """(place, line without its end) of a range."""
    with opened(r.uri) as f:
        at, held, place = max(0, r.start - 1), bytearray(), None
        f.seek(at)
        if r.start == 0:
            place = 0
        while at < r.end and (place is None or place < r.stop):
            data = f.read(min(CHUNK, r.end - at))
            if not data:
                break
            at += len(data)
            held += data
            if place is None:  # up to the first line's begin
                if (i := held.find(b"\n")) < 0:
                    held.clear()
                    continue
                place, held = at - len(held) + i + 1, held[i + 1 :]
            parts = held.split(b"\n") if b"\n" in data else [held]
            for line in parts[:-1]:
                if place >= r.stop:
                    return
                yield place, bytes(line)
                place += len(line) + 1
            held = parts[-1]
        if place is not None and held and place < r.stop and at >= r.end:
            yield place, bytes(held)


def ranges(uri: str, ref: str, start: int, end: int, split: int) -> Iterator[ByteRange]:
    for a in range(start, end, split):
        yield ByteRange(uri, ref, a, min(a + split, end), end)


def batches(r: ByteRange) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for n, (place, line) in enumerate(lines_of(r)):
        rows.append((r.ref, r.start, n, place, line))
        size += len(line) + 64
        if size >= BATCH:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def listed(options) -> list[tuple[str, str, int, int]]:
    """uri, ref, size, mtime in microseconds of the logs below a folder, in order of time and name."""
    fs, base = pafs.FileSystem.from_uri(options["path"])
    head = options["path"][: len(options["path"]) - len(base)] if options["path"].endswith(base) else ""
    base = base.rstrip("/")
    wanted = re.compile(options.get("pattern") or LAYOUTS[options.get("layout", "all")])
    since, until = int(options.get("since", -1)), int(options.get("until", 1 << 62))
    found = []
    for f in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
        rel, at = f.path[len(base) + 1 :], int((f.mtime_ns or 0) // 1000)
        if f.is_file and wanted.fullmatch(rel) and since < at <= until:
            found.append((head + f.path, rel, f.size, at))
    return sorted(found, key=lambda x: (x[3], x[1]))


def whole_lines(uri: str, size: int) -> int:
    """Bytes up to the last line end; read from behind."""
    with opened(uri) as f:
        at = size
        while at > 0:
            n = min(CHUNK, at)
            f.seek(at - n)
            if (i := f.read(n).rfind(b"\n")) >= 0:
                return at - n + i + 1
            at -= n
    return 0


def trusted(uri: str, offset: int, size: int) -> int:
    """SC11: the offset if a line begins there, else 0."""
    if not 0 < offset <= size:
        return 0
    with opened(uri) as f:
        f.seek(offset - 1)
        return offset if f.read(1) == b"\n" else 0


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        split = int(self.options.get("split", SPLIT))
        return [r for uri, ref, size, _ in listed(self.options) for r in ranges(uri, ref, 0, size, split)]

    def read(self, partition):
        return batches(partition) if partition is not None else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.known = options, {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        """Only files whose size has changed are looked into, from behind."""
        now = {}
        for uri, ref, size, at in listed(self.options):
            had = self.known.get(ref)
            now[ref] = had if had and had[:2] == (size, at) else (size, at, whole_lines(uri, size))
        self.known = now
        return {ref: x[2] for ref, x in now.items() if x[2]}

    def partitions(self, start, end):
        split, out = int(self.options.get("split", SPLIT)), []
        for uri, ref, size, _ in listed(self.options):
            upto = min(end.get(ref, 0), size)
            since = start.get(ref, 0)
            if upto != since:
                out += ranges(uri, ref, trusted(uri, since, upto), upto, split)
        return out or [None]

    def read(self, partition):
        return batches(partition) if partition is not None else iter(())

    def commit(self, end):
        pass


class LogSource(DataSource):
    """Format ``tessera_logs``."""

    @classmethod
    def name(cls):
        return "tessera_logs"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def _ready(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(LogSource)


def read(spark: SparkSession, path: str, layout: str = "all", split: int = SPLIT, **options) -> DataFrame:
    """SC14-SC15: all lines below a folder: ref, part (begin of the range), n (place in the range), byte, raw."""
    _ready(spark)
    return spark.read.format("tessera_logs").options(path=path, layout=layout, split=split, **options).load()


def stream(spark: SparkSession, path: str, layout: str = "all", split: int = SPLIT) -> DataFrame:
    """ST7: the same as a stream of new lines."""
    _ready(spark)
    return spark.readStream.format("tessera_logs").options(path=path, layout=layout, split=split).load()


def numbered(lines: DataFrame) -> DataFrame:
    """lines with ``line``: its number in the file, from the counts of the ranges before (a row for each range)."""
    before = Window.partitionBy("ref").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("ref", "part").agg(F.count("*").alias("rows")).select("ref", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__start"))
    return lines.join(starts, ["ref", "part"]).withColumn("line", F.col("__start") + F.col("n")).drop("__start")


def tails(files: DataFrame, offsets: DataFrame, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """SC10, ST7: what stands behind the offsets (ref, offset; the last of each counts), and the new ones (ref, from_, upto) of files with a new whole line.

    files: uri, ref, size. Ends and offsets are looked up by tasks, the ranges between are dealt out and read.
    """
    ship(files.sparkSession)
    last = offsets.groupBy("ref").agg(F.max("offset").alias("offset"))
    todo = files.join(last, "ref", "left").select("uri", "ref", F.col("size").cast("long").alias("size"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = b.to_pylist()
            upto = [whole_lines(r["uri"], r["size"]) for r in rows]
            since = [trusted(r["uri"], r["offset"], r["size"]) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(since, pa.int64()), pa.array(upto, pa.int64())], names=["uri", "ref", "from_", "upto"])

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = todo.repartition(tasks).mapInArrow(look, "uri string, ref string, from_ long, upto long").where("upto > from_")

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():
                yield from batches(ByteRange(r["uri"], r["ref"], r["start"], min(r["start"] + split, r["upto"]), r["upto"]))

    dealt = found.select("uri", "ref", "upto", F.explode(F.sequence("from_", F.col("upto") - 1, F.lit(split).cast("long"))).alias("start"))
    return dealt.repartition(tasks, "ref", "start").mapInArrow(go, SCHEMA), found.select("ref", "from_", "upto")

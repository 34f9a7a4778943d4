"""Pages as files, written once whatever tasks fail (SC3, Z7, Z35, M15).

Two steps. The data source ``tessera_pages`` stages rows (path, text): each attempt of a task writes below a folder of its own, with a list of what it wrote; the
commit names the lists of the attempts that counted, one for each task, and an abort leaves nothing that is read. ``publish`` then moves staged pages to
their places, in parallel: a move that was done before a task failed is seen and not done again. In create-only mode a page that is there stays, and the row says so.

Files are opened through pyarrow's file systems (local paths, common stores by URI).

Defined cases: paths are relative and may not leave the folder (an error); of equal paths in one job the first in text order is published, the others are
conflicts; a null text is empty; no rows make a commit without pages.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tessera.session import ship

STAGED, COMMITS = "_staged", "_commits"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    pages: int


def _put(fs, path: str, data: bytes) -> None:
    with fs.open_output_stream(path) as f:
        f.write(data)


class _Writer(DataSourceWriter):
    def __init__(self, base: str, job: str):
        self.base, self.job = base, job

    def write(self, iterator) -> Attempt:
        fs, base = pafs.FileSystem.from_uri(self.base)
        folder = f"{STAGED}/{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(f"{base}/{folder}", recursive=True)
        names = []
        for row in iterator:
            path = row["path"]
            if not path or path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"not a path within the folder: {path!r}")
            _put(fs, f"{base}/{folder}/{len(names)}.md", (row["text"] or "").encode())
            names.append(path)
        _put(fs, f"{base}/{folder}/list.json", "".join(json.dumps({"path": p, "staged": f"{folder}/{i}.md"}) + "\n" for i, p in enumerate(names)).encode())
        return Attempt(folder, len(names))

    def commit(self, messages) -> None:
        fs, base = pafs.FileSystem.from_uri(self.base)
        fs.create_dir(f"{base}/{COMMITS}", recursive=True)
        _put(fs, f"{base}/{COMMITS}/{self.job}.json", json.dumps([m.folder for m in messages if m is not None]).encode())

    def abort(self, messages) -> None:
        fs, base = pafs.FileSystem.from_uri(self.base)
        fs.delete_dir_contents(f"{base}/{STAGED}/{self.job}", missing_dir_ok=True)


class PageSink(DataSource):
    """Format ``tessera_pages``; options path and job."""

    @classmethod
    def name(cls):
        return "tessera_pages"

    def schema(self):
        return "path string, text string"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options["job"])


def stage(pages: DataFrame, base: str, job: str | None = None) -> str:
    """Stage pages (path, text) below base; gives the job's name."""
    spark, job = pages.sparkSession, job or uuid.uuid4().hex
    ship(spark)
    spark.dataSource.register(PageSink)
    pages.select("path", "text").write.format("tessera_pages").options(path=base, job=job).mode("append").save()
    return job


def publish(spark: SparkSession, base: str, job: str, replace: bool = False) -> DataFrame:
    """Move a committed job's pages to their places: path, status (created, replaced, conflict, done: by an earlier attempt)."""
    ship(spark)
    fs, root = pafs.FileSystem.from_uri(base)
    with fs.open_input_stream(f"{root}/{COMMITS}/{job}.json") as f:
        folders = json.loads(f.read())
    if not folders:
        return spark.createDataFrame([], "path string, status string")
    lists = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(min(len(folders), 1000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        for b in batches:
            for folder in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{folder}/list.json") as f:
                    rows = [json.loads(x) for x in f.read().splitlines()]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("staged", pa.string())]))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        made: set[str] = set()

        def there(path: str) -> bool:
            return fs.get_file_info(f"{root}/{path}").type == pafs.FileType.File

        def one(path: str, staged: str, first: str) -> str:
            if staged != first:
                return "conflict"
            if not there(staged):
                return "done"
            had = there(path)
            if had and not replace:
                return "conflict"
            if (folder := f"{root}/{path}".rpartition("/")[0]) not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            fs.move(f"{root}/{staged}", f"{root}/{path}")
            return "replaced" if had else "created"

        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(r["path"], r["staged"], r["first"]) for r in rows], pa.string())], names=["path", "status"])

    rows = lists.mapInArrow(read, "path string, staged string")
    first = rows.groupBy("path").agg(F.min("staged").alias("first"))
    done = rows.join(first, "path").select("path", "staged", "first").mapInArrow(move, "path string, status string")
    from tessera.operators.components import written

    return written(done, "published")

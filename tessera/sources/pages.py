"""Markdown pages with front matter (SC1-SC4, SC31-SC33)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.components import written
from tessera.operators.merge import fill_forward
from tessera.session import ship

FENCE = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)(.*)"
ANYWHERE = r"(?s)(?:\A|.*?\n)---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)(.*)"


def split_front_matter(texts: DataFrame, anywhere: bool = False) -> DataFrame:
    """SC1 (SC2 with anywhere): adds yaml and body; yaml is null where there is no front matter."""
    p = ANYWHERE if anywhere else FENCE
    hit = F.col("text").rlike(p)
    return texts.withColumns({"yaml": F.when(hit, F.regexp_extract("text", p, 1)), "body": F.when(hit, F.regexp_extract("text", p, 2)).otherwise(F.col("text"))})


#: JSON that YAML 1.1 reads otherwise: line ends of its own and tabs, unprintable characters, escapes that it doesn't know.
ODD = re.compile("[\t\x7f-\x9f\u2028\u2029\ufeff\ufffe\uffff\ud800-\udfff]|\\\\/|\\\\u[dD][89a-fA-F]")


def as_json(text: str) -> dict | None:
    """The mapping that text is if it is JSON and means the same as YAML; else None, which says nothing. YAML's own reader takes a hundred times as long."""

    def same(pairs: list[tuple[str, object]]) -> dict:
        if any(len(k) > 100 for k, _ in pairs):
            raise ValueError("YAML bounds keys")
        return dict(pairs)

    def plain(number: str) -> float:
        if "e" in number.lower():
            raise ValueError("YAML takes other exponents")
        return float(number)

    def refused(name: str):
        raise ValueError(name)

    if not text.startswith("{") or ODD.search(text):
        return None
    try:
        got = json.loads(text, object_pairs_hook=same, parse_float=plain, parse_constant=refused)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def front_matter_json(pages: DataFrame) -> DataFrame:
    """yaml to meta (JSON text); what is no mapping gives null. YAML has no built-in reader, so this is an Arrow stage.

    Without a YAML library only flat ``key: value`` and ``key: [a, b]`` lines and JSON are read.
    """
    ship(pages.sparkSession)

    def flat(text: str):
        out = {}
        for row in text.splitlines():
            k, mark, v = row.partition(":")
            if mark and k.strip() and not row.startswith((" ", "-", "#")):
                v = v.strip()
                out[k.strip()] = [x.strip().strip("'\"") for x in v[1:-1].split(",") if x.strip()] if v[:1] == "[" else v.strip("'\"")
        return out or None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from yaml import YAMLError, safe_load
        except ImportError:
            YAMLError, safe_load = ValueError, flat

        def meta(t):
            try:
                got = (as_json(t) or safe_load(t)) if t else None
            except YAMLError:
                return None
            return json.dumps(got, ensure_ascii=False, default=str) if isinstance(got, dict) else None

        for b in batches:
            yield b.assign(meta=[meta(t) for t in b.yaml])[["path", "meta", "body"]]

    return pages.select("path", "yaml", "body").mapInPandas(run, "path string, meta string, body string")


#: Entries of a folder that are listed at a time, and pages that a task reads.
LISTED, TASK_PAGES = 10_000, 20_000
#: What Spark's readers escape in a file's path.
ESCAPED = re.compile(r"[^A-Za-z0-9\-_.!~*'()/:@&=+$,;\x80-\U0010ffff]")
#: Bytes of pages that a task holds before they go on (a longer page goes alone).
HELD_BYTES = 4 << 20


def _seen(name: str) -> bool:
    """As Spark's readers: names that begin with a dot, or with an underscore and hold no equals sign, are passed over."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, str, bool]]:
    """path, name, whether it is a folder; local folders are streamed, those of stores come as pyarrow lists them, whole."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as entries:
            yield from ((x.path, x.name, x.is_dir()) for x in entries)
    else:
        yield from ((x.path, x.base_name, x.type == pafs.FileType.Directory) for x in fs.get_file_info(pafs.FileSelector(folder)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """SC4: all Markdown files below a folder: path, text. A page is a file, so files are read whole.

    Folders are listed in tasks, level by level, and pages are dealt out to tasks that open them, as Spark's reader keeps every file's status on the driver
    and takes milliseconds for each. What pyarrow's file systems can't open is left to that reader. An empty
    file is a page, which that reader passes over.
    """
    try:
        fs, root = pafs.FileSystem.from_uri(path)
        ours = fs.get_file_info(root).type == pafs.FileType.Directory
    except (pa.ArrowException, OSError):
        ours = False
    if not ours:
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    ship(spark)
    before = "file:" if isinstance(fs, pafs.LocalFileSystem) else path.partition("://")[0] + "://"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = ((at, sub) for at, name, sub in _entries(fs, folder) if _seen(name) and (sub or name.endswith(".md")))
                while rows := list(islice(found, LISTED)):
                    yield pa.RecordBatch.from_arrays([pa.array([at for at, _ in rows], pa.string()), pa.array([sub for _, sub in rows], pa.bool_())], names=["path", "folder"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([before + ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", at) for at, _ in held], pa.string()), pa.array([x for _, x in held], pa.binary())], names=["path", "text"])
        for b in batches:
            for at in b.column(0).to_pylist():
                with fs.open_input_stream(at, compression=None) as f:
                    held.append((at, f.read()))
                size += len(held[-1][1])
                if size > HELD_BYTES or len(held) == LISTED:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    level, files = spark.createDataFrame([(root,)], "path string"), None
    while True:
        found = written(level.mapInArrow(listed, "path string, folder boolean"), "listing")
        here, level = found.where("NOT folder").select("path"), found.where("folder").select("path")
        files = here if files is None else files.unionByName(here)
        if not (folders := level.count()):
            break
        level = level.repartition(min(folders, 1000), "path")
    tasks = max(spark.sparkContext.defaultParallelism, -(-files.count() // TASK_PAGES))
    return files.repartition(tasks, "path").mapInArrow(read, "path string, text binary").select("path", F.col("text").cast("string").alias("text"))


def page_text(rows: DataFrame) -> DataFrame:
    """SC3: meta (JSON, which is YAML) and body as a page."""
    return rows.withColumn("text", F.concat(F.lit("---\n"), "meta", F.lit("\n---\n\n"), F.regexp_replace("body", r"^\n+", "")))


def profile_facts(lines: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """SC31: page, pos, statement of bullets under category headings. lines: page, pos, line."""
    h2 = fill_forward(lines, "page", "pos", "##").withColumnRenamed("heading", "h2")
    norm = X.normalize("h2")
    decided = norm.startswith("decision patterns")
    h3 = fill_forward(h2, "page", "pos", "###").withColumnRenamed("heading", "h3")
    last3 = F.when(F.col("line").rlike(r"^##\s"), F.lit(None)).otherwise(F.col("h3"))
    inside = ~decided & F.col("h2").isNotNull() & (~norm.startswith("profile facts") | last3.isin(*categories) if categories else ~norm.startswith("profile facts"))
    said = F.trim(F.regexp_replace(F.regexp_extract("line", r"^\s*[-*]\s+(.+?)\s*$", 1), r"^\[[0-9.]+\]\s*", ""))
    return h3.where(inside).select("page", "pos", said.alias("statement")).where("statement <> ''")


def pattern_triggers(lines: DataFrame) -> DataFrame:
    """SC32: page, pos, trigger of third-level headings in approved sections."""
    h2 = fill_forward(lines, "page", "pos", "##")
    n = X.normalize("heading")
    ok = (n == "approved patterns") | n.startswith("decision patterns")
    return h2.where(ok & F.col("line").rlike(r"^###\s+\S")).select("page", "pos", F.regexp_extract("line", r"^###\s+(.+?)\s*$", 1).alias("trigger"))


def pattern_records(lines: DataFrame) -> DataFrame:
    """SC33: page, pattern_id, trigger, action of ``key: value`` lines; a new trigger begins a record."""
    from pyspark.sql import Window

    p = r"^\s*(?:[-*]\s*)?(trigger|action|rationale|confidence):\s*(.+?)\s*$"
    kv = lines.where(F.col("line").rlike(p)).select("page", "pos", F.regexp_extract("line", p, 1).alias("k"), F.regexp_extract("line", p, 2).alias("v"))
    w = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rec = kv.withColumn("rec", F.count_if(F.col("k") == "trigger").over(w))
    got = rec.groupBy("page", "rec").agg(*[F.max_by(F.when(F.col("k") == k, F.col("v")), F.when(F.col("k") == k, F.col("pos"))).alias(k) for k in ("trigger", "action")])
    return got.where("trigger IS NOT NULL AND action IS NOT NULL").select("page", X.pattern_id("trigger", "action").alias("pattern_id"), "trigger", "action")

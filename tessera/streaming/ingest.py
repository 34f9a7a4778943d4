"""Incremental ingest as Structured Streaming (ST1-ST9), and cycles over files that grow."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import logs, raw

MAX_FILES = 10


def line_stream(spark: SparkSession, path: str, max_files: int = MAX_FILES, pattern: str = "*.jsonl") -> DataFrame:
    """ST1, ST7: new files as they come, at most 10 a cycle: ref, value, ts. Files are tracked by name, so a late one with an old time isn't lost."""
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
        .select(F.col("_metadata.file_path").alias("ref"), "value", F.col("_metadata.file_modification_time").alias("ts"))
    )


def text_stream(lines: DataFrame, source: str = "claude-code") -> DataFrame:
    """Texts of chat events."""
    e = raw.event("value")
    return lines.select("ref", "ts", (raw.codex_text(e) if source == "codex" else raw.chat_text(e)).alias("text")).where("text <> ''")


def run_once(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """ST1, ST5: all that is there, in batches, then stop. A repeated call reads only what is new; a failed batch is run again."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def settled_sessions(events: DataFrame, by: str = "user_id", idle: str = "30 minutes", late: str | None = None) -> DataFrame:
    """ST4: by, start, end, events of sessions that idle ends. On a stream ``late`` is the watermark's delay."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(by, F.session_window("ts", idle).alias("w")).agg(F.count("*").cast("long").alias("events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def advance(outcomes: DataFrame) -> DataFrame:
    """ST2: source, iso: the latest time (text order) of documents that are done with: read, too large, or dead."""
    return outcomes.where(F.col("outcome").isin("ok", "oversize", "dead")).groupBy("source").agg(F.max("iso").alias("iso"))


def run_cycle(files: DataFrame, offsets: DataFrame, failures: DataFrame, apply, since_us: int = -1, now_us: int | None = None, min_age_us: int = 0, limit: int = MAX_FILES, dead: int = 2) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """ST1-ST3, ST7: one cycle over at most ``limit`` settled files with something new, each checkpointed by itself.

    files: ref, mtime_us, size, content; offsets: ref, offset; failures: ref, n. ``apply`` gets (ref, a DataFrame of its tail) and may raise:
    the file is tried again in the next cycle, and after ``dead`` failures it is passed over (a dead letter). Gives the new offsets and
    failures, and (ref, outcome: ok, failed or dead) in order of time. A cycle has a handful of files, so they are gone through one by one.
    """
    spark = files.sparkSession
    gone = failures.where(F.col("n") >= dead).select("ref")
    todo = raw.new_tails(raw.pending(files, since_us, now_us, min_age_us).join(gone, "ref", "left_anti"), offsets)
    batch = todo.orderBy("mtime_us", "ref").limit(limit).collect()
    at = {r["ref"]: r["offset"] for r in offsets.groupBy("ref").agg(F.max("offset").alias("offset")).join(spark.createDataFrame([(r["ref"],) for r in batch], "ref string"), "ref").collect()} if batch else {}
    bad = {r["ref"]: r["n"] for r in failures.collect()}
    done = []
    for r in batch:
        try:
            apply(r["ref"], spark.createDataFrame([(r["ref"], r["tail"])], "ref string, tail binary"))
        except Exception:  # a bad document doesn't stop the cycle
            bad[r["ref"]] = bad.get(r["ref"], 0) + 1
            done.append((r["ref"], "dead" if bad[r["ref"]] >= dead else "failed"))
            continue
        at[r["ref"]] = r["upto"]
        bad.pop(r["ref"], None)
        done.append((r["ref"], "ok"))
    ok = spark.createDataFrame([(ref, at[ref]) for ref, how in done if how == "ok"], "ref string, offset long")
    # a file read anew after it shrank has a smaller offset than before, so its old ones go
    kept = offsets.join(ok.select("ref"), "ref", "left_anti").select("ref", "offset")
    return kept.unionByName(ok), spark.createDataFrame(list(bad.items()), "ref string, n long"), done


def run_tails(files: DataFrame, offsets: DataFrame, failures: DataFrame, apply, since_us: int = -1, now_us: int | None = None, min_age_us: int = 0, limit: int = MAX_FILES, dead: int = 2) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """ST1-ST3, ST7: ``run_cycle`` without file contents on the driver: files are uri, ref, mtime_us, size, and ``apply`` gets (ref, a DataFrame of its new
    lines as of ``logs.tails``), which tasks read in ranges. The driver sees the names, places and failures of the cycle's few files only."""
    spark = files.sparkSession
    gone = failures.where(F.col("n") >= dead).select("ref")
    open_ = raw.pending(files.join(gone, "ref", "left_anti"), since_us, now_us, min_age_us)
    new = logs.tails(open_, offsets)[1].join(open_, "ref").orderBy("mtime_us", "ref").limit(limit).select("uri", "ref", "size", "from_", "upto").collect()
    if not new:
        return offsets, failures, []
    mine = spark.createDataFrame([(r["ref"],) for r in new], "ref string")
    bad = {r["ref"]: r["n"] for r in failures.join(F.broadcast(mine), "ref", "left_semi").collect()}
    done, at = [], {}
    for r in new:
        one = spark.createDataFrame([(r["uri"], r["ref"], r["upto"])], "uri string, ref string, size long")
        try:
            apply(r["ref"], logs.tails(one, spark.createDataFrame([(r["ref"], r["from_"])], "ref string, offset long"))[0])
        except Exception:  # a bad document doesn't stop the cycle
            bad[r["ref"]] = bad.get(r["ref"], 0) + 1
            done.append((r["ref"], "dead" if bad[r["ref"]] >= dead else "failed"))
            continue
        at[r["ref"]] = r["upto"]
        bad.pop(r["ref"], None)
        done.append((r["ref"], "ok"))
    read = spark.createDataFrame(list(at.items()), "ref string, offset long")
    kept = offsets.join(read.select("ref"), "ref", "left_anti").select("ref", "offset").unionByName(read)
    lost = failures.join(F.broadcast(mine), "ref", "left_anti").select("ref", "n").unionByName(spark.createDataFrame(list(bad.items()), "ref string, n long"))
    return kept, lost, done


def backfill(step, most: int = 1000) -> list[list[tuple[str, str]]]:
    """ST5: cycles until nothing is left; stops when a cycle has only failures. step gives a cycle's (ref, outcome) list."""
    out: list[list[tuple[str, str]]] = []
    while len(out) < most and (now := step()):
        out.append(now)
        if all(how == "failed" for _, how in now):
            break
    return out


@contextmanager
def source_lock(spark: SparkSession, path: str, mode: str = "fail", wait_s: float = 0.2, most_s: float = 60.0):
    """ST8: one writer for each source: a file that only one can create. mode: skip (gives False), fail (an error) or wait."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    end = time.monotonic() + most_s
    while not (held := fs.createNewFile(at)):
        if mode == "skip":
            break
        if mode == "fail" or time.monotonic() > end:
            raise RuntimeError(f"another writer holds {path}")
        time.sleep(wait_s)
    try:
        yield held
    finally:
        if held:
            fs.delete(at, False)


def dead_letters(spark: SparkSession, stream: DataFrame, apply, table: str, checkpoint: str) -> None:
    """ST3: ``apply`` (a function of a batch) runs on each batch; references of a batch that fails are kept with their error, and the stream goes on."""

    def one(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            apply(batch)
        except Exception as e:  # the batch's references are retried from the table
            batch.select("ref").distinct().withColumns({"batch": F.lit(n), "error": F.lit(str(e)[:240])}).write.mode("append").parquet(table)
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_stages(stages: list[tuple[str, tuple[str, ...], object]], only: tuple[str, ...] = (), skip: tuple[str, ...] = (), resume_from: str | None = None) -> list[tuple[str, str]]:
    """ST9-ST10: (name, needs, action) in order; gives (name, ok, failed, skipped, resumed or blocked) for each.

    A stage whose upstream is missing, failed, blocked or skipped is blocked; stages before ``resume_from`` count as done.
    """
    done: dict[str, str] = {}
    before = resume_from is not None
    for name, needs, action in stages:
        before = before and name != resume_from
        if before:
            done[name] = "resumed"
        elif name in skip or only and name not in only:
            done[name] = "skipped"
        elif any(done.get(n) not in ("ok", "resumed") for n in needs if not only or n in only):
            done[name] = "blocked"
        else:
            try:
                action()
                done[name] = "ok"
            except Exception:  # a stage's failure blocks what needs it, not the rest
                done[name] = "failed"
    return list(done.items())

"""Raw logs: JSON lines to text, incremental reads, tails, mirrors, compaction (SC10-SC19, SC26-SC30, FP3-FP6, J14, A21, M17).

lines: ref, line (from 0), raw (binary or string). Lines that are no JSON object are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

# Lines among which the working folder is looked for; roles that stay; files of a tail; characters of a tail line.
CWD_LINES, ROLES = 30, ("user", "assistant")
TAIL_FILES, TAIL_CHARS, PROJECT_CHARS = 10, 400, 30
BLOCKS = "array<struct<type:string,text:string>>"


def event(raw="raw") -> Column:
    """The line as VARIANT, null if it is no JSON object."""
    t = F.trim(F.col(raw).cast("string"))
    return F.when(t.startswith("{"), F.try_parse_json(t))


def _get(e: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(e, path, kind)


def _is(e: Column, path: str, kind: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(e, path, "variant")).startswith(kind)


def _blocks(e: Column, path: str, only_text: bool) -> Column:
    """Texts of a list of blocks, joined by newlines; a string stands for itself."""
    items = _get(e, path, "array<variant>")
    text = lambda b: F.coalesce(F.when(F.lit(not only_text) | (F.try_variant_get(b, "$.type", "string") == "text"), F.try_variant_get(b, "$.text", "string")), F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")))
    joined = F.array_join(F.filter(F.transform(items, text), lambda s: s.isNotNull() & (s != "")), "\n")
    return F.when(_is(e, path, "STRING"), _get(e, path)).when(_is(e, path, "ARRAY"), F.coalesce(joined, F.lit("")))


def chat_text(e: Column) -> Column:
    """FP3."""
    return F.coalesce(_blocks(e, "$.message.content", True), F.lit(""))


def codex_text(e: Column) -> Column:
    """FP4."""
    kind, inner, role = _get(e, "$.type"), _get(e, "$.payload.type"), _get(e, "$.payload.role")
    said = F.when(_is(e, "$.payload.message", "STRING"), _get(e, "$.payload.message"))
    answer = _blocks(e, "$.payload.content", False)
    return F.coalesce(
        F.when((kind == "event_msg") & (inner == "user_message") & (X.collapse(said) != ""), F.concat(F.lit("User: "), said)),
        F.when((kind == "response_item") & (inner == "message") & (role == "assistant") & (X.collapse(answer) != ""), F.concat(F.lit("Assistant: "), answer)),
        F.lit(""),
    )


def documents(lines: DataFrame, source: str = "claude-code") -> DataFrame:
    """SC12: ref, text: each file's texts in line order, blank lines between; files without text are left out.

    A document is one value of the result, so its lines meet; nothing else is collected.
    """
    e = event()
    texts = lines.select("ref", "line", (codex_text(e) if source == "codex" else chat_text(e)).alias("text")).where("text <> ''")
    return texts.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def read_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """SC14-SC15: all JSON-lines files below a folder: ref, line, raw. Files are read whole, so that lines have numbers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("ref"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line", "raw")).where("raw <> ''")


def pending(files: DataFrame, since_us: int, now_us: int | None = None, min_age_us: int = 0, limit: int | None = None) -> DataFrame:
    """SC10, S4, ST4: files (ref, mtime_us, size) changed after ``since`` and settled, in (mtime, ref) order."""
    out = files.where(F.col("mtime_us") > since_us)
    out = out if now_us is None else out.where(F.col("mtime_us") <= now_us - min_age_us)
    out = out.orderBy("mtime_us", "ref")
    return out.limit(limit) if limit else out


def trusted_offset(content="content", offset="offset") -> Column:
    """SC11: the offset if it lies just after a newline, else 0."""
    o = F.coalesce(F.col(offset), F.lit(0))
    ok = (o > 0) & (o <= F.octet_length(content)) & (F.hex(F.substring(F.col(content), o.cast("int"), F.lit(1))) == "0A")
    return F.when(ok, o).otherwise(F.lit(0)).cast("long")


def new_tails(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """SC10, ST7: files (ref, mtime_us, content) and offsets (ref, offset; the last of each) to ref, mtime_us, from_, upto, tail.

    What stands behind a trusted offset, up to the last whole line; files without a new line are left out. A file that has shrunk, or
    whose offset isn't at a line's begin, is read anew.
    """
    last = offsets.groupBy("ref").agg(F.max("offset").alias("offset"))
    rows = files.join(last, "ref", "left").withColumn("from_", trusted_offset())
    # bytes behind the last newline: ISO-8859-1 has one character for each byte
    rest = F.length(F.substring_index(F.decode("content", "ISO-8859-1"), "\n", -1))
    rows = rows.withColumn("upto", (F.octet_length("content") - rest).cast("long")).where("upto > from_")
    return rows.select("ref", "mtime_us", "from_", "upto", F.substring("content", F.col("from_").cast("int") + 1, (F.col("upto") - F.col("from_")).cast("int")).alias("tail"))


def mirror_plan(files: DataFrame) -> DataFrame:
    """SC13: files (ref, size, complete: bytes up to the last newline, offset) to from_, upto, status."""
    o = F.coalesce("offset", F.lit(0))
    reset = F.col("size") < o
    start = F.when(reset, F.lit(0)).otherwise(o)
    status = F.when(F.col("size") == 0, F.lit("empty")).when(reset, F.lit("truncated")).when(F.col("complete") > start, F.lit("appended")).otherwise(F.lit("unchanged"))
    return files.select("ref", start.alias("from_"), F.greatest("complete", start).alias("upto"), status.alias("status"))


def mirror_totals(plan: DataFrame) -> DataFrame:
    """SC16-SC17."""
    n = lambda s: F.count_if(F.col("status") == s).cast("long").alias(s)
    return plan.agg(F.count("*").cast("long").alias("scanned"), n("appended"), n("truncated"), n("empty"), F.coalesce(F.sum(F.col("upto") - F.col("from_")), F.lit(0)).cast("long").alias("bytes"))


def is_excluded(path: str = "rel_path", prefixes: tuple[str, ...] = ()) -> Column:
    """SC19."""
    hit = [(F.col(path) == p) | F.col(path).startswith(p.rstrip("/") + "/") for p in prefixes]
    out = F.contains(F.col(path), F.lit("sync-conflict"))
    for h in hit:
        out = out | h
    return out


def history_tail(lines: DataFrame, n: int, source: str = "claude-code") -> DataFrame:
    """SC26-SC27: the last n texts of a history (line order): line, text."""
    e = event()
    if source == "codex":
        t = F.when(_is(e, "$.text", "STRING"), X.collapse(_get(e, "$.text")))
        t = F.when(t != "", F.concat(F.lit("[codex] "), F.when(F.length(t) > TAIL_CHARS, F.concat(F.left(t, F.lit(TAIL_CHARS)), F.lit("…"))).otherwise(t)))
    else:
        project = F.coalesce(_get(e, "$.project"), F.lit(""))
        shown = F.when(_is(e, "$.display", "STRING"), F.nullif(_get(e, "$.display"), F.lit("")))
        t = F.concat(F.lit("["), F.when(project == "", F.lit("?")).otherwise(F.right(project, F.lit(PROJECT_CHARS))), F.lit("] "), shown)
    return lines.select("line", t.alias("text")).where("text IS NOT NULL").orderBy(F.desc("line")).limit(n).orderBy("line")


def session_tail(lines: DataFrame, files: DataFrame, n: int, markers: tuple[str, ...] = ("# AGENTS.md", "<INSTRUCTIONS>", "<environment_context>")) -> DataFrame:
    """SC28: user messages of the newest files: rank, text; n in all, newest file first, then line order."""
    e = event()
    newest = files.orderBy(F.desc("mtime_us"), "ref").limit(TAIL_FILES)
    newest = newest.select("ref", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mtime_us"), "ref")).alias("file_rank"))
    text = X.collapse(_blocks(e, "$.payload.content", False))
    said = (_get(e, "$.type") == "response_item") & (_get(e, "$.payload.type") == "message") & (_get(e, "$.payload.role") == "user")
    rows = lines.where(said).select("ref", "line", text.alias("text")).join(F.broadcast(newest), "ref")
    own = ~F.coalesce(*[F.when(F.col("text").startswith(m), F.lit(True)) for m in markers], F.lit(False)) & (F.col("text") != "")
    cut = F.when(F.length("text") > TAIL_CHARS, F.concat(F.left("text", F.lit(TAIL_CHARS)), F.lit("…"))).otherwise(F.col("text"))
    top = rows.where(own).orderBy("file_rank", "line").limit(n)
    return top.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("file_rank", "line")).alias("rank"), F.concat(F.lit("[codex-session] "), cut).alias("text"))


def ingest_files(files: DataFrame, allowed: tuple[str, ...] = ("md", "markdown", "txt")) -> DataFrame:
    """SC29: files (path, content) with sha, text and status: taken, unsupported or empty."""
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    text = F.col("content").cast("string")
    status = F.when(~kind.isin(*allowed), F.lit("unsupported")).when(X.collapse(text) == "", F.lit("empty")).otherwise(F.lit("taken"))
    return files.select("path", X.file_hash("content").alias("sha"), status.alias("status"), F.when(status == "taken", text).alias("text"))


# -- compaction


def kept_lines(lines: DataFrame, source: str) -> DataFrame:
    """FP5-FP6: lines with keep."""
    e = event()
    obj = e.isNotNull()
    if source == "codex":
        kind, inner = _get(e, "$.type"), _get(e, "$.payload.type")
        keep = (kind == "session_meta") | ((kind == "event_msg") & (inner == "user_message")) | ((kind == "response_item") & (inner == "message") & _get(e, "$.payload.role").isin(*ROLES))
        return lines.withColumn("keep", F.coalesce(obj & keep, F.lit(False)))
    # the first line of a file with a working folder, if it is one of its first thirty: a minimum, no running window
    cwd = lines.withColumn("e", e).where(F.try_variant_get("e", "$.cwd", "variant").isNotNull()).groupBy("ref").agg(F.min("line").alias("__cwd"))
    out = lines.join(cwd, "ref", "left")
    first = (F.col("line") == F.col("__cwd")) & (F.col("line") < CWD_LINES)
    return out.withColumn("keep", F.coalesce(obj & ((chat_text(e) != "") | first), F.lit(False))).drop("__cwd")


def compacted(lines: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """SC30: what stays (ref, line, raw) and the sidecar (the same columns; ``line`` is its place)."""
    marked = kept_lines(lines, source)
    return marked.where("keep").drop("keep"), marked.where("NOT keep").drop("keep")


def rehydrated(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """Kept (ref, pos: the order of what stays, raw) and dropped (ref, line, raw) to ref, line, raw.

    Dropped lines have their places. A kept line's place is its order plus the dropped lines before it: with the i-th
    dropped line (from 0) at ``line``, line - i kept ones stand before it. Ranges of kept lines are thus found by an
    ordered merge: one sort for each file, nothing is collected.
    """
    d = dropped.withColumn("i", F.row_number().over(Window.partitionBy("ref").orderBy("line")) - 1)
    marks = d.select("ref", (F.col("line") - F.col("i")).alias("at"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("raw"))
    keep = kept.select("ref", F.col("pos").alias("at"), F.lit(1).alias("side"), F.col("raw").cast("string").alias("raw"))
    w = Window.partitionBy("ref").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.unionByName(keep).withColumn("n", F.count_if(F.col("side") == 0).over(w)).where("side = 1")
    return placed.select("ref", (F.col("at") + F.col("n")).alias("line"), "raw").unionByName(d.select("ref", F.col("line").cast("long").alias("line"), F.col("raw").cast("string").alias("raw")))


def rehydrated_files(kept: DataFrame, dropped: DataFrame, headers: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """The lines of files whose sidecar header (ref, source, header_ref) names this source and file, and each file's status."""
    ok = (F.col("source") == source) & (F.col("header_ref") == F.col("ref"))
    status = headers.select("ref", F.when(ok, F.lit("rehydrated")).otherwise(F.lit("header_mismatch")).alias("status"))
    good = status.where("status = 'rehydrated'").select("ref")
    return rehydrated(kept.join(good, "ref", "left_semi"), dropped.join(good, "ref", "left_semi")), status


def compaction_targets(files: DataFrame, source: str) -> DataFrame:
    """JSON-lines files (path) below the source's folder, but for histories and indexes."""
    root = {"claude-code": "projects/", "codex": "sessions/"}[source]
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.col("path").startswith(root) & F.col("path").endswith(".jsonl") & ~name.isin("history.jsonl", "session_index.jsonl"))


def compaction_status(files: DataFrame) -> DataFrame:
    """Files (ref, mtime_us, size, offset, watermark_us, sidecar) to status: may a file be compacted?"""
    s = (
        F.when(F.coalesce("sidecar", F.lit(False)), F.lit("already_compacted"))
        .when(F.col("watermark_us").isNull() | (F.col("mtime_us") > F.col("watermark_us")), F.lit("not_ingested"))
        .when(F.col("offset").isNotNull() & (F.col("offset") != F.col("size")), F.lit("offset_mismatch"))
        .otherwise(F.lit("eligible"))
    )
    return files.withColumn("status", s)


def compaction_totals(rows: DataFrame) -> DataFrame:
    """A21."""
    return rows.groupBy("status").agg(F.count("*").cast("long").alias("files"), F.coalesce(F.sum("reclaimable"), F.lit(0)).cast("long").alias("bytes"))

"""Roll-ups over entities and documents (A1-A2, A6-A8, A14, M5, W4-W5, FP7, Z38)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import vocabulary as V

# Sizes at which documents are sampled or left out; parts of a sample.
SMALL, SAMPLED = 40_000, 120_000
EDGE_CHARS, SIGNAL_CHARS, SAMPLE_CHARS = 6_000, 8_000, 20_000
# Words that make a line a signal, and the sample's headings.
SIGNALS = ("/Users/", "Documents/Git", "Traceback", "Error", "Exception", "Timeout", "failed", "failed:", "User:", "Assistant:", "cwd=", "workdir", "pytest", "ruff", "git ")
HEADINGS = ("# 원문 정보\n- 원문 문자 수: ", "\n- 처리 방식: 비용 제한 샘플. 전체 원문은 raw ref를 통해 보존됨.\n\n# 앞부분 샘플\n", "\n\n# 고신호 라인\n", "\n\n# 뒷부분 샘플\n")
NO_SIGNAL = "(추출된 고신호 라인 없음)"


def relation_metrics(entities: DataFrame, e: DataFrame) -> DataFrame:
    """A1-A2: one row of counts and ratios. An entity takes part by a relation of its own or to it (dangling ones count, TR5)."""
    typed = e.where("relation <> 'related'")
    part = typed.select(F.col("src_slug").alias("slug")).unionByName(typed.select(F.col("target").alias("slug"))).distinct().withColumn("typed", F.lit(1))
    loose = e.where("relation = 'related'").select(F.col("src_slug").alias("slug")).distinct().withColumn("loose", F.lit(1))
    rows = entities.select("slug").join(part, "slug", "left").join(loose, "slug", "left")
    n = F.count("*").cast("long")
    count = lambda c: F.count_if(c).cast("long")
    out = rows.agg(n.alias("entities"), count(F.col("typed").isNotNull()).alias("typed"), count(F.col("typed").isNull() & F.col("loose").isNotNull()).alias("related_only"), count(F.col("typed").isNull() & F.col("loose").isNull()).alias("orphans"))
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("entities")), F.lit(0.0))
    return out.withColumns({"coverage": ratio("typed"), "residual": ratio("related_only"), "orphan_ratio": ratio("orphans")})


def percent(c) -> Column:
    """Z38."""
    return F.format_string("%.1f%%", F.col(c) * 100)


def orphans(entities: DataFrame, e: DataFrame) -> DataFrame:
    """Entities without any link, own or inbound typed."""
    linked = e.select(F.col("src_slug").alias("slug")).unionByName(e.where("relation <> 'related'").select(F.col("target").alias("slug"))).distinct()
    return entities.join(linked, "slug", "left_anti")


def route(text="text", small: int = SMALL, sampled: int = SAMPLED, semantic: bool = True) -> Column:
    """FP7: struct(kind, calls, chars)."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    kind = F.when(n <= small, F.lit("small")).when(n <= sampled, F.lit("sampled")).otherwise(F.lit("oversize"))
    calls = F.when(n <= small, F.lit(2 if semantic else 1)).when(n <= sampled, F.lit(1)).otherwise(F.lit(0))
    return F.struct(kind.alias("kind"), calls.cast("long").alias("calls"), n.cast("long").alias("chars"))


def ingest_audit(docs: DataFrame, by: tuple[str, ...] = (), **limits) -> DataFrame:
    """Pending documents for each route, estimated calls, longest."""
    r = docs.select(*by, route(**limits).alias("r"))
    n = lambda k: F.count_if(F.col("r.kind") == k).cast("long").alias(k)
    return r.groupBy(*by).agg(F.count("*").cast("long").alias("pending"), n("small"), n("sampled"), n("oversize"), F.coalesce(F.sum("r.calls"), F.lit(0)).cast("long").alias("calls"), F.coalesce(F.max("r.chars"), F.lit(0)).cast("long").alias("max_chars"))


def signal_lines(text="text", most: int = SIGNAL_CHARS) -> Column:
    """Collapsed lines with a signal, up to the first that would overrun the budget (length + 1 each)."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), X.collapse)
    some = F.filter(lines, lambda s: (s != "") & F.exists(F.array(*[F.lit(p) for p in SIGNALS]), lambda p: F.contains(s, p)))
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("kept"))

    def step(acc, s):
        used = acc["used"] + F.length(s) + 1
        over = acc["over"] | (used > most)
        return F.struct(F.when(over, acc["used"]).otherwise(used).alias("used"), over.alias("over"), F.when(over, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(s))).alias("kept"))

    return F.aggregate(some, start, step, lambda acc: acc["kept"])


def sample_text(text="text", edge: int = EDGE_CHARS, signal: int = SIGNAL_CHARS, most: int = SAMPLE_CHARS) -> Column:
    """Head, signal lines and tail under headings, clipped."""
    t = F.coalesce(F.col(text), F.lit(""))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    block = F.array_join(signal_lines(text, signal), "\n")
    a, b, c, d = (F.lit(h) for h in HEADINGS)
    whole = F.concat(a, F.length(t).cast("string"), b, strip(F.left(t, F.lit(edge))), c, F.when(block == "", F.lit(NO_SIGNAL)).otherwise(block), d, strip(F.right(t, F.lit(edge))))
    return strip(F.left(whole, F.lit(most)))


def promotion_candidates(logs: DataFrame, least: int = 2) -> DataFrame:
    """Logs (slug, title, ord) that repeat a title: slug, title, decided_in, seen."""
    key = F.lower(F.trim("title"))
    g = logs.where(F.trim(F.coalesce("title", F.lit(""))) != "").groupBy(key.alias("key")).agg(F.count("*").cast("long").alias("seen"), F.min_by("title", "ord").alias("title"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "slug"))), lambda x: x["slug"]).alias("decided_in"))
    return g.where(F.col("seen") >= least).select(F.concat(F.lit("promoted-"), X.slugify("title")).alias("slug"), "title", "decided_in", "seen")


def kind_of(title="title", keywords=None, body="body") -> Column:
    """The kind with the most of its words in the text, the earlier of equals, null if none."""
    words = F.array_join(keywords, " ") if keywords is not None else F.lit("")
    t = F.lower(F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), words, F.coalesce(F.col(body), F.lit(""))))
    scores = {k: sum((t.contains(w).cast("int") for w in ws), F.lit(0)) for k, ws in V.KINDS.items()}
    best = F.greatest(*scores.values())
    return F.when(best > 0, F.coalesce(*[F.when(s == best, F.lit(k)) for k, s in scores.items()]))


def kind_updates(concepts: DataFrame) -> DataFrame:
    """M5: concepts without a kind that the words classify."""
    return concepts.where("type = 'concept' AND coalesce(attrs.kind, '') = ''").withColumn("kind", kind_of("title", F.col("attrs.keywords"), "body")).where("kind IS NOT NULL")


def dominant_tag(records: DataFrame, by: str, share: float = 0.3) -> DataFrame:
    """The most frequent tag of each group of records (by, ord, tags), if enough records have it; ties to the first seen."""
    n = records.groupBy(by).agg(F.count("*").alias("records"))
    tags = records.select(by, "ord", F.posexplode("tags").alias("pos", "tag")).groupBy(by, "tag").agg(F.count("*").alias("seen"), F.min(F.struct("ord", "pos")).alias("first"))
    top = tags.groupBy(by).agg(F.max_by(F.struct("tag", "seen"), F.struct("seen", F.struct((-F.col("first.ord")).alias("o"), (-F.col("first.pos")).alias("p")))).alias("t"))
    return n.join(top, by).where(F.col("t.seen") / F.col("records") >= share).select(by, F.col("t.tag").alias("tag"), F.col("t.seen").alias("seen"))


def backfill(batches: DataFrame) -> DataFrame:
    """Batches (batch, docs, pages, errors) in order up to the first in which all documents fail, as one row of sums."""
    last = batches.where((F.col("docs") > 0) & (F.col("errors") >= F.col("docs"))).agg(F.min("batch").alias("last"))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    upto = batches.join(F.broadcast(last)).where("last IS NULL OR batch <= last")  # one row
    return upto.agg(F.count("*").alias("batches"), s("docs"), s("pages"), s("errors"), F.coalesce(F.max(F.col("last").isNotNull()), F.lit(False)).alias("stopped"))

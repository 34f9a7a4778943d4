"""Secret scan over an incremental blob ledger; DataFrame functions only.

Every version of a text is a blob, addressed by its SHA-256. The ledger holds which blob has been scanned under which rule
version, and the spans found: one row for each span. A scan takes only unseen pairs of blob and rule version; findings are joined back
to every path (row) that holds the blob.

Texts stay where they are read: only ids and digests are shuffled, and of a blob with several rows all but one are dropped by a join with
the blobs that have several. A rule's regex runs once over a text without a match, twice over others (matches, and what lies
between them); places are running sums in a window over a blob's matches, so time grows with the text and its matches.

Spans are code points, end exclusive; per rule the matches are leftmost and do not overlap. A span names its rule by the place in the
tuple of rules, so new rules are added at its end.

Defined cases: a null text is the empty blob; a null id is a path like any other; repeated rows each
get the findings of their blob; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import checked_broadcast, fresh_path, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A match counts if the given group of it has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    # a run shorter than 24 would be dropped anyway, so only runs that are long enough are matched
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
#: What this scanner adds to the base rules.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
PIECE = "array<struct<gap:int,long:int,ok:boolean>>"


def blob_of(col: str = "text") -> Column:
    return F.unhex(F.sha2(text_or_empty(col), 256))


def pieces_of(text: Column, found: Column, rule: Rule) -> Column:
    """Per match of one rule: characters between it and the match before, its length, whether it counts. found: the matches."""
    # the pattern gives the same groups within a match alone, so only the matches are read for them
    size = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m)
    sizes = F.transform(found, lambda m: F.struct(F.length(m).alias("long"), (size(m) >= rule.least).alias("ok")))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))  # one more than the matches: the last has no match
    zipped = F.zip_with(gaps, sizes, lambda g, m: F.struct(F.length(g).alias("gap"), m["long"].alias("long"), m["ok"].alias("ok")))
    return F.when(F.size(found) > 0, zipped).otherwise(F.array().cast(PIECE))


def placed(runs: DataFrame) -> DataFrame:
    """blob, start, kind, end out of blob, kind, pieces: running sums over each blob's matches of a rule."""
    each = runs.where(F.size("pieces") > 0).select("blob", "kind", F.posexplode("pieces").alias("pos", "p"))
    upto = Window.partitionBy("blob", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("p.gap") + F.col("p.long")).cast("long")).over(upto)
    rows = each.select("blob", "kind", F.col("p.long").alias("long"), F.col("p.ok").alias("ok"), end.alias("end"))
    return rows.where("ok").select("blob", (F.col("end") - F.col("long")).alias("start"), "kind", "end")


class BlobLedger:
    """Runs in a shared folder: under ``scanned`` (blob, scanned: rule versions), under ``spans`` (blob, start, kind, end)."""

    def __init__(self, spark: SparkSession, path: str | None = None, runs: list[str] | None = None):
        self.spark, self.path, self.runs = spark, path or fresh_path(spark, "blobs"), list(runs or [])

    def _read(self, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{r}/{part}" for r in self.runs])

    def scanned(self) -> DataFrame | None:
        return self._read("scanned", "blob binary, scanned array<string>") if self.runs else None

    def spans(self) -> DataFrame:
        return self._read("spans", "blob binary, start long, kind int, end long")

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, paths: DataFrame | None = None) -> DataFrame:
        """Scan the unseen pairs of docs' blobs and the rules; returns what was scanned. paths: id, blob of docs, if known."""
        paths = paths if paths is not None else docs.select(F.col(id_col).alias("id"), blob_of(text_col).alias("blob"))
        blobs = paths.groupBy("blob").agg(F.count("*").alias("n"), F.min("id").alias("id"))
        keyed = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), blob_of(text_col).alias("blob"))
        run = f"{self.path}/run={len(self.runs):06d}"
        # of a blob with several rows the one with the smallest id is read; rows that repeat id and text too are dropped afterwards
        many = fresh_path(self.spark, "many")
        blobs.where("n > 1").select(F.col("blob").alias("b"), F.col("id").alias("i")).write.parquet(many)
        many = checked_broadcast(self.spark.read.parquet(many))
        texts = keyed.join(many, F.col("blob") == F.col("b"), "left").where("b IS NULL OR id <=> i").drop("b", "i", "id")
        keys = F.array(*[F.lit(r.key) for r in rules])
        if (seen := self.scanned()) is not None:
            seen = seen.select("blob", F.explode("scanned").alias("key")).groupBy("blob").agg(F.collect_set("key").alias("seen"))
            todo = blobs.select("blob").join(seen, "blob").withColumn("todo", F.array_except(keys, "seen"))
            known = fresh_path(self.spark, "known")
            todo.select(F.col("blob").alias("b"), "todo").write.parquet(known)
            texts = texts.join(checked_broadcast(self.spark.read.parquet(known)), F.col("blob") == F.col("b"), "left").drop("b").withColumn("todo", F.coalesce("todo", keys)).where(F.size("todo") > 0)
        else:
            texts = texts.withColumn("todo", keys)
        none = F.array().cast("array<string>")
        found = {f"m{k}": F.when(F.array_contains("todo", r.key), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(none) for k, r in enumerate(rules)}
        parts = F.array(*[F.struct(F.lit(k).alias("kind"), pieces_of(F.col("text"), F.col(f"m{k}"), r).alias("pieces")) for k, r in enumerate(rules)])
        hit = F.filter(parts, lambda p: F.size(p["pieces"]) > 0)
        texts.withColumns(found).select("blob", F.col("todo").alias("scanned"), hit.alias("hits")).write.parquet(f"{run}/raw")
        raw = self.spark.read.parquet(f"{run}/raw")
        if not many.isEmpty():  # rows that repeat id and text: one of each; only blobs with several rows are looked at
            one = raw.join(many, F.col("blob") == F.col("b"), "left_semi").groupBy("blob").agg(F.first("scanned").alias("scanned"), F.first("hits").alias("hits"))
            raw = raw.join(many, F.col("blob") == F.col("b"), "left_anti").unionByName(one)
        raw.select("blob", "scanned").write.parquet(f"{run}/scanned")
        placed(raw.select("blob", F.explode("hits").alias("h")).select("blob", "h.kind", "h.pieces")).write.parquet(f"{run}/spans")
        self.runs.append(run)
        return self.spark.read.parquet(f"{run}/scanned")

    def findings(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: DataFrame | None = None) -> DataFrame:
        """Each path with the spans of its blob: id_col, blob (binary), spans sorted by start, then rule."""
        paths = paths if paths is not None else docs.select(F.col(id_col).alias("id"), blob_of(text_col).alias("blob"))
        spans = self.spans().distinct().groupBy(F.col("blob").alias("b")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
        at = fresh_path(self.spark, "hits")
        spans.write.parquet(at)
        hits = checked_broadcast(self.spark.read.schema(f"b binary, spans {SPAN}").parquet(at), 50_000)
        return paths.join(hits, F.col("blob") == F.col("b"), "left").select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def as_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: BlobLedger | None = None) -> DataFrame:
    """Scan docs into the ledger (a new one if none is given) and return ``findings`` for them; ids and digests are written once for both."""
    spark = docs.sparkSession
    at = fresh_path(spark, "paths")
    docs.select(F.col(id_col).alias("id"), blob_of(text_col).alias("blob")).write.parquet(at)
    paths = spark.read.parquet(at)
    ledger = ledger or BlobLedger(spark)
    ledger.scan(docs, id_col, text_col, paths=paths)
    return ledger.findings(docs, id_col, text_col, paths=paths)

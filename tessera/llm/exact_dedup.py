"""Exact dedup over a log-structured merge index of text digests; DataFrame functions only.

Memtables: every write task sorts the digests of its rows and flushes files of at most ``MEMTABLE_ROWS`` rows. A batch's
files are merged into one run, which keeps per digest the smallest identifier and the row count, and has a filter:
a bitmap with ``BITS_PER_DIGEST`` bits a digest, of which each sets two. A new batch is probed against the filters of
the runs there are and reads only those in which some of its digests may be. ``FAN`` runs of a level are compacted into one of
the next, so a row is merged again once for each level. Hits (digests of more than one row) are read again and compared byte by byte.

Texts are equal if identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one space.

Defined cases: a null text counts as empty; null ids sort last, so such a row stays only where
its whole group has no id, and its keep_id is then null; of rows that repeat both id and text
exactly one stays; an empty table gives an empty result; further columns of the input are ignored
by ``decisions`` and returned untouched by ``keep_first``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checked_broadcast, fresh_path, text_or_empty

MEMTABLE_ROWS = 1_000_000
BITS_PER_DIGEST = 16
FAN = 4
SPACES = r"[\x20\x09-\x0D]+"


def normalised(col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(col), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _merge(first: Column, n: Column) -> list[Column]:
    return [F.min(first).alias("first"), F.sum(n).cast("long").alias("n")]


def _places(digest: str, bits: Column) -> Column:
    """The two bits of a digest in a bitmap of so many bits."""
    word = lambda at: F.conv(F.hex(F.substring(digest, at, 7)), 16, 10).cast("long")
    return F.array(F.pmod(F.coalesce(word(1), F.lit(0)), bits), F.pmod(F.coalesce(word(8), F.lit(0)), bits))


class DigestIndex:
    """The index: ``levels`` holds the paths of each level's runs; ``opened`` those that the last batch had to read."""

    def __init__(self, spark: SparkSession, path: str | None = None, digest=sha256):
        self.spark, self.path, self.digest = spark, path or fresh_path(spark, "digests"), digest
        self.levels: list[list[str]] = []
        self.opened: list[str] = []
        self.batches = self.made = 0

    def _run(self, rows: DataFrame) -> str:
        """Write a run, sorted by digest, and its filter."""
        at = f"{self.path}/run={self.made:06d}"
        self.made += 1
        rows.sortWithinPartitions("digest").write.option("maxRecordsPerFile", MEMTABLE_ROWS).parquet(f"{at}/digests")
        held = self.spark.read.parquet(f"{at}/digests")
        bits = max(64, held.count() * BITS_PER_DIGEST)
        place = held.select(F.explode(_places("digest", F.lit(bits))).alias("at"))
        slots = place.groupBy(F.expr("at div 64").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("word"))
        slots.withColumn("bits", F.lit(bits).cast("long")).write.parquet(f"{at}/filter")
        return at

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{r}/digests" for r in runs])

    def _probe(self, run: str) -> DataFrame | None:
        """What the index holds of a run's digests; opens only runs whose filter lets some of them pass."""
        runs = [r for level in self.levels for r in level]
        self.opened = []
        mine = self._read([run]).select("digest")
        for r in runs:
            slots = self.spark.read.parquet(f"{r}/filter")
            bits = slots.select(F.max("bits")).first()[0]
            if bits is None:
                continue
            asked = mine.select("digest", F.explode(_places("digest", F.lit(bits))).alias("at"))
            met = asked.withColumn("slot", F.expr("at div 64")).join(slots, "slot").where("word & shiftleft(1L, cast(at % 64 as int)) <> 0")
            may = met.groupBy("digest").agg(F.count("*").alias("set")).where("set = 2").select("digest")
            if not may.isEmpty():
                self.opened.append(r)
        return self._read(self.opened).join(mine, "digest", "left_semi") if self.opened else None

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """Take a batch in. Gives its rows (id, batch, row: unique in the batch, digest) and, of their digests, first (the row that
        stays, of this batch and all before) and n."""
        at = f"{self.path}/batch={self.batches:06d}"
        rows = docs.select(F.col(id_col).alias("id"), F.lit(self.batches).alias("batch"), F.monotonically_increasing_id().alias("row"), self.digest(normalised(text_col)).alias("digest"))
        # memtables: sorted files, one or more of each task
        rows.sortWithinPartitions("digest").write.option("maxRecordsPerFile", MEMTABLE_ROWS).parquet(at)
        self.batches += 1
        rows = self.spark.read.parquet(at)
        first = F.struct(F.col("id").isNull().alias("no_id"), "id", "batch", "row")
        run = self._run(rows.groupBy("digest").agg(*_merge(first, F.lit(1))))  # partial merges run before the shuffle
        known, own = self._probe(run), self._read([run])
        if known is not None:
            own = own.unionByName(known).groupBy("digest").agg(*_merge(F.col("first"), F.col("n")))
        self._add(0, run)
        return rows, own

    def _add(self, level: int, run: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FAN:
            merged = self._run(self._read(self.levels[level]).groupBy("digest").agg(*_merge(F.col("first"), F.col("n"))))
            self.levels[level] = []
            self._add(level + 1, merged)

    def state(self) -> DataFrame | None:
        """digest, first, n over all batches; None before the first."""
        runs = [r for level in self.levels for r in level]
        return self._read(runs).groupBy("digest").agg(*_merge(F.col("first"), F.col("n"))) if runs else None


def collisions(docs: DataFrame, hits: DataFrame, digest, text_col: str) -> DataFrame:
    """Byte verification: the digests under which different texts met, from every row of every hit."""
    return (
        docs.select(normalised(text_col).alias("norm")).withColumn("digest", digest(F.col("norm")))
        .join(hits.select("digest"), "digest", "left_semi")
        .groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
        .where("least <> most").select("digest")
    )


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, index: DigestIndex | None = None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, digest (binary, of the normalised text).

    With an index that holds former batches, groups reach over all of them; texts are verified within the batch, so
    its digest should then be one without collisions, as SHA-256 is.
    """
    index = index or DigestIndex(docs.sparkSession, digest=digest)
    digest = index.digest
    rows, firsts = index.ingest(docs, id_col, text_col)
    at = fresh_path(docs.sparkSession, "hits")
    firsts.where("n > 1").write.parquet(at)
    hits = checked_broadcast(docs.sparkSession.read.parquet(at))
    out = (
        rows.join(hits, "digest", "left")
        .select(
            F.col("id").alias(id_col), F.when(F.col("n") > 1, F.col("first.id")).otherwise(F.col("id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (F.col("first").isNull() | ((F.col("first.batch") == F.col("batch")) & (F.col("first.row") == F.col("row")))).alias("kept"),
            "digest",
        )
    )
    bad = collisions(docs, hits, digest, text_col)
    at = fresh_path(docs.sparkSession, "collisions")
    bad.write.parquet(at)
    bad = docs.sparkSession.read.parquet(at)
    if bad.isEmpty():
        return out
    # different texts under one digest: those groups are formed by the texts themselves
    apart = (
        docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")).withColumn("digest", digest(F.col("norm")))
        .join(bad, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id())
    )
    at = fresh_path(docs.sparkSession, "apart")
    apart.write.parquet(at)
    apart = docs.sparkSession.read.parquet(at)
    first = apart.groupBy("digest", "norm").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"), F.count("*").alias("n")
    )
    apart = apart.join(first, ["digest", "norm"]).select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("first.row") == F.col("row")).alias("kept"), "digest",
    )
    return out.join(bad, "digest", "left_anti").select(out.columns).unionByName(apart)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Only ids and digests move; texts stay where they were read."""
    spark = docs.sparkSession
    at = fresh_path(spark, "decided")
    decisions(docs, id_col, text_col).where("group_size > 1").write.parquet(at)
    groups = spark.read.parquet(at)
    gone = groups.where("NOT kept").select(F.col(id_col).alias("__id"), F.col("digest").alias("__digest"))
    twice = groups.where(F.col(id_col).eqNullSafe(F.col("keep_id"))).groupBy(F.col(id_col).alias("__id"), F.col("digest").alias("__digest")).count().where("count > 1")
    keyed = docs.withColumn("__digest", sha256(normalised(text_col)))
    same = lambda side: keyed[id_col].eqNullSafe(side["__id"]) & (keyed["__digest"] == side["__digest"])
    rest = gone.join(twice, (gone["__id"].eqNullSafe(twice["__id"])) & (gone["__digest"] == twice["__digest"]), "left_anti").distinct()
    kept = keyed.join(checked_broadcast(rest), same(rest), "left_anti")
    if twice.isEmpty():
        return kept.select(docs.columns)
    # rows that repeat id and text: one of each
    dup = twice.drop("count")
    return (
        kept.join(dup, same(dup), "left_anti").select(docs.columns)
        .unionByName(kept.join(dup, same(dup), "left_semi").dropDuplicates([id_col, "__digest"]).select(docs.columns))
    )

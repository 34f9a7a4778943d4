"""Ordered merges of page operations (M1-M2, M13-M14), keyed upserts (M9-M12), snapshots (J8, Z30), plans (D7-D8, ST9-ST10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import vocabulary as V

ARRAYS = ("sources", "related", *V.RELATIONS)


def apply_ops(entities: DataFrame, ops: DataFrame, stamp: str) -> DataFrame:
    """M1-M2: ops (op_ord, op: create or update, the entity's columns) in order upon entities.

    Per page only what follows its last ``create`` counts; before that nothing is left, with a create in between the stored
    page neither. Scalars are the last operation's; created and observed_at are the first there is; lists are
    ordered unions. An update of a page that isn't there creates it.
    """
    key = ["type", "slug"]
    last_create = ops.groupBy(*key).agg(F.max(F.when(F.col("op") == "create", F.col("op_ord"))).alias("__from"))
    live = ops.join(last_create, key).where(F.col("__from").isNull() | (F.col("op_ord") >= F.col("__from")))
    base = entities.join(last_create.where("__from IS NULL"), key, "left_semi").withColumns({"op_ord": F.lit(-1).cast("long"), "op": F.lit("stored")})
    cols = entities.columns
    rows = base.select(*cols, F.col("op_ord").cast("long"), "op").unionByName(live.select(*cols, F.col("op_ord").cast("long"), "op"))
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    first = lambda c: F.min_by(c, F.when(blank(c).isNotNull(), F.col("op_ord")))
    union = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("op_ord", F.coalesce(c, F.array().cast("array<string>")).alias("v")))), lambda x: x["v"])))
    aggs = []
    for c in cols:
        if c in key:
            continue
        if c in ARRAYS:
            aggs.append(union(c).alias(c))
        elif c in ("created", "observed_at"):
            aggs.append(F.coalesce(first(c), F.lit("")).alias(c))
        elif c == "updated":
            aggs.append(F.lit(stamp).alias(c))
        elif c == "attrs" and dict(entities.dtypes)[c].startswith("map"):
            entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("op_ord", F.map_entries(c).alias("v")))), lambda x: x["v"]))
            aggs.append(F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, kv: F.map_concat(F.map_filter(m, lambda k, _: k != kv["key"]), F.map_from_entries(F.array(kv)))).alias(c))
        else:
            aggs.append(F.max_by(c, "op_ord").alias(c))
    done = rows.groupBy(*key).agg(*aggs).withColumn("created", F.coalesce(blank("created"), F.lit(stamp)))
    done = done.withColumn("observed_at", F.when(F.col("type").isin(*V.OCCURRENTS), F.coalesce(blank("observed_at"), "created")).otherwise(F.lit("")))
    return entities.join(ops.select(*key).distinct(), key, "left_anti").select(cols).unionByName(done.select(cols))


def stamp_sources(ops: DataFrame, ref: str) -> DataFrame:
    """M13."""
    return ops.withColumn("sources", F.array_distinct(F.concat(F.coalesce("sources", F.array().cast("array<string>")), F.array(F.lit(ref)))))


def parse_ops(payload: DataFrame, json_col: str = "payload") -> DataFrame:
    """op_ord, op and the page's fields out of JSON lists; bad rows go; related of continuants is emptied with a warning."""
    fields = "op string, type string, slug string, title string, status string, body string, " + ", ".join(f"{a} array<string>" for a in ARRAYS)
    each = payload.select(F.posexplode(F.from_json(json_col, f"array<struct<{fields}>>")).alias("op_ord", "o")).select("op_ord", "o.*")
    each = each.where(F.col("op").isin("create", "update") & F.col("type").isin(*V.TYPES) & (F.coalesce("slug", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    loose = F.col("type").isin(*V.CONTINUANTS) & (F.size(F.coalesce("related", F.array().cast("array<string>"))) > 0)
    return each.withColumn("warning", F.when(loose, F.lit("related dropped"))).withColumn("related", F.when(loose, F.array().cast("array<string>")).otherwise(F.col("related")))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace those of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def count_failures(old: DataFrame, failed: DataFrame, cleared: DataFrame, dead: int = 2) -> DataFrame:
    """M12, ST3: ref, n, dead: one more for each failure; cleared references go."""
    n = failed.groupBy("ref").agg(F.count("*").alias("more"))
    out = old.join(cleared.select("ref").distinct(), "ref", "left_anti").join(n, "ref", "full").select("ref", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("n"))
    return out.withColumn("dead", F.col("n") >= dead)


def snapshot_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """rel_path, change: new, unchanged (same time and size), touched (same content), changed; deleted files aren't listed."""
    n, b = now.alias("n"), before.alias("b")
    same = (F.col("n.mtime") == F.col("b.mtime")) & (F.col("n.size") == F.col("b.size"))
    change = F.when(F.col("b.rel_path").isNull(), F.lit("new")).when(same, F.lit("unchanged")).when(F.col("n.sha") == F.col("b.sha"), F.lit("touched")).otherwise(F.lit("changed"))
    return n.join(b, F.col("n.rel_path") == F.col("b.rel_path"), "left").select("n.rel_path", change.alias("change"))


def mirror_next(now: DataFrame, before: DataFrame, since: float | None = None) -> DataFrame:
    """SC18, Z30: the mirror's next state: rel_path, mtime, size, sha, status, one row for each file that is there now.

    Tiers: a file older than ``since`` keeps its former state (nulls if it had none: not tracked); equal time and size are unchanged; equal content takes the
    new time (touched); anything else is copied (new or changed). Files that are gone leave the state, but no copy of them is deleted.
    """
    n, b = now.alias("n"), before.alias("b")
    had = F.col("b.rel_path").isNotNull()
    same = (F.col("n.mtime") == F.col("b.mtime")) & (F.col("n.size") == F.col("b.size"))
    old = F.lit(False) if since is None else F.col("n.mtime") < F.lit(since)
    status = F.when(old, F.lit("skipped")).when(~had, F.lit("new")).when(same, F.lit("unchanged")).when(F.col("n.sha") == F.col("b.sha"), F.lit("touched")).otherwise(F.lit("changed"))
    out = n.join(b, F.col("n.rel_path") == F.col("b.rel_path"), "left").withColumn("status", status)
    kept = F.col("status").isin("skipped", "unchanged")
    return out.select("n.rel_path", *(F.when(kept, F.col(f"b.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in ("mtime", "size", "sha")), "status")


def mirror_state(step: DataFrame) -> DataFrame:
    """What ``mirror_next`` hands to the next run."""
    return step.where("sha IS NOT NULL").select("rel_path", "mtime", "size", "sha")


def mirror_counts(step: DataFrame) -> DataFrame:
    """SC18: files scanned, copied, unchanged, skipped, and bytes copied."""
    copied, same = F.col("status").isin("new", "changed"), F.col("status").isin("unchanged", "touched")
    counts = {"scanned": F.lit(True), "mirrored": copied, "unchanged": same, "skipped": F.col("status") == "skipped"}
    return step.agg(*(F.count_if(c).cast("long").alias(k) for k, c in counts.items()), F.coalesce(F.sum(F.when(copied, F.col("size"))), F.lit(0)).cast("long").alias("bytes"))


def fold_about(entities: DataFrame) -> DataFrame:
    """``about`` folded into ``related``."""
    return entities.withColumn("related", F.array_distinct(F.concat(F.coalesce("related", F.array().cast("array<string>")), F.coalesce("about", F.array().cast("array<string>"))))).drop("about")


def migration_plan(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Flat files (name) with a date to folders of year and month: name, target, status."""
    d = F.try_to_date(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    plan = files.select("name", F.when(d.isNotNull(), F.concat(F.date_format(d, "yyyy/MM/"), "name")).alias("target"))
    there = existing.select(F.col("path").alias("target"), F.lit(True).alias("__there")).distinct()
    return plan.join(there, "target", "left").select("name", "target", F.when(F.col("target").isNull(), F.lit("skipped")).when(F.col("__there"), F.lit("conflict")).otherwise(F.lit("move")).alias("status"))


def blocking(stages: DataFrame, results: DataFrame) -> DataFrame:
    """ST10: stage, blocked_by: the first (by pos) of its dependencies that is missing, failed, or skipped but not on resume.

    stages: stage, pos, needs; results: stage, status, reason.
    """
    r = results.select(F.col("stage").alias("needs"), "status", "reason")
    bad = F.col("status").isNull() | (F.col("status") == "failed") | ((F.col("status") == "skipped") & ~F.coalesce(F.col("reason") == "resume", F.lit(False)))
    return stages.join(r, "needs", "left").groupBy("stage").agg(F.min_by(F.when(bad, F.col("needs")), F.when(bad, F.col("pos"))).alias("blocked_by"))


def fill_forward(lines: DataFrame, by: str, pos: str, level: str) -> DataFrame:
    """SC31-SC33: adds heading, the last line before (or at) a row that begins with so many #."""
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(F.when(F.col("line").rlike(f"^{level}\\s+\\S"), F.regexp_extract("line", f"^{level}\\s+(.+?)\\s*$", 1)), ignorenulls=True).over(w))

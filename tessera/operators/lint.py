"""Constraint checks and cleanup scans as rows of violations or candidates (A15-A17, FP15-FP17, J6, L1-L15, M18, Z33-Z34)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators import vocabulary as V

REQUIRED = ("type", "slug", "title", "status")
# Days after which files are stale; files and folders that are never touched.
STALE = {"inbox": 30, "project": 90, "resume": 90, "memory_inbox": 60, "report": 90}
PROTECTED_FILES, PROTECTED_DIRS = ("90_System/AI/Profile.md", "90_System/AI/DecisionPatterns.md"), ("Profile", "90_System/AI/Recipes")


def none(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def _rows(df: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """A row for each check that fails: code, path, message."""
    found = F.filter(F.array(*[F.when(bad, F.struct(F.lit(code).alias("code"), text.alias("message"))) for code, bad, text in checks]), lambda x: x.isNotNull())
    return df.select("path", F.explode(found).alias("v")).select("v.code", "path", "v.message")


def page_rules(pages: DataFrame) -> DataFrame:
    """L2-L3: pages have path, type, slug, title, status; a type that isn't known ends a page's checks."""
    known = F.col("type").isin(*V.TYPES)
    statuses = F.coalesce(*[F.when(F.col("type") == t, F.array(*[F.lit(s) for s in x[2]])) for t, x in V.TYPES.items()])
    folder = F.coalesce(*[F.when(F.col("type") == t, F.lit(x[0] + "/")) for t, x in V.TYPES.items()])
    below = F.size(F.split(F.substring("path", F.length(folder) + 1, F.lit(10_000)), "/"))
    dated = F.col("type").isin(*[t for t, x in V.TYPES.items() if x[1]])
    placed = F.coalesce(F.col("path").startswith(folder) & F.when(dated, below >= 3).otherwise(below == 1), F.lit(False))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    show = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(c, F.lit("")))
    return _rows(pages, [
        *[("missing_required", none(f), F.lit(f)) for f in REQUIRED],
        ("invalid_type", ~F.coalesce(known, F.lit(False)), show("type")),
        ("invalid_enum", known & ~none("status") & ~F.array_contains(statuses, F.col("status")), show("status")),
        ("slug_filename_mismatch", known & ~none("slug") & (stem != F.col("slug")), show("slug")),
        ("type_folder_mismatch", known & ~placed, show("type")),
    ])


def field_rules(pages: DataFrame) -> DataFrame:
    """L4: enumerated fields and required fields of nested objects; strings and numbers aren't checked (TR19)."""
    enums = [("invalid_enum", (F.col("type") == t) & F.col(f"attrs.{f}").isNotNull() & ~F.col(f"attrs.{f}").isin(*vs), F.concat(F.lit(f"{f}="), F.col(f"attrs.{f}"))) for (t, f), vs in V.ENUMS.items()]
    out = _rows(pages, enums)
    for (t, f), need in V.NESTED_REQUIRED.items():
        each = pages.where(F.col("type") == t).select("path", F.posexplode(f"attrs.{f}").alias("i", "x"))
        out = out.unionByName(each.where(none(F.col(f"x.{need}"))).select(F.lit("missing_required").alias("code"), "path", F.concat(F.lit(f"{f}["), "i", F.lit(f"].{need}")).alias("message")))
    return out


def checks(value: Column, path: Column, spec: dict) -> Column:
    """A value's violations as an array of (code, message), by the schema's tree: lists and objects of any depth, places as ``f[0].x``.

    spec: type (enum with values, list with items, object with fields; others aren't checked); a field may be required.
    """
    none_ = F.array().cast("array<struct<code:string,message:string>>")
    row = lambda code, text: F.array(F.struct(F.lit(code).alias("code"), text.alias("message")))
    kind = spec.get("type")
    if kind == "enum":
        found = F.when(~value.isin(*spec.get("values", ())), row("invalid_enum", F.concat(path, F.lit("="), value.cast("string"))))
    elif kind == "list" and isinstance(spec.get("items"), dict):
        found = F.flatten(F.transform(value, lambda x, i: checks(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), spec["items"])))
    elif kind == "object" and spec.get("fields"):
        found = F.concat(*(field_checks(value[f], F.concat(path, F.lit(f".{f}")), s) for f, s in spec["fields"].items()))
    else:
        return none_
    return F.coalesce(F.when(value.isNotNull(), found), none_)


def field_checks(value: Column, path: Column, spec: dict) -> Column:
    """``checks`` of a field, which may be missing: null, an empty text or an empty list."""
    found = checks(value, path, spec)
    if not spec.get("required"):
        return found
    empty = F.size(value) == 0 if spec.get("type") == "list" else F.lit(False) if spec.get("type") == "object" else value.cast("string") == ""
    missing = F.array(F.struct(F.lit("missing_required").alias("code"), path.alias("message")))
    return F.concat(F.when(value.isNull() | F.coalesce(empty, F.lit(False)), missing).otherwise(F.array().cast("array<struct<code:string,message:string>>")), found)


def schema_rules(pages: DataFrame, schemas: dict[str, dict[str, dict]], attrs: str = "attrs") -> DataFrame:
    """L4: code, path, message of all fields that break their type's schema. pages: path, type, attrs (a struct); schemas: type to field to spec."""
    each = [F.when(F.col("type") == t, F.concat(*(field_checks(F.col(f"{attrs}.{f}"), F.lit(f), s) for f, s in fields.items()))) for t, fields in schemas.items() if fields]
    if not each:
        return pages.select(F.lit("").alias("code"), "path", F.lit("").alias("message")).where("false")
    return pages.select("path", F.explode(F.coalesce(*each)).alias("v")).select("v.code", "path", "v.message")


def relation_rules(e: DataFrame, pages: DataFrame) -> DataFrame:
    """src_slug, relation, target, code of edges that break a rule. Targets may name a type."""
    types = pages.groupBy("slug").agg(F.array_sort(F.collect_set("type")).alias("types"))  # at most one of each type
    rows = e.where(F.col("relation") != "related").withColumn("named", F.when(F.col("target").contains(":"), F.split_part("target", F.lit(":"), F.lit(1)))).withColumn("slug", F.regexp_replace("target", "^[^:]*:", ""))
    rows = rows.join(types, "slug", "left")
    allowed = lambda side: F.coalesce(*[F.when(F.col("relation") == r, F.array(*[F.lit(t) for t in x[side] or V.TYPES])) for r, x in V.RELATIONS.items()])
    kind = F.coalesce("named", F.col("types")[0])
    range_code = (
        F.when(F.col("types").isNull(), F.lit("relation_target_missing"))
        .when(F.col("named").isNotNull() & ~F.array_contains("types", F.col("named")), F.lit("relation_target_missing"))
        .when(F.col("named").isNull() & (F.size("types") > 1), F.lit("relation_target_ambiguous"))
        .when(~F.array_contains(allowed(1), kind), F.lit("relation_range"))
    )
    targets = rows.withColumn("code", range_code).where("code IS NOT NULL").select("src_slug", "relation", "target", "code")
    domain = rows.where(~F.array_contains(allowed(0), F.col("src_type"))).select("src_slug", "relation", F.lit("").alias("target"), F.lit("relation_domain").alias("code")).distinct()
    return targets.unionByName(domain)


def residual(entities: DataFrame) -> DataFrame:
    """Continuants with related but no typed relation."""
    typed = sum((F.size(F.coalesce(F.col(r), F.array().cast("array<string>"))) for r in V.RELATIONS), F.lit(0))
    return entities.where(F.col("type").isin(*V.CONTINUANTS) & (F.size(F.coalesce("related", F.array().cast("array<string>"))) > 0) & (typed == 0))


def index_stale(declared: DataFrame, pages: DataFrame) -> DataFrame:
    """Declared (total) against the count of pages; a row if they differ."""
    return declared.limit(1).join(pages.agg(F.count("*").cast("long").alias("found"))).where("total <> found").select(F.lit("index_stale").alias("code"), "total", "found")


def parse_faults(pages: DataFrame) -> DataFrame:
    """L1: pages (path, meta) whose front matter is missing or no mapping."""
    return pages.where(F.col("meta").isNull()).select(F.lit("frontmatter_parse").alias("code"), "path", F.lit("no front matter").alias("message"))


def all_rules(entities: DataFrame, e: DataFrame, faults: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """L1: code, path, message of every rule over entities with paths; faults: pages (path, meta) that can't be read; declared: total."""
    where = entities.select(F.col("slug").alias("src_slug"), "path")
    rel = relation_rules(e, entities).join(where, "src_slug").select("code", "path", F.concat_ws(" ", "relation", "target").alias("message"))
    loose = residual(entities).select(F.lit("legacy_related_residual").alias("code"), "path", F.lit("related only").alias("message"))
    out = page_rules(entities).unionByName(field_rules(entities)).unionByName(rel).unionByName(loose)
    files = entities.select("path")
    if faults is not None:
        out = parse_faults(faults).unionByName(out)
        files = files.unionByName(faults.where("meta IS NULL").select("path"))
    if declared is not None:
        stale_ = index_stale(declared, files)
        out = out.unionByName(stale_.select("code", F.lit("").alias("path"), F.concat(F.lit("total="), "total", F.lit(" found="), "found").alias("message")))
    return out


def full_lint(entities: DataFrame, faults: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """Dead links go first (M4), then every rule. entities need load_ord and path."""
    fixed = G.without_dead_links(entities, entities)
    return all_rules(fixed, G.edges(fixed), faults, declared)


# -- cleanup. files: path, folder, kind (inbox, project, resume, memory_inbox, report, card), age_days, size_bytes, pinned, cleanup


def protected(path: str = "path") -> Column:
    """FP15."""
    return F.col(path).isin(*PROTECTED_FILES) | F.coalesce(*[F.when(F.col(path).startswith(d + "/"), F.lit(True)) for d in PROTECTED_DIRS], F.lit(False))


def skipped() -> Column:
    """FP16."""
    return F.coalesce("pinned", F.lit(False)) | (F.lower(F.coalesce("cleanup", F.lit(""))) == "skip")


def empty_card() -> Column:
    """FP17: a draft or unstated card without positions, keywords, stack, metrics and domains."""
    size = lambda f: F.coalesce(F.size(F.col(f"attrs.{f}")), F.lit(0))
    return F.lower(F.coalesce("status", F.lit(""))).isin("draft", "") & (sum((F.greatest(size(f), F.lit(0)) for f in ("positions", "keywords", "stack", "metrics", "domains")), F.lit(0)) == 0)


def dormant(files: DataFrame, days: int = STALE["project"], by_newest: bool = False) -> DataFrame:
    """Folders whose oldest file (newest with by_newest, TR4) is so old; any skip mark spares the folder."""
    age = F.min("age_days") if by_newest else F.max("age_days")
    g = files.where("kind = 'project'").groupBy("folder").agg(age.cast("long").alias("age_days"), F.sum("size_bytes").cast("long").alias("size_bytes"), F.bool_or(skipped()).alias("skip"))
    return g.where(~F.col("skip") & (F.col("age_days") >= days)).select(F.lit("dormant_project").alias("kind"), F.col("folder").alias("path"), "age_days", "size_bytes")


def stale(files: DataFrame) -> DataFrame:
    """Stale single files; reports know no skip mark."""
    limits = F.coalesce(*[F.when(F.col("kind") == k, F.lit(d)) for k, d in STALE.items() if k != "project"])
    keep = (F.col("kind") == "report") | ~skipped()
    return files.where(limits.isNotNull() & (F.col("age_days") >= limits) & keep).select(F.concat("kind", F.lit("_stale")).alias("kind"), "path", F.col("age_days").cast("long").alias("age_days"), F.col("size_bytes").cast("long").alias("size_bytes"))


def empty_folders(folders: DataFrame, entries: DataFrame) -> DataFrame:
    """Folders (path) that hold nothing (entries: parent) and aren't protected."""
    return folders.where(~protected()).join(entries.select(F.col("parent").alias("path")).distinct(), "path", "left_anti")


def scan_all(files: DataFrame, cards: DataFrame | None = None, folders: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """Kind, path, age_days, size_bytes of all seven scans; cards (path, status, attrs, size_bytes, pinned, cleanup) and
    folders with their entries are scanned where they are given."""
    out = stale(files).unionByName(dormant(files))
    age = F.lit(None).cast("long").alias("age_days")
    if cards is not None:
        out = out.unionByName(cards.where(empty_card() & ~skipped()).select(F.lit("empty_card").alias("kind"), "path", age, F.col("size_bytes").cast("long").alias("size_bytes")))
    if folders is not None:
        out = out.unionByName(empty_folders(folders, entries).select(F.lit("empty_folder").alias("kind"), "path", age, F.lit(0).cast("long").alias("size_bytes")))
    return out


def archive_path(day: str, root: str = "99_Archive") -> Column:
    """Z33."""
    return F.concat(F.lit(f"{root}/_cleanup-{day}/"), "path")


def cleanup_status(candidates: DataFrame, dry_run: bool = True) -> DataFrame:
    """What an apply would do with each candidate; moving files is the caller's."""
    s = F.when(protected(), F.lit("protected")).when(F.lit(dry_run), F.lit("dry_run")).otherwise(F.lit("moved"))
    return candidates.withColumn("status", s)


def manifest(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Results (path, status, target, size_bytes) by status: files, bytes, first_target."""
    return results.groupBy(*by, "status").agg(F.count("*").alias("files"), F.sum("size_bytes").cast("long").alias("bytes"), F.min("target").alias("first_target"))


def freshness(watermarks: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Source, iso, stale."""
    at = F.try_to_timestamp(F.col("iso"))
    return watermarks.withColumn("stale", F.coalesce(at < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"), F.lit(True)))


def error_tail(lines: DataFrame, now: str, hours: int = 24, last: int = 3) -> DataFrame:
    """The last lines (ts, line, text) of the last 24 hours."""
    at = F.lit(now).cast("timestamp")
    return lines.where(F.col("ts").cast("timestamp").between(at - F.expr(f"INTERVAL {hours} HOURS"), at)).orderBy(F.desc("ts"), F.desc("line")).limit(last).select("ts", "line", X.log_message("text").alias("text"))


def status_counts(entities: DataFrame, files: DataFrame) -> DataFrame:
    """One row of counters."""
    n = lambda c: F.count_if(c).cast("long")
    a = entities.agg(F.count("*").cast("long").alias("cards"), n(F.col("status") == "draft").alias("drafts"), n((F.col("type") == "company") & empty_card()).alias("empty_companies"))
    b = files.agg(n(F.col("kind") == "inbox").alias("inbox"), n((F.col("kind") == "inbox") & (F.col("age_days") >= STALE["inbox"])).alias("inbox_stale"))
    return a.join(b)

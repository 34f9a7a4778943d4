"""Entity rows: construction rules, scans and views, page indexes, labelled texts (SC4-SC9, FP1-FP2, FP8-FP13, Z1-Z10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators import vocabulary as V


def blank(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def is_current() -> Column:
    """FP1."""
    return (F.lower(F.coalesce("status", F.lit(""))) != V.SUPERSEDED) & blank("t_invalid")


def type_order(col: str = "type") -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(t) for t in V.TYPES]), F.col(col)).cast("int"), F.lit(0))


def construct(rows: DataFrame) -> DataFrame:
    """The loader's rules: rows without a known type, slug or title, or with an updated that is no date, are left out."""
    default = F.coalesce(*[F.when(F.col("type") == t, F.lit(s[2][0])) for t, s in V.TYPES.items()])
    dated = F.col("type").isin(*V.OCCURRENTS)
    return (
        rows.where(F.col("type").isin(*V.TYPES) & ~blank("slug") & ~blank("title") & (blank("updated") | F.try_to_date(F.left("updated", F.lit(10))).isNotNull()))
        .withColumn("status", F.when(blank("status"), default).otherwise(F.col("status")))
        .withColumn("observed_at", F.when(dated, F.coalesce("observed_at", "created", F.lit(""))).otherwise(F.lit("")))
        .withColumn("t_invalid", F.coalesce("t_invalid", F.lit("")))
    )


def load_order(entities: DataFrame) -> DataFrame:
    """SC7: adds load_ord, vocabulary order and then slug, on which first-match rules rest.

    The order is a sortable key, not a rank: no window over all rows is needed.
    """
    return entities.withColumn("load_ord", F.concat(F.lpad(type_order().cast("string"), 2, "0"), F.lit("/"), F.col("slug")))


def first_per_slug(entities: DataFrame) -> DataFrame:
    """The page that a bare slug means: the first loaded (TR9)."""
    cols = [c for c in entities.columns if c not in ("slug", "load_ord")]
    return entities.groupBy("slug").agg(F.min("load_ord").alias("load_ord"), *[F.min_by(c, "load_ord").alias(c) for c in cols])


def scan(entities: DataFrame, kind: str | None = None, current: bool = False) -> DataFrame:
    """SC4-SC6, Z4-Z5."""
    out = entities if kind is None else entities.where(F.col("type") == kind)
    return out.where(is_current()) if current else out


def lookup(entities: DataFrame, kind: str, slug: str) -> DataFrame:
    """SC8, keyed by type and slug (TR3); a slug with a path separator finds nothing."""
    return entities.where((F.col("type") == kind) & (F.col("slug") == slug) & ~F.lit("/" in slug or "\\" in slug))


def page_path(updated="updated", today=None) -> Column:
    """SC9: folder of the type, with year and month for dated types."""
    folder = F.coalesce(*[F.when(F.col("type") == t, F.lit(s[0])) for t, s in V.TYPES.items()])
    day = F.coalesce(F.try_to_date(F.left(updated, F.lit(10))), today if today is not None else F.current_date())
    month = F.when(F.col("type").isin(*[t for t, s in V.TYPES.items() if s[1]]), F.date_format(day, "/yyyy/MM")).otherwise(F.lit(""))
    return F.concat(folder, month, F.lit("/"), F.col("slug"), F.lit(".md"))


def of_kind(entities: DataFrame, kind: str) -> DataFrame:
    """FP2."""
    return entities.where((F.col("type") == "concept") & (F.col("attrs.kind") == kind))


def page_index(entities: DataFrame, most: int = 200) -> DataFrame:
    """FP8: slug, title, summary."""
    return entities.select("slug", "title", X.summarize("body", most).alias("summary"))


def card_index(entities: DataFrame, kinds=("project", "company", "insight"), most: int = 240, mark: str = X.ELLIPSIS) -> DataFrame:
    """FP9 (and FP10 with mark '...'): current cards."""
    return entities.where(is_current() & F.col("type").isin(*kinds)).select(F.col("slug").alias("card_id"), F.col("type").alias("kind"), "title", X.summarize("body", most, mark).alias("summary"))


def metadata() -> Column:
    """FP11: a map without blanks; periods of projects only."""
    period = lambda c: F.when(F.col("type") == "project", F.col(f"attrs.{c}"))
    pairs = {"id": F.col("slug"), "display_name": F.col("title"), "source_kind": F.concat(F.lit("card_"), F.col("type")), "status": F.col("status"), "created": F.col("created"), "period_start": period("period_start"), "period_end": period("period_end"), "last_reviewed": F.col("attrs.last_reviewed")}
    return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))]), lambda k, v: v != "")


def labelled_text() -> Column:
    """FP12-FP13, Z8: labelled lines of what is there."""
    line = lambda label, c: F.when(~blank(c), F.concat(F.lit(f"{label}: "), c))
    listed = lambda label, c: F.when(F.size(F.coalesce(c, F.array())) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    a = lambda f: F.col(f"attrs.{f}")
    metric = F.transform(a("metrics"), lambda m: F.concat_ws(" ", m["name"], F.concat_ws(" -> ", m["before"], m["after"]), m["value"]))
    position = F.transform(a("positions"), lambda p: F.concat_ws(" ", p["title"], p["seniority"], F.array_join(p["keywords"], ", ")))
    return F.concat_ws("\n", F.col("title"), line("type", F.col("type")), line("status", F.col("status")), line("role", a("role")), line("period", F.concat_ws(" ~ ", F.nullif(a("period_start"), F.lit("")), F.nullif(a("period_end"), F.lit("")))), listed("domains", a("domains")), listed("stack", a("stack")), listed("keywords", a("keywords")), listed("metrics", metric), line("country", a("country")), line("size", a("size")), listed("positions", position), line("question", a("question")), F.nullif("body", F.lit("")))


def company_query() -> Column:
    """What a company page is matched by."""
    flat = lambda f: F.flatten(F.transform("attrs.positions", f))
    words = F.concat(F.array("title"), F.coalesce(flat(lambda p: F.array(p["title"], p["seniority"])), F.array()), F.coalesce(flat(lambda p: F.coalesce(p["keywords"], F.array())), F.array()), F.array(F.left("attrs.notes", F.lit(300)), F.left("body", F.lit(500))))
    return F.array_join(F.filter(words, lambda w: w.isNotNull() & (w != "")), " ")


def legacy(rows: DataFrame, kind: str) -> DataFrame:
    """Cards without a type: their id and display_name (or question) stand for slug and title; unnamed metrics go."""
    key, title = {"project": ("project_id", "display_name"), "company": ("company_id", "display_name"), "insight": ("insight_id", "question")}[kind]
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    out = rows.withColumns({"type": F.coalesce(has("type"), F.lit(kind)), "slug": F.coalesce(has("slug"), has(key)), "title": F.coalesce(has("title"), has(title))})
    if "metrics" in rows.columns:
        out = out.withColumn("metrics", F.filter("metrics", lambda m: F.coalesce(m["name"], F.lit("")) != ""))
    return out.where(~blank("slug") & ~blank("title"))


def front_matter(entities: DataFrame) -> DataFrame:
    """The row as JSON without empty fields: the common ones, relations, then the attributes beside them."""
    text = lambda c: F.nullif(c, F.lit(""))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    cols = [text(c).alias(c) for c in ("slug", "title", "type", "status", "created", "updated", "observed_at", "t_invalid")]
    cols += [some(c).alias(c) for c in ("sources", "related", *V.RELATIONS)]
    if "attrs" in entities.columns:
        for f in entities.schema["attrs"].dataType.fields:
            value = F.col(f"attrs.{f.name}")
            kept = F.nullif(value, F.lit("")) if f.dataType.typeName() == "string" else F.when(F.size(value) > 0, value) if f.dataType.typeName() == "array" else value
            cols.append(kept.alias(f.name))
    return entities.select("type", "slug", F.to_json(F.struct(*cols)).alias("meta"), "body")


def from_front_matter(pages: DataFrame) -> DataFrame:
    """Pages (path, meta: front matter as JSON, body) to rows of ``vocabulary.ENTITY``, with the loader's rules (``construct``)."""
    fields = [f for f in V.ENTITY.fields if f.name not in ("attrs", "body", "path")]
    shape = T.StructType([*fields, *V.ATTRS.fields])
    m = pages.select("path", "body", F.from_json("meta", shape).alias("m")).where("m IS NOT NULL")
    none = F.array().cast("array<string>")
    cols = [F.coalesce(f"m.{f.name}", none if f.dataType.typeName() == "array" else F.lit("")).alias(f.name) for f in fields]
    attrs = F.struct(*[F.col(f"m.{f.name}").alias(f.name) for f in V.ATTRS.fields])
    rows = construct(m.select(*cols, attrs.alias("attrs"), F.coalesce("body", F.lit("")).alias("body"), "path"))
    return rows.select([f.name for f in V.ENTITY.fields])


def insights(entities: DataFrame) -> DataFrame:
    """Insights by created, then id."""
    return scan(entities, "insight").orderBy("created", "slug")

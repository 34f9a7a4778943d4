"""Graph operators over the edge table (G1-G3, G5-G8, J1, J3-J4, J12, W6, S2, M3; ``history`` has G4).

edges: src_type, src_slug, src_ord, relation, pos, target. All orders are explicit columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import vocabulary as V
from tessera.session import dealt


def relation_order(col: str = "relation"):
    return F.array_position(F.array(*[F.lit(r) for r in (*V.RELATIONS, "related")]), F.col(col)).cast("int")


def edges(entities: DataFrame, related: bool = True) -> DataFrame:
    """The relation arrays as rows, targets unwrapped. entities needs load_ord."""
    names = [*V.RELATIONS, *(["related"] if related else [])]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("relation"), F.coalesce(F.col(r), F.array().cast("array<string>")).alias("targets")) for r in names]))
    return (
        entities.select(F.col("type").alias("src_type"), F.col("slug").alias("src_slug"), F.col("load_ord").alias("src_ord"), each.alias("e"))
        .select("src_type", "src_slug", "src_ord", "e.relation", F.posexplode("e.targets").alias("pos", "raw"))
        .select("src_type", "src_slug", "src_ord", "relation", "pos", X.link_target("raw").alias("target")).where("target <> ''")
    )


def resolved(e: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the page that each target means, the first loaded of its slug (TR9); edges to no page go."""
    first = entities.groupBy("slug").agg(F.min_by(F.struct("type", "title"), "load_ord").alias("p"))
    return e.join(first.withColumnRenamed("slug", "target"), "target").select(*e.columns, F.col("p.type").alias("type"), F.col("p.title").alias("title"))


def typed_neighbors(e: DataFrame, rows: int | None = None) -> DataFrame:
    """G1: per source and relation its distinct targets in order. rows: about how many edges there are, counted here if it isn't given."""
    first = dealt(e.where("relation <> 'related'"), "src_slug", rows=rows).groupBy("src_slug", "relation", "target").agg(F.min("pos").alias("pos"))
    return first.groupBy("src_slug", "relation").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"]).alias("targets"))


def neighbor_links(e: DataFrame, rows: int | None = None) -> DataFrame:
    """One hop, typed relations first, first occurrence of each target: src_slug, ord, target. rows: as in ``typed_neighbors``."""
    w = Window.partitionBy("src_slug").orderBy("k", "target")
    return dealt(e, "src_slug", rows=rows).groupBy("src_slug", "target").agg(F.min(F.struct(relation_order().alias("r"), "pos")).alias("k")).select("src_slug", F.row_number().over(w).alias("ord"), "target")


def reverse_relations(e: DataFrame) -> DataFrame:
    """Target, relation, source, ord (the order of sources)."""
    w = Window.partitionBy("target").orderBy("src_ord", relation_order(), "pos")
    return e.select("target", "relation", F.col("src_slug").alias("source"), F.row_number().over(w).alias("ord"))


def dead_links(e: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct related targets that no page has."""
    return e.where("relation = 'related'").join(pages.select(F.col("slug").alias("target")).distinct(), "target", "left_anti").select("src_slug", "target").distinct()


def without_dead_links(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """M4: related keeps the links to pages there are, in order. Applying it twice changes nothing further."""
    kept = entities.select("type", "slug", F.posexplode("related").alias("pos", "link")).withColumn("target", X.link_target("link"))
    kept = kept.join(pages.select(F.col("slug").alias("target")).distinct(), "target", "left_semi")
    kept = kept.groupBy("type", "slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link"))), lambda x: x["link"]).alias("__kept"))
    return entities.join(kept, ["type", "slug"], "left").withColumn("related", F.coalesce("__kept", F.array().cast("array<string>"))).drop("__kept").select(entities.columns)


def closure(e: DataFrame, relations=V.TRANSITIVE, depth: int = 2) -> DataFrame:
    """src_slug, target, hops (the fewest), at most ``depth``; one join for each hop, cycles cost nothing."""
    step = e.where(F.col("relation").isin(*relations)).select("src_slug", "target").distinct()
    reached = step.where("src_slug <> target").withColumn("hops", F.lit(1))
    front = reached
    for hop in range(2, depth + 1):
        front = (
            front.select("src_slug", F.col("target").alias("mid")).join(step.select(F.col("src_slug").alias("mid"), "target"), "mid")
            .where("src_slug <> target").select("src_slug", "target").distinct().withColumn("hops", F.lit(hop))
        )
        reached = reached.unionByName(front)
    return reached.groupBy("src_slug", "target").agg(F.min("hops").alias("hops"))


def ancestors_by_version(versions: DataFrame) -> DataFrame:
    """G4 where every page supersedes at most one other and is superseded by at most one: a chain is a window.

    versions: chain, ord, slug. Gives start, slug, hop for the newest of each chain; no recursion.
    """
    w = Window.partitionBy("chain").orderBy(F.desc("ord"))
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return versions.select(F.first("slug").over(every).alias("start"), "slug", (F.row_number().over(w) - 1).alias("hop"))


def reverse_capped(e: DataFrame, seeds: DataFrame, cap: int = 5) -> DataFrame:
    """At most ``cap`` sources for each seed and relation, in source order, that aren't seeds themselves."""
    w = Window.partitionBy("seed", "relation").orderBy("src_ord", "pos")
    rows = e.join(seeds.select(F.col("slug").alias("seed")), F.col("target") == F.col("seed"))
    rows = rows.join(seeds.select(F.col("slug").alias("src_slug")), "src_slug", "left_anti")
    first = rows.groupBy("seed", "relation", "src_slug").agg(F.min("src_ord").alias("src_ord"), F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("seed", "relation", F.col("src_slug").alias("source"), "rank")


def relation_context(e: DataFrame, chosen: DataFrame) -> DataFrame:
    """Query, target, relation, sources: edges inside each query's chosen pages. chosen: query, slug."""
    inside = (
        e.where("relation <> 'related'").join(chosen.select("query", F.col("slug").alias("src_slug")), "src_slug")
        .join(chosen.select("query", F.col("slug").alias("target")), ["query", "target"], "left_semi")
    )
    return inside.groupBy("query", "target", "relation").agg(F.array_sort(F.collect_set("src_slug")).alias("sources"))


def supersede(entities: DataFrame, e: DataFrame, stamp: str) -> DataFrame:
    """M3: targets of ``supersedes`` get the status, and t_invalid from the superseding page's observed_at or the stamp.

    A target may name its type (``type:slug``); else it is of the source's type.
    """
    refs = e.where("relation = 'supersedes'").select(
        F.when(F.col("target").contains(":"), F.split_part("target", F.lit(":"), F.lit(1))).otherwise(F.col("src_type")).alias("type"),
        F.regexp_replace("target", "^[^:]*:", "").alias("slug"), "src_type", "src_slug", "src_ord",
    )
    when = entities.select(F.col("type").alias("src_type"), F.col("slug").alias("src_slug"), F.coalesce(F.nullif("observed_at", F.lit("")), F.lit(stamp)).alias("__at"))
    hit = refs.join(when, ["src_type", "src_slug"]).groupBy("type", "slug").agg(F.max_by("__at", "src_ord").alias("__at"))
    there = F.col("__at").isNotNull()
    return (
        entities.join(hit, ["type", "slug"], "left")
        .withColumns({"status": F.when(there, F.lit(V.SUPERSEDED)).otherwise(F.col("status")), "t_invalid": F.coalesce("__at", "t_invalid"), "updated": F.when(there, F.lit(stamp)).otherwise(F.col("updated"))})
        .select(entities.columns)
    )


def with_link(links, link):
    """The link added unless its target is there."""
    return F.when(F.array_contains(F.transform(links, X.link_target), X.link_target(link)), links).otherwise(F.concat(links, F.array(link)))

"""What pages supersede, newest first, where a page may supersede several.

The order is that of a depth-first walk in which each page comes once, at its first visit. That visit lies on the least of all
paths to it that pass no page twice, compared place by place, and the beginning of such a path is least again. So a frontier is
enough: a round extends the best path of each page that has just got a better one, and of all paths to a page only the least survives. A page's
best path is final after as many rounds as it is long; diamonds cost a row a page, not a row a path.

Starts whose history lies in one small component (at most ``SMALL`` links) are walked within a task, all at once; only larger components take rounds.

Defined cases: references are a slug or ``type:slug``; a slug means the first page loaded, ``type:slug`` the last of that name; one that names no page
is looked for without what stands before its first colon, and passed over if there is none either. Repeated references and cycles cost nothing. Of pages of
equal type and slug the last stands. Starts that name no page give no row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import components, written
from tessera.session import ship

#: Links of a component up to which one task walks it.
SMALL = 500_000
#: Rows of a walk in one batch.
ROWS = 50_000
RELATION = "supersedes"


def names(pages: DataFrame) -> DataFrame:
    """name, page (``type:slug``): what references may say. pages: type, slug, load_ord."""
    own = F.concat("type", F.lit(":"), "slug")
    full = pages.select(own.alias("name"), own.alias("page")).distinct()
    short = pages.groupBy(F.col("slug").alias("name")).agg(F.min_by(own, "load_ord").alias("page"))
    return full.unionByName(short.join(full.select("name"), "name", "left_anti"))


def resolved(refs: DataFrame, known: DataFrame, ref: str) -> DataFrame:
    """refs with page: what ``ref`` names, else what it names without its part before a colon; others go."""
    rest = F.when(F.col(ref).contains(":"), F.expr(f"substring({ref}, locate(':', {ref}) + 1)"))
    a, b = known.select(F.col("name").alias("__a"), F.col("page").alias("__p")), known.select(F.col("name").alias("__b"), F.col("page").alias("__q"))
    out = refs.join(a, F.col(ref) == F.col("__a"), "left").join(b, F.col("__a").isNull() & (rest == F.col("__b")), "left")
    return out.withColumn("page", F.coalesce("__p", "__q")).where("page IS NOT NULL").select(*refs.columns, "page")


def walked(links: list[tuple[str, int, str]], starts: list[str]) -> Iterator[tuple[str, int, int, str]]:
    """start, place, hop, page: depth-first walks over links (from, pos, to)."""
    after: dict[str, list[str]] = {}
    for u, _, v in sorted(links):
        after.setdefault(u, []).append(v)
    for start in starts:
        seen, stack = set(), [(start, 0)]
        while stack:
            page, hop = stack.pop()
            if page not in seen:
                yield start, len(seen), hop, page
                seen.add(page)
                stack += [(v, hop + 1) for v in reversed(after.get(page, ()))]


def _within_tasks(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Components as they come, each whole in one task. links: component, u, pos, v; starts: component, start."""
    schema = pa.schema([("start", pa.string()), ("place", pa.int64()), ("hop", pa.int64()), ("page", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, edges, first = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            rows = walked(edges, first)
            while some := list(islice(rows, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)
            edges.clear()
            first.clear()

        for b in batches:
            for component, u, pos, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if component != now:
                    yield from done()
                    now = component
                if v is None:
                    first.append(u)
                else:
                    edges.append((u, pos, v))
        yield from done()

    both = links.select("component", "u", "pos", "v").unionByName(starts.select("component", F.col("start").alias("u"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("v")))
    return both.repartition("component").sortWithinPartitions("component").mapInArrow(run, "start string, place long, hop long, page string")


def _by_rounds(links: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """The same by a frontier of best paths. A place in a path is (pos, page), so that paths are told apart."""
    step = links.select(F.col("u").alias("page"), F.struct("pos", "v").alias("step"))
    front = best = written(starts.select("start", F.col("start").alias("page"), F.array().cast("array<struct<pos:int,v:string>>").alias("path")), "paths")
    for _ in range(most):
        own = F.col("step.v")
        new = front.join(step, "page").where((own != F.col("start")) & ~F.exists("path", lambda x: x["v"] == own))
        new = new.groupBy("start", own.alias("page")).agg(F.min(F.concat("path", F.array("step"))).alias("path"))
        had = best.select("start", "page", F.col("path").alias("had"))
        front = written(new.join(had, ["start", "page"], "left").where("had IS NULL OR path < had").drop("had"), "paths")
        if front.limit(1).count() == 0:
            break
        best = written(best.unionByName(front).groupBy("start", "page").agg(F.min("path").alias("path")), "paths")
    else:
        raise RuntimeError("histories are longer than the rounds allowed")
    w = Window.partitionBy("start").orderBy("path")
    return best.select("start", (F.row_number().over(w) - 1).cast("long").alias("place"), F.size("path").cast("long").alias("hop"), "page")


def histories(e: DataFrame, pages: DataFrame, starts: DataFrame, small: int = SMALL, most: int = 10_000) -> DataFrame:
    """start, place (from 0), hop, type, slug: each start's history, itself first.

    e: src_type, src_slug, relation, pos, target (of equal type and slug all edges count); pages: type, slug, load_ord; starts: ref.
    """
    ship(e.sparkSession)
    known = written(names(pages), "names")
    begin = resolved(starts.select("ref").distinct(), known, "ref").withColumnRenamed("page", "u")
    said = e.where(F.col("relation") == RELATION).select(F.concat("src_type", F.lit(":"), "src_slug").alias("u"), F.col("pos").cast("int").alias("pos"), "target")
    said = said.join(known.select(F.col("page").alias("u")).distinct(), "u", "left_semi")
    links = written(resolved(said, known, "target").groupBy("u", F.col("page").alias("v")).agg(F.min("pos").alias("pos")).where("u <> v"), "history")
    part = components(links.select("u", "v")).select(F.col("node").alias("u"), "component")
    placed = links.join(part, "u")
    large = written(placed.groupBy("component").count().where(F.col("count") > small).select("component"), "large")
    first = begin.select(F.col("u").alias("start")).distinct().join(part.withColumnRenamed("u", "start"), "start", "left")
    live = first.select("component").where("component IS NOT NULL").distinct()
    out = _within_tasks(placed.join(live, "component", "left_semi").join(large, "component", "left_anti"), first.where("component IS NOT NULL").join(large, "component", "left_anti"))
    alone = first.where("component IS NULL").select("start", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("hop"), F.col("start").alias("page"))
    out = out.unionByName(alone)
    if large.limit(1).count():
        out = out.unionByName(_by_rounds(placed.join(large, "component", "left_semi"), first.join(large, "component", "left_semi").select("start"), most))
    out = written(out, "walks")
    named = out.join(begin.withColumnRenamed("u", "start"), "start")
    at = "locate(':', page)"
    return named.select(F.col("ref").alias("start"), "place", "hop", F.expr(f"substring(page, 1, {at} - 1)").alias("type"), F.expr(f"substring(page, {at} + 1)").alias("slug"))

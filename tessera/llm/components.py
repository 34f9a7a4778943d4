"""Connected components: links are first contracted within bounded chunks, then alternate large-star and small-star
rounds, each an aggregation and a join.

Every round is written to the shared folder. No group of neighbours is ever collected: minima are
aggregated partially before the shuffle and joined back by a broadcast of checked size; beyond that the skew join splits hubs. Repeated links are allowed;
links to oneself and links with a null end are dropped; no links give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checked_broadcast, cut, small_batches

#: Links that one task contracts at a time.
CHUNK = 200_000


def contracted(links: DataFrame, n: int) -> DataFrame:
    """The same components with each node of a chunk linked to the least node it reaches there."""

    def star(u: list[int], v: list[int]) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for a, b in zip(u, v, strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        out = [(x, r) for x in list(up) if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for b in batches:
            u += b.column(0).to_pylist()
            v += b.column(1).to_pylist()
            if len(u) >= CHUNK:
                yield star(u, v)
                u, v = [], []
        if u:
            yield star(u, v)

    small_batches(links.sparkSession)
    return links.coalesce(max(1, ceil(n / CHUNK))).mapInArrow(run, "u long, v long")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours above a node are linked to the least of it and its neighbours; small: those below, and itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = checked_broadcast(cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))))
    near = both.where("v > u") if large else both
    out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    return out.where("u <> v")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (u, v; whole numbers) to node, component: the least node that can be reached; nodes without links are left out."""
    own = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    now = cut(contracted(own, own.count()).distinct())
    state = _state(now)
    for _ in range(most_rounds):
        now = cut(_star(_star(now, large=True), large=False))
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components didn't settle")
    # stars by now: every node is linked to the least of its component
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return cut(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()))

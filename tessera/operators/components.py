"""Connected components of any keys: links are contracted in rounds until none are left.

In a round each node goes to the one of its neighbours and itself that a draw of the round puts first, and links become links between those; equal ones and
loops go. Links of a chain are halved so, in whatever order its nodes are named, and later rounds cost little. Minima are aggregated
partially before they shuffle; every round is written to the shared folder, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read from there: a cut in its lineage."""
    df.write.parquet(at := scratch_path(df.sparkSession, name))
    return df.sparkSession.read.parquet(at)


def components(links: DataFrame, most: int = 100) -> DataFrame:
    """links (u, v) to node, component: the least node that can be reached, itself included. Links to oneself name a node, those with a null end none."""
    ends = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    now = written(links.where("u IS NOT NULL AND v IS NOT NULL").select(*ends).distinct(), "links")
    heads: list[DataFrame] = []
    for k in range(most):
        drawn = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("head"))  # noqa: E731,B023
        near = now.select(F.col("u").alias("node"), drawn("v").alias("d")).unionByName(now.select(F.col("v").alias("node"), drawn("u").alias("d")))
        head = near.groupBy("node").agg(F.min("d").alias("d")).select("node", F.least("d", drawn("node"))["head"].alias("head"))
        heads.append(head := written(head, "heads"))
        left = now.where("u <> v").join(head.select(F.col("node").alias("u"), F.col("head").alias("a")), "u").select("v", "a")
        both = left.join(head.select(F.col("node").alias("v"), F.col("head").alias("b")), "v").where("a <> b")
        now = written(both.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
        if now.limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components didn't settle")
    # from the last round back: a head that had no links left is its component's last
    out = heads.pop()
    while heads:
        out = heads.pop().join(out.select(F.col("node").alias("head"), F.col("head").alias("far")), "head", "left").select("node", F.coalesce("far", "head").alias("head"))
    out = written(out, "labels")
    return written(out.join(out.groupBy("head").agg(F.min("node").alias("component")), "head").select("node", "component"), "labels")

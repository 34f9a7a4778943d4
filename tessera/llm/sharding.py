"""Sharding by longest-processing-time scheduling: groups that must stay together, sorted by size, go
to the least-loaded shard through a heap.

All groups are scheduled, at every size of the input. The driver holds a row for each distinct group size, not for each group: distinct
sizes number at most the root of twice the total bytes. Groups of one size go to shards in an order that follows from the
loads before: some take the gap up to the next load, then all take turns. ``schedule`` writes that down as segments
(from which group on, which shards in turn), and executors read a group's shard off its place among those of its size (by digest).

Law ``bytes``: shard sizes near equal (a group larger than a fair share has a shard to itself).

Defined cases: a null text has 0 bytes (size 8), CRC 0, and shares the group of the empty texts; null
ids are placed like others; repeated rows each take a slot; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checked_broadcast, cut, fresh_path, text_or_empty

OVERHEAD = 8
SLOT_ROWS = 4096
#: Bits of a digest by which the groups of one size are dealt out while they are numbered.
RANK_BITS = 24


def turns(loads: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """Where ``count`` groups of one size go, as (from which on, shards in turn); loads are brought up to date.

    Shard i offers the places load, load + size, load + 2 size ...; groups take the smallest places, equal ones by shard. With
    load = epoch * size + rest, places in one epoch come by rest, and a shard takes part from its own epoch on.
    """
    at = {i: divmod(load, size) for i, load in enumerate(loads)}
    epochs = sorted({e for e, _ in at.values()})
    out, start = [], 0
    for k, epoch in enumerate(epochs):
        live = sorted((i for i in at if at[i][0] <= epoch), key=lambda i: (at[i][1], i))
        out.append((start, live))
        room = (epochs[k + 1] - epoch) * len(live) if k + 1 < len(epochs) else count
        took = min(room, count - start)
        for place, i in enumerate(live):
            loads[i] += size * (took // len(live) + (place < took % len(live)))
        start += took
        if start == count:
            break
    return out


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, list[int]]]]:
    """(size, number of groups) to segments for each size: longest first, each group to the least-loaded shard, of equal loads the first.

    Few groups of a size go through the heap one by one; many take turns, which gives the same places.
    """
    heap, out = [(0, s) for s in range(shards)], {}
    for size, count in sorted(sizes, reverse=True):
        if count <= 2 * shards:
            row = []
            for _ in range(count):
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                row.append(shard)
            out[size] = [(0, row)]
        else:
            loads = [load for _, load in sorted((s, load) for load, s in heap)]
            out[size] = turns(loads, size, count)
            heap = [(load, s) for s, load in enumerate(loads)]
            heapq.heapify(heap)
    return out


def numbered(groups: DataFrame, shape: DataFrame) -> DataFrame:
    """digest, bytes, rank: a group's place by digest among those of its size. shape: bytes, shift.

    The groups of one size are dealt out by leading bits of the digest, more of them the more groups there are; no window holds
    more than some SLOT_ROWS groups, or a size's counts.
    """
    lead = F.conv(F.hex(F.substring("digest", 1, RANK_BITS // 8)), 16, 10).cast("int")
    dealt = groups.withColumn("lead", lead).join(shape, "bytes").select("digest", "bytes", F.expr("shiftright(lead, shift)").alias("bucket"))
    before = Window.partitionBy("bytes").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("bytes", "bucket").count().select("bytes", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("bytes", "bucket").orderBy("digest")
    return dealt.withColumn("place", F.row_number().over(within)).join(starts, ["bytes", "bucket"]).select("digest", "bytes", (F.col("start") + F.col("place") - 1).alias("rank"))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, size, text_crc32, digest, shard, slot (gapless from 0 in a shard)."""
    spark, text = docs.sparkSession, text_or_empty(text_col)
    at = fresh_path(spark, "sizes")
    docs.select(
        F.col(id_col).alias(id_col), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"), F.monotonically_increasing_id().alias("__row"),
    ).write.parquet(at)
    rows = spark.read.parquet(at)
    groups = cut(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))
    counts = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).toLocalIterator()]
    shift = lambda n: RANK_BITS - min(RANK_BITS, max(0, ceil(n / SLOT_ROWS) - 1).bit_length())
    placed = schedule(counts, shards)
    made = spark.createDataFrame([(b, shift(n), placed[b]) for b, n in counts], "bytes long, shift int, turns array<struct<start:long,shards:array<int>>>")
    table = checked_broadcast(cut(made))
    turn = F.element_at(F.filter("turns", lambda s: s["start"] <= F.col("rank")), -1)
    at_ = F.pmod(F.col("rank") - turn["start"], F.size(turn["shards"])).cast("int")
    found = numbered(groups, table.select("bytes", "shift")).join(table, "bytes").select("digest", F.get(turn["shards"], at_).alias("shard"))
    n = rows.count()
    buckets = max(1, ceil(n / shards / SLOT_ROWS))
    put = cut(rows.join(found, "digest")).withColumn("bucket", F.pmod(F.xxhash64("__row"), F.lit(buckets)).cast("int"))
    # slots: rows before the bucket in its shard, then the place in the bucket
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = put.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("__row")
    return (
        put.withColumn("place", F.row_number().over(within)).join(counts, ["shard", "bucket"])
        .select(id_col, "size", "text_crc32", "digest", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"))
    )

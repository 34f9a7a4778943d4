"""Places in an order without gathering a group: rows are sorted by range, counted range by range, and numbered from there.

A hot group lies in as many ranges as its rows need; a window holds the part of a group in one range, or a group's counts
(a row for each range at most).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import written


def ranked(rows: DataFrame, by: list[str], order: list, name: str = "place") -> DataFrame:
    """rows with their place (from 1) among those of equal ``by`` (nulls are equal), in ``order`` (equals in any order)."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    sorted_ = rows.repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = written(sorted_.withColumns({"__part": F.spark_partition_id(), "__by": F.struct(*(keys or [F.lit(0).alias("x")]))}), "ranges")
    before = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__by", "__part").count().select("__by", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__by", "__part").orderBy(*order)
    return placed.withColumn("__n", F.row_number().over(within)).join(starts, ["__by", "__part"]).withColumn(name, F.col("__start") + F.col("__n")).select(*rows.columns, name)

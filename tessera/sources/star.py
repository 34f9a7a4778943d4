"""The model over the driver's star schema: entities, edges, cards, logs, files; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.entities import load_order
from tessera.session import dealt


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def slug(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}-"), F.col(key).cast("string"))


def entities(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """type, slug, title, status, created, observed_at, t_invalid, body, load_ord of the tables asked for."""
    none = F.lit("")

    def rows(t: str, type_: str, key: str, title: str, status, created, body) -> DataFrame:
        return table(spark, d, t).select(F.lit(type_).alias("type"), slug(t if t != "orders" else "order", key).alias("slug"), F.col(title).alias("title"), status.alias("status"), created.alias("created"), created.alias("observed_at"), none.alias("t_invalid"), body.alias("body"))

    status = F.when(F.col("o_orderstatus") == "F", F.lit("archived")).when(F.col("o_orderstatus") == "P", F.lit("superseded")).otherwise(F.lit("active"))
    made = {
        "customer": lambda: rows("customer", "company", "c_custkey", "c_name", F.lit("target"), none, F.col("c_mktsegment")),
        "supplier": lambda: rows("supplier", "project", "s_suppkey", "s_name", F.lit("active"), none, none),
        "part": lambda: rows("part", "concept", "p_partkey", "p_name", F.lit("active"), none, F.col("p_type")),
        "nation": lambda: rows("nation", "profile", "n_nationkey", "n_name", F.lit("active"), none, none),
        "region": lambda: rows("region", "profile", "r_regionkey", "r_name", F.lit("active"), none, none),
        "orders": lambda: rows("orders", "log", "o_orderkey", "o_orderpriority", status, F.date_format("o_orderdate", "yyyy-MM-dd"), none),
    }
    out = None
    for k in kinds or made:
        out = made[k]() if out is None else out.unionByName(made[k]())
    return load_order(out)


ENTITIES = """ents AS (
  SELECT 'company' AS type, 'customer-' || c_custkey AS slug, c_name AS title, 'target' AS status, '' AS created, '02' AS tord, c_mktsegment AS body FROM customer
  UNION ALL SELECT 'project', 'supplier-' || s_suppkey, s_name, 'active', '', '01', '' FROM supplier
  UNION ALL SELECT 'concept', 'part-' || p_partkey, p_name, 'active', '', '03', p_type FROM part
  UNION ALL SELECT 'profile', 'nation-' || n_nationkey, n_name, 'active', '', '06', '' FROM nation
  UNION ALL SELECT 'profile', 'region-' || r_regionkey, r_name, 'active', '', '06', '' FROM region
  UNION ALL SELECT 'log', 'order-' || o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'archived' WHEN 'P' THEN 'superseded' ELSE 'active' END, strftime(o_orderdate, '%Y-%m-%d'), '05', '' FROM orders)"""


def edges(spark: SparkSession, d: str, *relations: str) -> DataFrame:
    """src_type, src_slug, src_ord, relation, pos, target."""
    from pyspark.sql import Window

    t = lambda n: table(spark, d, n)
    row = lambda df, kind, tord, src, rel, pos, target: df.select(F.lit(kind).alias("src_type"), src.alias("src_slug"), F.concat(F.lit(f"{tord}/"), src).alias("src_ord"), F.lit(rel).alias("relation"), pos.cast("int").alias("pos"), target.alias("target"))
    zero = F.lit(0)
    order = slug("order", "o_orderkey")
    made = {
        "part_of": lambda: (
            row(t("customer"), "company", "02", slug("customer", "c_custkey"), "part_of", zero, slug("nation", "c_nationkey"))
            .unionByName(row(t("supplier"), "project", "01", slug("supplier", "s_suppkey"), "part_of", zero, slug("nation", "s_nationkey")))
            .unionByName(row(t("nation"), "profile", "06", slug("nation", "n_nationkey"), "part_of", zero, slug("region", "n_regionkey")))
        ),
        "uses": lambda: row(dealt(t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey", rows=t("lineitem")).groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n")), "log", "05", slug("order", "l_orderkey"), "uses", F.col("n"), slug("part", "l_partkey")),
        "supersedes": lambda: row(
            t("orders").withColumn("prev", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("prev IS NOT NULL"),
            "log", "05", order, "supersedes", zero, slug("order", "prev")),
        "related": lambda: row(t("orders"), "log", "05", order, "related", zero, slug("customer", "o_custkey")),
    }
    out = None
    for r in relations or made:
        out = made[r]() if out is None else out.unionByName(made[r]())
    return out


def edge_rows(spark: SparkSession, d: str, *relations: str) -> int:
    """At most so many edges: the rows of the tables that they come from, which Parquet's footers have."""
    of = {"part_of": ("customer", "supplier", "nation"), "uses": ("lineitem",), "supersedes": ("orders",), "related": ("orders",)}
    return sum(table(spark, d, t).count() for r in relations or of for t in of[r])


def edges_sql(*relations: str) -> str:
    parts = {
        "part_of": """SELECT 'company' AS src_type, 'customer-' || c_custkey AS src_slug, '02/customer-' || c_custkey AS src_ord, 'part_of' AS relation, 0 AS pos, 'nation-' || c_nationkey AS target FROM customer
  UNION ALL SELECT 'project', 'supplier-' || s_suppkey, '01/supplier-' || s_suppkey, 'part_of', 0, 'nation-' || s_nationkey FROM supplier
  UNION ALL SELECT 'profile', 'nation-' || n_nationkey, '06/nation-' || n_nationkey, 'part_of', 0, 'region-' || n_regionkey FROM nation""",
        "uses": """SELECT 'log' AS src_type, 'order-' || l_orderkey AS src_slug, '05/order-' || l_orderkey AS src_ord, 'uses' AS relation, min(l_linenumber) AS pos, 'part-' || l_partkey AS target FROM lineitem GROUP BY l_orderkey, l_partkey""",
        "supersedes": """SELECT 'log' AS src_type, 'order-' || o_orderkey AS src_slug, '05/order-' || o_orderkey AS src_ord, 'supersedes' AS relation, 0 AS pos, 'order-' || prev AS target
  FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) WHERE prev IS NOT NULL""",
        "related": """SELECT 'log' AS src_type, 'order-' || o_orderkey AS src_slug, '05/order-' || o_orderkey AS src_ord, 'related' AS relation, 0 AS pos, 'customer-' || o_custkey AS target FROM orders""",
    }
    return "edges AS (" + " UNION ALL ".join(parts[r] for r in relations or parts) + ")"

"""Queries over cards, registries and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cards as K
from tessera.plans.registry import query
from tessera.sources import star
from tessera.sources.star import slug, table


@query("SELECT 'customer-' || o_custkey AS card_id, 'company' AS kind FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'supplier-' || s_suppkey, 'project' FROM supplier UNION ALL SELECT 'gone', NULL")
def card_targets(spark, d):
    """J15."""
    asked = table(spark, d, "orders").where("o_orderstatus = 'F'").select(slug("customer", "o_custkey").alias("card_id")).unionByName(table(spark, d, "supplier").select(slug("supplier", "s_suppkey").alias("card_id")))
    asked = asked.unionByName(spark.createDataFrame([("gone",)], "card_id string"))
    return K.card_targets(asked, star.entities(spark, d, "customer", "supplier", "part"))


@query("SELECT page_id AS session, CASE WHEN page_id % 3 = 0 THEN '/w/even' WHEN page_id % 3 = 1 THEN '/w/even/deep' END AS root FROM pages")
def registered_roots(spark, d):
    """The first active root above a working folder; /w/evening isn't under /w/even."""
    k = F.col("page_id") % 3
    cwd = F.when(k == 0, F.lit("/w/even/")).when(k == 1, F.lit("/w/even/deep/er")).otherwise(F.lit("/w/evening"))
    reg = spark.createDataFrame([("/w/even/deep", "active", 1), ("/w/even/", "active", 2), ("/w", "paused", 0)], "path string, state string, ord int")
    return K.registered_root(table(spark, d, "pages").select(F.col("page_id").alias("session"), cwd.alias("cwd")), reg)


@query("SELECT o_custkey AS answer_id, 'card_log' AS target_kind, 'order-' || o_orderkey AS target_ref FROM orders")
def answer_targets(spark, d):
    """Citations collected for an answer, and read again as targets."""
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").alias("rank"), F.lit("log").alias("kind"), slug("order", "o_orderkey").alias("card_id"), F.col("o_orderpriority").alias("title"))
    return K.answer_targets(K.answer_record(m))


@query("SELECT c_custkey AS query, count(o_orderkey) AS matches, CASE WHEN count(o_orderkey) > 0 THEN 'ready' ELSE 'refused' END AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def answer_status(spark, d):
    """Z13-Z15."""
    return K.answer_status(table(spark, d, "customer").select(F.col("c_custkey").alias("query")), table(spark, d, "orders").select(F.col("o_custkey").alias("query")))


@query("SELECT 'when ' || event_type AS trigger, props AS action, least(greatest(value / 100.0, 0.0), 1.0) AS confidence FROM events WHERE event_type <> 'error'")
def extracted_patterns(spark, d):
    """Z28."""
    trigger = F.when(F.col("event_type") == "error", F.lit(" ")).otherwise(F.concat(F.lit(" when "), "event_type"))
    p = table(spark, d, "events").select(F.to_json(F.array(F.struct(trigger.alias("trigger"), F.col("props").alias("action"), (F.col("value") / 100.0).cast("string").alias("confidence")))).alias("payload"))
    return K.extracted_patterns(p).select("trigger", "action", "confidence")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, 'Profile-' || strftime(o_orderdate, '%Y-%m-%d') || '.md' AS name, CASE WHEN o_orderstatus = 'P' THEN 'later' ELSE 'pending_review' END AS status FROM orders WHERE o_orderstatus <> 'F'")
def pending_reviews(spark, d):
    """FP20."""
    text = F.when(F.col("o_orderstatus") == "F", F.lit("---\nstatus: applied\n---\n")).when(F.col("o_orderstatus") == "P", F.lit("---\nstatus: later\n---")).otherwise(F.lit("no status"))
    f = table(spark, d, "orders").select(F.concat(F.lit("Profile-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".md")).alias("name"), text.alias("text"))
    return K.pending_reviews(f)


@query("""SELECT page, part, pos, text FROM (SELECT conv_id AS page, 'fact' AS part, turn AS pos, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') WHERE r <= 5
UNION ALL SELECT page, part, pos, text FROM (SELECT conv_id AS page, 'trigger' AS part, turn AS pos, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'assistant') WHERE r <= 4""")
def summary_lines(spark, d):
    """S5."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("pos"), "role", "text")
    return K.summary_lines(c.where("role = 'user'").withColumnRenamed("text", "statement"), c.where("role = 'assistant'").withColumnRenamed("text", "trigger"))


@query("SELECT count(*) AS docs, count(*) FILTER (value > 50) AS pages, 0::BIGINT AS errors, false AS failed FROM events")
def ingest_rollup(spark, d):
    """Z39."""
    r = table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("docs"), F.count_if(F.col("value") > 50).alias("pages")).withColumn("errors", F.lit(0))
    return K.ingest_rollup(r)

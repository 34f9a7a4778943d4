"""Queries over files: snapshots, mirrors, cleanup."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import lint as L
from tessera.operators import merge as M
from tessera.plans.registry import query
from tessera.sources import raw
from tessera.sources.star import table


@query("""SELECT 'doc/' || doc_id AS rel_path, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 5 = 1 THEN 'touched' WHEN doc_id % 5 = 2 THEN 'changed' ELSE 'unchanged' END AS change FROM documents""")
def snapshot_diff(spark, d):
    """J8, SC18, Z30."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    base = lambda mtime, sha: docs.select(F.concat(F.lit("doc/"), k).alias("rel_path"), mtime.cast("double").alias("mtime"), F.col("n_chars").alias("size"), sha.alias("sha"), "doc_id")
    now = base(F.lit(2), F.sha2("text", 256))
    before = base(F.when((k % 5).isin(1, 2), F.lit(1)).otherwise(F.lit(2)), F.when(k % 5 == 2, F.lit("old")).otherwise(F.sha2("text", 256))).where(k % 5 != 0)
    return M.snapshot_diff(now.drop("doc_id"), before.drop("doc_id"))


def _files(spark, d):
    """Line items as files: an order is a project folder or holds files of the other kinds."""
    li = table(spark, d, "lineitem")
    k = F.col("l_orderkey")
    kind = F.when(k % 2 == 0, F.lit("project")).when(k % 7 == 1, F.lit("inbox")).when(k % 7 == 2, F.lit("resume")).when(k % 7 == 3, F.lit("memory_inbox")).otherwise(F.lit("report"))
    return li.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"), F.concat(F.lit("folder-"), k).alias("folder"), kind.alias("kind"), F.datediff(F.lit("1999-01-01").cast("date"), F.col("l_shipdate").cast("date")).cast("long").alias("age_days"), F.col("l_quantity").cast("long").alias("size_bytes"), (F.col("l_returnflag") == "R").alias("pinned"), F.when(F.col("l_linestatus") == "F", F.lit("Keep")).otherwise(F.lit("SKIP")).alias("cleanup"))


_FILES = """f AS (SELECT l_orderkey || '/' || l_linenumber AS path, 'folder-' || l_orderkey AS folder, CASE WHEN l_orderkey % 2 = 0 THEN 'project' WHEN l_orderkey % 7 = 1 THEN 'inbox' WHEN l_orderkey % 7 = 2 THEN 'resume' WHEN l_orderkey % 7 = 3 THEN 'memory_inbox' ELSE 'report' END AS kind,
  date_diff('day', l_shipdate::DATE, DATE '1999-01-01') AS age_days, l_quantity::BIGINT AS size_bytes, l_returnflag = 'R' OR l_linestatus <> 'F' AS skip FROM lineitem)"""
_DORMANT = "SELECT 'dormant_project' AS kind, folder AS path, max(age_days) AS age_days, sum(size_bytes)::BIGINT AS size_bytes FROM f WHERE kind = 'project' GROUP BY folder HAVING NOT bool_or(skip) AND max(age_days) >= 90"


@query(f"WITH {_FILES} {_DORMANT}")
def dormant_groups(spark, d):
    """A15."""
    return L.dormant(_files(spark, d))


@query(f"WITH {_FILES} SELECT kind || '_stale' AS kind, path, age_days, size_bytes FROM f WHERE kind <> 'project' AND age_days >= CASE kind WHEN 'inbox' THEN 30 WHEN 'memory_inbox' THEN 60 ELSE 90 END AND (kind = 'report' OR NOT skip) UNION ALL {_DORMANT}")
def stale_scan(spark, d):
    """L8-L10, L12, L14."""
    return L.scan_all(_files(spark, d))


@query(f"WITH {_FILES}, s AS (SELECT kind || '_stale' AS kind, size_bytes FROM f WHERE kind <> 'project' AND age_days >= CASE kind WHEN 'inbox' THEN 30 WHEN 'memory_inbox' THEN 60 ELSE 90 END AND (kind = 'report' OR NOT skip) UNION ALL SELECT kind, size_bytes FROM ({_DORMANT})) SELECT kind, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM s GROUP BY kind")
def cleanup_by_kind(spark, d):
    """A16."""
    return L.scan_all(_files(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query("SELECT 'nation-' || n_nationkey AS path FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)")
def empty_folders(spark, d):
    """L13."""
    folders = table(spark, d, "nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("path"))
    entries = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("nation-"), "c_nationkey").alias("parent"))
    return L.empty_folders(folders, entries)


@query("""SELECT doc_id AS ref, CASE WHEN n_chars < doc_id THEN 0 ELSE doc_id END AS from_, greatest(n_chars - 1, CASE WHEN n_chars < doc_id THEN 0 ELSE doc_id END) AS upto,
  CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars < doc_id THEN 'truncated' WHEN n_chars - 1 > doc_id THEN 'appended' ELSE 'unchanged' END AS status FROM documents""")
def mirror_plan(spark, d):
    """SC13."""
    return raw.mirror_plan(table(spark, d, "documents").select(F.col("doc_id").alias("ref"), F.col("n_chars").alias("size"), (F.col("n_chars") - 1).alias("complete"), F.col("doc_id").alias("offset")))


@query("""SELECT count(*) AS scanned, count(*) FILTER (n_chars - 1 > CASE WHEN n_chars < doc_id THEN 0 ELSE doc_id END AND n_chars >= doc_id AND n_chars > 0) AS appended, count(*) FILTER (n_chars < doc_id AND n_chars > 0) AS truncated, count(*) FILTER (n_chars = 0) AS empty,
  sum(greatest(n_chars - 1, CASE WHEN n_chars < doc_id THEN 0 ELSE doc_id END) - CASE WHEN n_chars < doc_id THEN 0 ELSE doc_id END)::BIGINT AS bytes FROM documents""")
def mirror_totals(spark, d):
    """SC16-SC17."""
    return raw.mirror_totals(mirror_plan(spark, d))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND strpos(text, chr(10)) > 0 THEN strlen(left(text, strpos(text, chr(10)) - 1))::BIGINT + 1 ELSE 0 END AS off FROM documents")
def trusted_offsets(spark, d):
    """SC11, over all documents: the first newline's place in bytes."""
    docs = table(spark, d, "documents")
    nl = F.locate("\n", "text", 1)
    at = F.when(nl > 0, F.octet_length(F.left("text", nl - 1)) + 1).otherwise(F.lit(0))
    off = F.when(F.col("doc_id") % 2 == 0, at).when(F.substring(F.col("text"), nl + 1, F.lit(1)) == "\n", F.lit(0)).otherwise(at + 1)
    return docs.select("doc_id", F.col("text").cast("binary").alias("content"), off.cast("long").alias("offset")).select("doc_id", raw.trusted_offset().alias("off"))


@query("""SELECT doc_id AS ref FROM documents WHERE doc_id * 1000 > 50000 AND doc_id * 1000 <= 900000 - 100000 ORDER BY doc_id LIMIT 100""")
def pending_files(spark, d):
    """SC10, S4: a cycle takes the first hundred."""
    f = table(spark, d, "documents").select(F.col("doc_id").alias("ref"), (F.col("doc_id") * 1000).alias("mtime_us"), F.col("n_chars").alias("size"))
    return raw.pending(f, 50_000, 900_000, 100_000, 100).select("ref")


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') || ' order-' || o_orderkey || '.md' AS name, strftime(o_orderdate, '%Y/%m/%Y-%m-%d') || ' order-' || o_orderkey || '.md' AS target, CASE WHEN o_orderkey % 3 = 0 THEN 'conflict' ELSE 'move' END AS status FROM orders""")
def migration_plan(spark, d):
    """D8, Z35."""
    o = table(spark, d, "orders")
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" order-"), "o_orderkey", F.lit(".md"))
    there = o.where("o_orderkey % 3 = 0").select(F.concat(F.date_format("o_orderdate", "yyyy/MM/"), name).alias("path"))
    return M.migration_plan(o.select(name.alias("name")), there)


@query("""SELECT CASE WHEN doc_id % 4 = 0 THEN 'already_compacted' WHEN doc_id % 4 = 1 THEN 'not_ingested' WHEN doc_id % 4 = 2 THEN 'offset_mismatch' ELSE 'eligible' END AS status, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1""")
def compaction_status(spark, d):
    """J14, A21."""
    k = F.col("doc_id") % 4
    f = table(spark, d, "documents").select(F.lit(5).alias("mtime_us"), F.col("n_chars").alias("size"), F.when(k == 2, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("offset"), F.when(k == 1, F.lit(1)).otherwise(F.lit(9)).alias("watermark_us"), (k == 0).alias("sidecar"), F.col("n_chars").alias("reclaimable"))
    return raw.compaction_totals(raw.compaction_status(f))

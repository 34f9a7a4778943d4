"""Queries over logs as files, pages as files, states that go from run to run, schema checks, and places in groups of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ledger as L
from tessera.operators import lint
from tessera.operators import merge as M
from tessera.operators import timeline as T
from tessera.plans.ledger import _LEDGER, _sightings
from tessera.plans.registry import query
from tessera.session import scratch_path
from tessera.sources import logs, page_sink
from tessera.sources import pages as P
from tessera.sources.star import slug, table
from tessera.streaming import state


@query("""SELECT conv_id, turn, coalesce(role, '') AS role, md5(coalesce(text, '')) AS digest, length(coalesce(text, ''))::BIGINT AS chars FROM conversations""")
def log_lines(spark, d):
    """SC10, SC12, SC14: conversations written as JSON lines and read back in ranges of 64 KB, so that most lines of a file begin in other tasks' ranges."""
    at = scratch_path(spark, "logs")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows.select(F.to_json(F.struct("conv_id", "turn", "role", "text"))).write.text(at)
    lines = logs.read(spark, at, split=1 << 16, pattern=r"part-[^/]*\.txt")
    x = F.from_json(F.col("raw").cast("string"), "conv_id long, turn long, role string, text string")
    return lines.select(x.alias("x")).select("x.conv_id", "x.turn", "x.role", F.md5("x.text").alias("digest"), F.length("x.text").cast("long").alias("chars"))


@query("""WITH r AS (SELECT conv_id, count(*) AS n, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, max(turn) AS last FROM conversations GROUP BY 1) SELECT conv_id, n, bytes FROM r""")
def log_numbers(spark, d):
    """SC12: the lines of each conversation, told from their numbers in the file: the distance from its first line to its last."""
    at = scratch_path(spark, "logs")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select(F.to_json(F.struct("conv_id", "text"))).write.text(at)
    lines = logs.numbered(logs.read(spark, at, split=1 << 16, pattern=r"part-[^/]*\.txt"))
    x = F.from_json(F.col("raw").cast("string"), "conv_id long, text string")
    own = lines.select("ref", "line", x.alias("x")).groupBy("ref", "x.conv_id").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.sum(F.octet_length("x.text")).cast("long").alias("bytes"))
    return own.select("conv_id", (F.col("b") - F.col("a") + 1).alias("n"), "bytes")


@query("""SELECT 'part-' || p_partkey AS slug, p_name AS title, md5(p_brand || ' ' || p_type) AS body FROM part""")
def published_pages(spark, d):
    """SC3, SC4, M15: pages staged, committed, published, and read back with their front matter."""
    p = table(spark, d, "part").select(slug("part", "p_partkey").alias("slug"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("body"))
    text = P.page_text(p.select(F.concat("slug", F.lit(".md")).alias("path"), F.to_json(F.struct("slug", "title")).alias("meta"), "body"))
    at = scratch_path(spark, "vault")
    # a table may be one split, and a page takes far longer to write than a row to read
    tasks = max(spark.sparkContext.defaultParallelism, -(-p.count() // P.TASK_PAGES))
    page_sink.publish(spark, at, page_sink.stage(text.repartition(tasks, "path"), at)).count()
    read = P.front_matter_json(P.split_front_matter(P.read_pages(spark, at)))
    m = F.from_json("meta", "slug string, title string")
    return read.select(m.alias("m"), F.trim(F.regexp_replace("body", r"^\s+", "")).alias("body")).select("m.slug", "m.title", F.md5("body").alias("body"))


_SINCE = 10_000


@query(f"""WITH f AS (SELECT 'order-' || o_orderkey AS rel_path, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS t, o_custkey AS size, o_orderpriority AS sha, o_orderkey AS k, o_orderstatus AS s FROM orders),
b AS (SELECT rel_path, t AS mtime, size, sha FROM f WHERE k % 5 <> 0),
n AS (SELECT rel_path, t + CASE WHEN s = 'O' THEN 1 ELSE 0 END AS mtime, size, CASE WHEN size % 7 = 0 THEN s ELSE sha END AS sha FROM f WHERE k % 11 <> 0)
SELECT n.rel_path, CASE WHEN n.mtime < {_SINCE} OR (n.mtime = b.mtime AND n.size = b.size) THEN b.mtime ELSE n.mtime END AS mtime,
       CASE WHEN n.mtime < {_SINCE} OR (n.mtime = b.mtime AND n.size = b.size) THEN b.sha ELSE n.sha END AS sha,
       CASE WHEN n.mtime < {_SINCE} THEN 'skipped' WHEN b.rel_path IS NULL THEN 'new' WHEN n.mtime = b.mtime AND n.size = b.size THEN 'unchanged' WHEN n.sha = b.sha THEN 'touched' ELSE 'changed' END AS status
FROM n LEFT JOIN b ON n.rel_path = b.rel_path""")
def mirror_states(spark, d):
    """SC18, Z30: orders as files: some new, some gone, some touched, some with other content, those before a day passed over."""
    f = table(spark, d, "orders").select(slug("order", "o_orderkey").alias("rel_path"), F.datediff("o_orderdate", F.lit("1970-01-01")).cast("double").alias("t"), F.col("o_custkey").alias("size"), F.col("o_orderpriority").alias("sha"), "o_orderkey", "o_orderstatus")
    before = f.where("o_orderkey % 5 <> 0").select("rel_path", F.col("t").alias("mtime"), "size", "sha")
    now = f.where("o_orderkey % 11 <> 0").select("rel_path", (F.col("t") + F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("mtime"), "size", F.when(F.col("size") % 7 == 0, F.col("o_orderstatus")).otherwise(F.col("sha")).alias("sha"))
    return M.mirror_next(now, before, _SINCE).select("rel_path", "mtime", "sha", "status")


@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, o_orderdate, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate - INTERVAL 30 DAYS END AS made FROM orders)
SELECT 'order-' || o_orderkey AS card_id, year::INT AS year, quarter::INT AS quarter, row_number() OVER (PARTITION BY year, quarter ORDER BY o_orderdate DESC, made DESC NULLS LAST, 'order-' || o_orderkey) AS place FROM o""")
def quarter_places(spark, d):
    """W2, S1 without a list for each quarter."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    none = F.lit(None).cast("string")
    o = table(spark, d, "orders")
    cards = o.select(
        slug("order", "o_orderkey").alias("card_id"), F.lit("card_project").alias("source_kind"), none.alias("display_name"), F.lit("done").alias("status"), day("o_orderdate").alias("period_end"),
        F.when(F.col("o_orderkey") % 3 > 0, day(F.date_sub("o_orderdate", 30))).alias("created"), none.alias("last_reviewed"), F.lit(0.0).alias("distance"), none.alias("document"),
    )
    return T.quarter_places(T.sort_time(cards, "2026-01-01")).withColumn("place", F.col("place").cast("long"))


_SCHEMA = {"order": {
    "status": {"type": "enum", "values": ["O", "F"], "required": True},
    "lines": {"type": "list", "items": {"type": "object", "fields": {"flag": {"type": "enum", "values": ["A", "N"]}, "note": {"type": "string", "required": True}}}},
}}


@query("""WITH l AS (SELECT l_orderkey, l_returnflag AS flag, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE l_linestatus END AS note, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)
SELECT 'invalid_enum' AS code, 'order-' || o_orderkey AS path, 'status=' || o_orderstatus AS message FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT 'invalid_enum', 'order-' || l_orderkey, 'lines[' || i || '].flag=' || flag FROM l WHERE flag NOT IN ('A', 'N')
UNION ALL SELECT 'missing_required', 'order-' || l_orderkey, 'lines[' || i || '].note' FROM l WHERE note = ''""")
def schema_violations(spark, d):
    """L4: orders with their lines as nested fields, checked by a schema's tree."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag"), F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.col("l_linestatus")).alias("note"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["flag"].alias("flag"), x["note"].alias("note"))).alias("lines"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    pages = o.select(slug("order", "o_orderkey").alias("path"), F.lit("order").alias("type"), F.struct(F.col("o_orderstatus").alias("status"), "lines").alias("attrs"))
    return lint.schema_rules(pages, _SCHEMA)


@query(f"""WITH {_LEDGER} SELECT fingerprint, first_seen, last_seen, seen_count, len(ch)::INT AS kept, round(peak, 6) AS peak, round(mean, 10) AS mean FROM ledger""")
def sighting_state(spark, d):
    """ST6: the ledger's entries as keyed state."""
    s = state.sighting_states(_sightings(spark, d))
    return s.select("fingerprint", "first_seen", "last_seen", "seen_count", F.size("confidence_history").alias("kept"), F.round(L.peak(), 6).alias("peak"), F.round(L.mean(), 10).alias("mean"))


@query("""WITH o AS (SELECT 'user ' || user_id AS ref, event_id AS i, event_type <> 'error' AS ok FROM events),
f AS (SELECT ref, min(a.i) AS dead FROM (SELECT ref, i, NOT ok AND lag(NOT ok) OVER (PARTITION BY ref ORDER BY i) AS two FROM o) a WHERE two GROUP BY ref)
SELECT o.ref, coalesce(max(i) FILTER (ok AND (dead IS NULL OR i < dead)), 0)::BIGINT AS "offset", dead IS NOT NULL AS dead FROM o LEFT JOIN f USING (ref) GROUP BY o.ref, dead""")
def reference_state(spark, d):
    """ST3, M11, M12: offset and dead letter of each reference as keyed state; errors stand for failures, two in a row end it."""
    e = table(spark, d, "events").select(F.concat(F.lit("user "), "user_id").alias("ref"), F.col("event_id").alias("upto"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("ord"), "ts")
    return state.reference_states(e).select("ref", "offset", "dead")


@query("""WITH c AS (SELECT c_mktsegment AS s, c_nationkey AS n, c_custkey AS k, c_acctbal FROM customer), g AS (SELECT s, n, max(c_acctbal) AS peak, count(*) AS seen FROM c GROUP BY 1, 2)
SELECT 'nation ' || n || ' buys ' || lower(s) AS fingerprint, peak >= 9000 AND n % 4 <> 0 AS promoted FROM g""")
def review_marked(spark, d):
    """Awaiting entries of a high peak, without those that are known, marked."""
    c = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.max("c_acctbal").alias("peak"), F.count("*").alias("seen"))
    none = F.array().cast("array<string>")
    entries = c.select(
        F.lit("fact").alias("kind"), F.concat(F.lit("nation "), "c_nationkey", F.lit(" buys "), F.lower("c_mktsegment")).alias("fingerprint"), none.alias("statements"), none.alias("categories"), F.lit("2024-01-01").alias("first_seen"), F.lit("2024-01-02").alias("last_seen"),
        F.col("seen").alias("seen_count"), F.array(F.col("peak") / 10000).alias("confidence_history"), F.lit(False).alias("promoted"), F.lit("").alias("promoted_at"),
    )
    known = c.where("c_nationkey % 4 = 0").select(F.concat(F.lit("Nation "), "c_nationkey", F.lit(" buys "), "c_mktsegment", F.lit(".")).alias("statement"))
    _, after = L.review_marked(entries, known, "2024-01-10", 0.9)
    return after.select("fingerprint", "promoted")

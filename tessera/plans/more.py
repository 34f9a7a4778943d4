"""Queries over cards, links, rules, states and files that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import cards as K
from tessera.operators import cost as C
from tessera.operators import entities as E
from tessera.operators import graph as G
from tessera.operators import ledger as L
from tessera.operators import lint
from tessera.operators import merge as M
from tessera.operators import metrics as R
from tessera.operators import retrieval
from tessera.operators.naming import free_names
from tessera.plans import graph as PG
from tessera.plans import ledger as PL
from tessera.plans import times as PT
from tessera.plans.documents import _FLAT, _codex_lines
from tessera.plans.files import _DORMANT, _FILES, _files
from tessera.plans.registry import query
from tessera.session import scratch_path, ship
from tessera.sources import pages as P
from tessera.sources import raw, star
from tessera.sources.star import slug, table
from tessera.streaming import ingest

_D = "strftime(o_orderdate, '%Y-%m-%d')"


def _none():
    return F.array().cast("array<string>")


def _day(c: str = "o_orderdate"):
    return F.date_format(c, "yyyy-MM-dd")


# -- scans and look-ups


@query("SELECT 'customer-' || c_custkey AS slug, c_name AS title FROM customer WHERE c_custkey = 7")
def point_lookup(spark, d):
    """SC5, SC8: one page by type and slug; a slug with a separator finds nothing."""
    ents = star.entities(spark, d, "customer", "part")
    return E.lookup(ents, "company", "customer-7").unionByName(E.lookup(ents, "company", "../customer-8")).select("slug", "title")


@query("SELECT 'order-' || o_orderkey AS src_slug, 'customer-' || o_custkey AS target, c_name AS title FROM orders JOIN customer ON o_custkey = c_custkey")
def linked_pages(spark, d):
    """J3."""
    return G.resolved(star.edges(spark, d, "related"), star.entities(spark, d, "customer", "supplier")).select("src_slug", "target", "title")


@query("SELECT doc_id, lang = 'en' OR doc_id % 7 = 0 AS excluded FROM documents")
def excluded_paths(spark, d):
    """SC19."""
    path = F.concat_ws("/", "lang", "source", F.concat("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit(".sync-conflict.md")).otherwise(F.lit(".md"))))
    return table(spark, d, "documents").withColumn("rel_path", path).select("doc_id", raw.is_excluded("rel_path", ("en",)).alias("excluded"))


@query("""WITH b AS (SELECT user_id, min(event_id) FILTER (event_type = 'error') AS f FROM events GROUP BY 1)
SELECT CASE WHEN f IS NULL OR event_id < f THEN 'good' ELSE 'tail' END AS part, user_id AS file, event_id AS line FROM events JOIN b USING (user_id)""")
def event_log_prefix(spark, d):
    """SC20-SC21, Z21: a log up to its first bad line, and its tail."""
    value = F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("value").alias("v"))))
    lines = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), value.alias("value"))
    good, tail = C.good_prefix(lines, "v double")
    return good.select(F.lit("good").alias("part"), "file", "line").unionByName(tail.select(F.lit("tail").alias("part"), "file", "line"))


@query("SELECT event_id, round(value, 4) AS usd FROM events")
def cost_appended(spark, d):
    """SC22-SC23: two appends to one log, read again."""
    at = scratch_path(spark, "cost-log")
    e = table(spark, d, "events").select("event_id", F.round("value", 4).alias("usd"), "event_type")
    for part in (e.where("event_type = 'click'"), e.where("event_type <> 'click'")):
        C.append(part.drop("event_type"), at)
    return spark.read.schema("event_id long, usd double").json(at)


@query(f"WITH {PL._LEDGER} SELECT fingerprint, seen_count, last_seen FROM ledger")
def ledger_saved(spark, d):
    """SC25: a full rewrite, read again."""
    at = scratch_path(spark, "ledger")
    L.save(PL._ledger(spark, d).select("kind", "fingerprint", "seen_count", "last_seen"), at)
    return spark.read.schema("fingerprint string, seen_count long, last_seen string").json(at)


_CUT = "CASE WHEN length(f) > 400 THEN left(f, 400) || '…' ELSE f END"


@query(f"""WITH t AS (SELECT conv_id, turn, {_FLAT.format("text")} AS f FROM conversations)
SELECT conv_id, turn, '[codex] ' || {_CUT} AS text FROM t WHERE f <> '' ORDER BY conv_id DESC, turn DESC LIMIT 200""")
def codex_history_tail(spark, d):
    """SC27: the last 200 lines (the tail is the feature)."""
    lines = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("line"), F.to_json(F.struct("text")).alias("raw"))
    return raw.history_tail(lines, 200, "codex").select("line.conv_id", "line.turn", "text")


@query(f"""WITH f AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY conv_id DESC LIMIT 10),
t AS (SELECT conv_id, turn, {_FLAT.format("text")} AS f FROM conversations WHERE role = 'user' AND conv_id IN (SELECT conv_id FROM f))
SELECT row_number() OVER (ORDER BY conv_id DESC, turn) AS rank, '[codex-session] ' || {_CUT} AS text FROM t WHERE f <> '' AND NOT starts_with(f, '# AGENTS.md') QUALIFY rank <= 50""")
def session_tail(spark, d):
    """SC28: user messages of the ten newest files, 50 in all (the tail is the feature)."""
    c = table(spark, d, "conversations")
    said = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("input_text").alias("type"), "text")).alias("content")).alias("payload")))
    files = c.select(F.col("conv_id").alias("ref"), (F.col("conv_id") * 1000).alias("mtime_us")).distinct()
    out = raw.session_tail(c.select(F.col("conv_id").alias("ref"), F.col("turn").alias("line"), said.alias("raw")), files, 50)
    return out.select(F.col("rank").cast("long").alias("rank"), "text")


@query("""WITH t AS (SELECT doc_id, 'f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' ELSE '.MARKDOWN' END AS path, CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE text END AS c FROM documents)
SELECT path, left(sha256(c), 16) AS sha, CASE WHEN doc_id % 4 = 2 THEN 'unsupported' WHEN doc_id % 10 = 0 OR trim(c) = '' THEN 'empty' ELSE 'taken' END AS status FROM t""")
def external_files(spark, d):
    """SC29."""
    k = F.col("doc_id")
    end = F.when(k % 4 == 0, F.lit(".md")).when(k % 4 == 1, F.lit(".txt")).when(k % 4 == 2, F.lit(".pdf")).otherwise(F.lit(".MARKDOWN"))
    content = F.when(k % 10 == 0, F.lit("  ")).otherwise(F.col("text")).cast("binary")
    return raw.ingest_files(table(spark, d, "documents").select(F.concat(F.lit("f"), k, end).alias("path"), content.alias("content"))).select("path", "sha", "status")


@query("""SELECT conv_id AS ref, CASE WHEN conv_id % 5 = 0 THEN 'header_mismatch' ELSE 'rehydrated' END AS status, CASE WHEN conv_id % 5 <> 0 THEN count(*) ELSE 0 END AS lines FROM conversations GROUP BY 1""")
def rehydrated_files(spark, d):
    """SC30, Z32: files are split, and put together again where the sidecar's header fits."""
    c = _codex_lines(spark, d).withColumn("line", F.row_number().over(Window.partitionBy("ref").orderBy("line")) - 1)
    kept, dropped = raw.compacted(c, "codex")
    kept = kept.select("ref", (F.row_number().over(Window.partitionBy("ref").orderBy("line")) - 1).alias("pos"), "raw")
    headers = c.select("ref").distinct().select("ref", F.when(F.col("ref") % 5 == 0, F.lit("claude-code")).otherwise(F.lit("codex")).alias("source"), F.col("ref").alias("header_ref"))
    lines, status = raw.rehydrated_files(kept, dropped, headers, "codex")
    n = lines.groupBy("ref").agg(F.count("*").alias("lines"))
    return status.join(n, "ref", "left").select("ref", "status", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"))


@query("""SELECT '/w/' || c_custkey AS path, c_mktsegment AS target, CASE WHEN c_custkey % 3 = 0 THEN 'paused' ELSE 'active' END AS state FROM customer WHERE c_custkey % 4 <> 0""")
def registry_rows(spark, d):
    """SC34: registries read; entries without a path or target are left out."""
    k = F.col("c_custkey")
    entry = F.struct(F.when(k % 4 != 0, F.concat(F.lit("/w/"), k)).alias("path"), F.col("c_mktsegment").alias("target"), F.lit("2026-01-01").alias("registered_at"), F.when(k % 3 == 0, F.lit("paused")).alias("state"))
    texts = table(spark, d, "customer").select(F.to_json(F.struct(F.lit(1).alias("version"), F.array(entry).alias("projects"))).alias("text"))
    return K.registry_rows(texts).select("path", "target", "state")


@query("""WITH b AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'Bad-' ELSE 'r_' END || p_partkey AS name, 'b' AS d, p_partkey AS k FROM part UNION ALL SELECT CASE WHEN p_partkey % 5 = 0 THEN 'Bad-' ELSE 'r_' END || p_partkey, 'u', p_partkey FROM part WHERE p_partkey % 3 = 0)
SELECT name, max(d) AS description, NULL::VARCHAR AS refused FROM b WHERE k % 5 <> 0 GROUP BY name UNION ALL SELECT name, NULL, 'name' FROM b WHERE k % 5 = 0""")
def recipes(spark, d):
    """SC35-SC36: the user's recipe stands over the built-in one of its name; refused ones are told."""
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 5 == 0, F.lit("Bad-")).otherwise(F.lit("r_")), k)
    rows = lambda df, what: df.select(name.alias("name"), F.lit(what).alias("description"), F.lit("p").alias("system_prompt"), F.lit(8).alias("rag_top_k"), F.lit(120).alias("timeout"))
    part = table(spark, d, "part")
    good, refused = K.recipe_scan(rows(part, "b"), rows(part.where(k % 3 == 0), "u"))
    return good.select("name", "description", F.lit(None).cast("string").alias("refused")).unionByName(refused.select("name", F.lit(None).cast("string").alias("description"), "refused"))


# -- cards


@query("SELECT 'part-' || p_partkey AS slug FROM part WHERE p_partkey % 4 = 1")
def concepts_of_kind(spark, d):
    """FP2."""
    kind = F.get(F.array(*[F.lit(k) for k in ("technology", "tool", "algorithm", "methodology")]), (F.col("p_partkey") % 4).cast("int"))
    rows = table(spark, d, "part").select(F.lit("concept").alias("type"), slug("part", "p_partkey").alias("slug"), F.struct(kind.alias("kind")).alias("attrs"))
    return E.of_kind(rows, "tool").select("slug")


@query("""SELECT 'customer-' || c_custkey AS slug, c_name AS display_name, 'card_' || CASE WHEN c_custkey % 2 = 0 THEN 'project' ELSE 'company' END AS source_kind, CASE WHEN c_custkey % 2 = 0 THEN '2024-01' END AS period_end, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 4 END AS fields FROM customer""")
def card_metadata(spark, d):
    """FP11."""
    attrs = F.struct(F.lit("").alias("period_start"), F.lit("2024-01").alias("period_end"), F.lit(None).cast("string").alias("last_reviewed"))
    kind = F.when(F.col("c_custkey") % 2 == 0, F.lit("project")).otherwise(F.lit("company"))
    rows = table(spark, d, "customer").select(kind.alias("type"), slug("customer", "c_custkey").alias("slug"), F.col("c_name").alias("title"), F.lit("active").alias("status"), F.lit("").alias("created"), attrs.alias("attrs"))
    m = rows.select("slug", E.metadata().alias("m"))
    return m.select("slug", F.col("m")["display_name"].alias("display_name"), F.col("m")["source_kind"].alias("source_kind"), F.col("m")["period_end"].alias("period_end"), F.size("m").alias("fields"))


def _full_companies(spark, d):
    """Companies with every kind of attribute: texts, lists, nested rows."""
    k = F.col("c_custkey")
    made = {
        "size": F.lit("small"), "domains": F.array(F.lit("retail"), F.col("c_mktsegment")), "notes": F.when(k % 2 == 0, F.lit("note")),
        "positions": F.array(F.struct(F.lit("Engineer").alias("title"), F.lit("senior").alias("seniority"), F.array(F.lit("spark")).alias("keywords"), F.lit(None).cast("string").alias("jd_url"))),
    }
    from tessera.operators import vocabulary as V

    attrs = F.struct(*[(made[f.name] if f.name in made else F.lit(None)).cast(f.dataType).alias(f.name) for f in V.ATTRS.fields])
    return table(spark, d, "customer").select(
        slug("customer", "c_custkey").alias("slug"), F.col("c_name").alias("title"), F.lit("company").alias("type"), F.lit("target").alias("status"), *[F.lit("").alias(c) for c in ("created", "updated", "observed_at", "t_invalid")],
        _none().alias("sources"), F.array(F.lit("nation-1")).alias("related"), *[(F.array(slug("nation", "c_nationkey")) if r == "part_of" else _none()).alias(r) for r in V.RELATIONS], attrs.alias("attrs"), F.col("c_mktsegment").alias("body"),
    )


@query("""SELECT 'customer-' || c_custkey AS slug, c_name || chr(10) || 'type: company' || chr(10) || 'status: target' || chr(10) || 'domains: retail, ' || c_mktsegment || chr(10) || 'size: small' || chr(10) || 'positions: Engineer senior spark' || chr(10) || c_mktsegment AS text,
  c_name || ' Engineer senior spark ' || CASE WHEN c_custkey % 2 = 0 THEN 'note ' ELSE '' END || c_mktsegment AS matched_by FROM customer""")
def labelled_texts(spark, d):
    """FP12-FP13, Z8, Z12."""
    return _full_companies(spark, d).select("slug", E.labelled_text().alias("text"), E.company_query().alias("matched_by"))


@query("""SELECT 'customer-' || c_custkey AS slug, c_name AS title, 'target' AS status, 'small' AS size, 'retail,' || c_mktsegment AS domains, CASE WHEN c_custkey % 2 = 0 THEN 'note' END AS notes, 'Engineer' AS position, 'nation-' || c_nationkey AS part_of, 'nation-1' AS related, c_mktsegment AS body FROM customer""")
def entities_from_pages(spark, d):
    """SC1, SC3, Z9-Z10: entities written as pages with all their attributes, and read again."""
    text = P.page_text(E.front_matter(_full_companies(spark, d)).select(F.col("slug").alias("path"), "meta", "body"))
    # companies are short rows, so a few splits hold them all: dealt out, their pages are read by all tasks
    back = E.from_front_matter(P.front_matter_json(P.split_front_matter(text.select("path", "text").repartition("path"))))
    return back.select("slug", "title", "status", "attrs.size", F.array_join("attrs.domains", ",").alias("domains"), "attrs.notes", F.col("attrs.positions")[0]["title"].alias("position"), F.array_join("part_of", ",").alias("part_of"), F.array_join("related", ",").alias("related"), F.regexp_replace("body", r"\A\n+", "").alias("body"))


@query("SELECT 'customer-' || c_custkey AS slug, c_name AS title, 'company' AS type FROM customer WHERE c_custkey % 9 <> 0")
def legacy_cards(spark, d):
    """Z1-Z3."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.when(k % 9 != 0, slug("customer", "c_custkey")).alias("company_id"), F.col("c_name").alias("display_name"), F.array(F.struct(F.lit("").alias("name"))).alias("metrics"))
    return E.legacy(rows, "company").where(F.size("metrics") == 0).select("slug", "title", "type")


@query("""SELECT 'order-' || o_orderkey AS slug, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders""")
def insight_list(spark, d):
    """The list by created and id."""
    rows = star.entities(spark, d, "orders").withColumn("type", F.lit("insight"))
    return E.insights(rows).select("slug", "created")


_OWN = "lower(c_mktsegment) || CASE WHEN c_custkey % 4 = 0 THEN '-' || (c_custkey % 7 + 1) WHEN c_custkey % 19 = 0 THEN '-2-3' ELSE '' END"


@query(f"""WITH RECURSIVE r AS (SELECT c_nationkey AS dir, {_OWN} AS s, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
t AS (SELECT c_nationkey AS dir, list(DISTINCT lower(c_mktsegment) || '-' || c_custkey % 9) AS taken FROM customer WHERE c_acctbal < 0 GROUP BY 1),
f AS (SELECT dir, 0::BIGINT AS i, coalesce(taken, []) AS taken, NULL::BIGINT AS k, NULL::VARCHAR AS slug FROM (SELECT DISTINCT dir FROM r) LEFT JOIN t USING (dir)
      UNION ALL SELECT dir, i, list_append(taken, slug), k, slug
      FROM (SELECT f.dir, r.i, taken, r.k, CASE WHEN list_contains(taken, s) THEN s || '-' || list_filter(range(2, len(taken) + 3), lambda n: NOT list_contains(taken, s || '-' || n))[1] ELSE s END AS slug FROM f JOIN r ON r.dir = f.dir AND r.i = f.i + 1))
SELECT k AS c_custkey, slug FROM f WHERE k IS NOT NULL""")
def unique_slugs(spark, d):
    """Names of a folder (a nation) that clash with stored ones, with each other, and with numbers that others carry."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("dir"), "c_custkey", "c_acctbal", F.lower("c_mktsegment").alias("own"))
    end = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("-"), F.col("c_custkey") % 7 + 1)).when(F.col("c_custkey") % 19 == 0, F.lit("-2-3")).otherwise(F.lit(""))
    stored = c.where("c_acctbal < 0").select("dir", F.concat("own", F.lit("-"), F.col("c_custkey") % 9).alias("slug"))
    return free_names(c.select("dir", "c_custkey", F.concat("own", end).alias("slug")), stored, order="c_custkey", scope="dir").select("c_custkey", "slug")


@query("""SELECT '2026-05-12-why-order-' || o_orderkey AS slug, 'Why order ' || o_orderkey AS title, '[[customer-' || o_custkey || ']]' AS related, 'because ' || o_orderpriority AS body FROM orders""")
def insight_write_back(spark, d):
    """M15, X6, X19."""
    o = table(spark, d, "orders")
    a = o.select(F.concat(F.lit("Why order "), "o_orderkey").alias("question"), F.concat(F.lit("Note: n\n\nAnalysis: x\nbecause "), "o_orderpriority").alias("answer"), F.array(slug("customer", "o_custkey")).alias("sources"))
    return K.write_back(a, "2026-05-12").select("slug", "title", F.array_join("related", ",").alias("related"), "body")


# -- links and selections


@query("SELECT o_orderkey AS query, 'customer-' || o_custkey AS slug, 1::BIGINT AS rank FROM orders UNION ALL SELECT o_orderkey, 'nation-1', 2 FROM orders")
def selected_pages(spark, d):
    """A selector's ids, those there are, once each, the first two."""
    ids = F.array(F.lit("nope"), slug("customer", "o_custkey"), slug("customer", "o_custkey"), F.lit("nation-1"), F.lit("region-0"))
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("query"), ids.alias("selected"))
    return retrieval.selected(q, star.entities(spark, d, "customer", "nation", "region"), 2).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT o_custkey AS query, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank, 'order-' || o_orderkey AS slug FROM orders QUALIFY rank <= 12""")
def history_of_chosen(spark, d):
    """A customer's newest order and what it supersedes, cut at twelve."""
    newest = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("k"))
    chosen = newest.select(F.col("o_custkey").alias("query"), F.lit(1).alias("rank"), slug("order", "k").alias("slug"))
    return retrieval.with_history(chosen, star.edges(spark, d, "supersedes"), star.entities(spark, d, "orders")).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey = 1 THEN '[[customer-1|one]]' ELSE '[[customer-1|one]],[[customer-' || o_custkey || ']]' END AS related FROM orders""")
def links_added(spark, d):
    """G7."""
    link = F.concat(F.lit("[["), slug("customer", "o_custkey"), F.lit("]]"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(G.with_link(F.array(F.lit("[[customer-1|one]]")), link), ",").alias("related"))


@query("""SELECT 'order-' || o_orderkey AS slug, CASE WHEN c_acctbal > 0 THEN '[[customer-' || o_custkey || ']]' ELSE '' END AS related FROM orders JOIN customer ON o_custkey = c_custkey""")
def dead_links_removed(spark, d):
    """M4: applied twice, which changes nothing further."""
    links = F.array(F.lit("[[nope]]"), F.concat(F.lit("[["), slug("customer", "o_custkey"), F.lit("]]")))
    rows = table(spark, d, "orders").select(F.lit("log").alias("type"), slug("order", "o_orderkey").alias("slug"), links.alias("related"))
    pages = table(spark, d, "customer").where("c_acctbal > 0").select(slug("customer", "c_custkey").alias("slug"))
    return G.without_dead_links(G.without_dead_links(rows, pages), pages).select("slug", F.array_join("related", ",").alias("related"))


@query("""SELECT o_orderkey, 'customer-' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ',nation-1' ELSE '' END AS related FROM orders""")
def about_folded(spark, d):
    """D7."""
    c = slug("customer", "o_custkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.array(c).alias("related"), F.when(F.col("o_orderkey") % 2 == 0, F.array(c, F.lit("nation-1"))).alias("about"))
    return M.fold_about(rows).select("o_orderkey", F.array_join("related", ",").alias("related"))


# -- operations and ledger


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'codex:x' ELSE 'log:1,codex:x' END AS sources FROM orders")
def stamped_sources(spark, d):
    """M13."""
    had = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("codex:x"))).otherwise(F.array(F.lit("log:1")))
    return M.stamp_sources(table(spark, d, "orders").select("o_orderkey", had.alias("sources")), "codex:x").select("o_orderkey", F.array_join("sources", ",").alias("sources"))


@query("""SELECT 0 AS op_ord, 'create' AS op, 's-' || event_id AS slug, 'related dropped' AS warning, 0 AS n FROM events UNION ALL SELECT 2, 'update', 'l-' || event_id, NULL, 1 FROM events""")
def parsed_ops(spark, d):
    """M14."""
    op = lambda name, kind, key, link: F.struct(F.lit(name).alias("op"), F.lit(kind).alias("type"), F.concat(F.lit(key), "event_id").alias("slug"), F.lit("t").alias("title"), F.array(F.lit(link)).alias("related"))
    payload = F.to_json(F.array(op("create", "concept", "s-", "x"), op("drop", "log", "z-", "x"), op("update", "log", "l-", "y")))
    return M.parse_ops(table(spark, d, "events").select(payload.alias("payload"))).select("op_ord", "op", "slug", "warning", F.size("related").alias("n"))


@query("SELECT 'part-' || p_partkey AS slug, 'algorithm' AS kind FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0")
def kind_backfill(spark, d):
    """M5: concepts that have a kind, or whose words tell none, are left as they are."""
    k = F.col("p_partkey")
    attrs = F.struct(F.when(k % 3 == 0, F.lit("tool")).alias("kind"), F.array(F.lit("x")).alias("keywords"))
    rows = table(spark, d, "part").select(F.lit("concept").alias("type"), slug("part", "p_partkey").alias("slug"), F.lit("t").alias("title"), attrs.alias("attrs"), F.when(k % 2 == 0, F.lit("a sorting algorithm")).otherwise(F.lit("nothing")).alias("body"))
    return R.kind_updates(rows).select("slug", "kind")


@query(f"""WITH {PL._LEDGER}, t AS (SELECT fingerprint, max(confidence) AS c FROM s WHERE day = '{PL.TODAY}' GROUP BY 1),
p AS (SELECT fingerprint, (seen_count >= 3 AND date_diff('day', last_seen::DATE, DATE '{PL.TODAY}') BETWEEN 0 AND 14) OR coalesce(c, 0) >= 0.9 AS promoted FROM ledger LEFT JOIN t USING (fingerprint))
SELECT fingerprint, promoted, CASE WHEN promoted THEN '{PL.TODAY}' ELSE '' END AS promoted_at FROM p""")
def marked_promoted(spark, d):
    """M6."""
    now = PL._sightings(spark, d).where(F.col("day") == PL.TODAY).select("kind", "fingerprint", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    return L.mark_promoted(L.promote(PL._ledger(spark, d), now, PL.TODAY), PL.TODAY).select("fingerprint", "promoted", "promoted_at")


@query(f"""WITH {PL._LEDGER}, t AS (SELECT fingerprint, max(confidence) AS c FROM s WHERE day = '{PL.TODAY}' GROUP BY 1),
u AS (SELECT fingerprint, min(day) AS f, max(day) AS l, count(*) AS n, max(split_part(fingerprint, ' of ', 2)::BIGINT) AS user FROM s WHERE day <= '{PL.TODAY}' GROUP BY 1)
SELECT u.fingerprint FROM u LEFT JOIN t USING (fingerprint) WHERE ((n >= 3 AND date_diff('day', l::DATE, DATE '{PL.TODAY}') BETWEEN 0 AND 14) OR coalesce(c, 0) >= 0.9) AND user % 2 <> 0""")
def candidate_gate(spark, d):
    """today's sightings recorded in the ledger of the days before, promoted, and held against what is known."""
    s = PL._sightings(spark, d).withColumn("statement", F.col("fingerprint")).where(F.col("day") <= PL.TODAY)
    old = L.accumulate(s.where(F.col("day") < PL.TODAY)).withColumns({"promoted": F.lit(False), "promoted_at": F.lit("")})
    today = s.where(F.col("day") == PL.TODAY).select(F.col("ord").alias("cand"), "kind", "statement", "confidence", "category", "ord")
    known = table(spark, d, "events").where("user_id % 2 = 0").select(F.concat_ws(" of ", "event_type", "user_id").alias("statement")).distinct()
    return L.gate(today, old, known, PL.TODAY).select("fingerprint")


@query(f"WITH {PL._DISMISSED} SELECT fingerprint, reason FROM r WHERE reason IN ('misclassified', 'irrelevant')")
def strong_exclusions(spark, d):
    """D4."""
    return L.strong(PL._dismissed(spark, d)).select("fingerprint", "reason")


@query(f"""WITH {PL._LEDGER} SELECT fingerprint, 'one_time' AS reason FROM ledger WHERE peak >= 0.8 AND date_diff('day', last_seen::DATE, DATE '{PL.TODAY}') BETWEEN 0 AND 14""")
def review_dismissed(spark, d):
    """What a review shows is dismissed."""
    new = L.review(PL._ledger(spark, d), PL.TODAY, 0.8).select("kind", "fingerprint", F.lit(PL.TODAY).alias("dismissed_at"), F.lit("one_time").alias("reason"), F.lit(0).alias("ord"))
    return L.dismiss(new.drop("ord").where("false"), new).select("fingerprint", "reason")


@query(f"""WITH {PL._LEDGER} SELECT fingerprint, date_diff('day', first_seen::DATE, last_seen::DATE) || ' days, seen ' || seen_count || ', peak ' || round(peak::DECIMAL(18, 6), 2)::DECIMAL(9, 2) || ', mean ' || round(mean::DECIMAL(18, 9), 2)::DECIMAL(9, 2) AS suffix FROM ledger""")
def ledger_suffixes(spark, d):
    """Z29."""
    return PL._ledger(spark, d).select("fingerprint", L.suffix().alias("suffix"))


# -- scalar functions


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 2048 THEN text ELSE left(text, (len(list_filter(range(0, 2045), lambda k: strlen(left(text, k::INT)) <= 2044)) - 1)::INT) || chr(10) || '…' END AS clipped FROM documents""")
def bytes_clipped(spark, d):
    """At most 2,048 bytes, never inside a character."""
    return table(spark, d, "documents").select("doc_id", X.clip_utf8("text").alias("clipped"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"category":"rate_limit","message":"slow down user ' || user_id || '","provider":"p","status":"429"}' ELSE 'Error: plain text ' || user_id END AS summary FROM events""".replace('"429"', "429"))
def error_summaries(spark, d):
    """X15."""
    u = F.col("user_id")
    t = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('HTTP status 429: {"error":{"type":"rate_limit","message":"slow down user '), u, F.lit('"},"provider":"p"}'))).otherwise(F.concat(F.lit("plain  text "), u))
    return table(spark, d, "events").select("event_id", X.error_summary(t).alias("summary"))


@query("""SELECT event_id, '{"k": [' || event_id || ', "}"]}' AS value, '{"a": ' || event_id || '}' AS inside, 'body ' || event_id AS answer FROM events""")
def answers_unwrapped(spark, d):
    """X16-X17, X19."""
    ship(spark)
    k = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", X.first_json_value(F.concat(F.lit('noise {"k": ['), k, F.lit(', "}"]} and {more}'))).alias("value"), X.strip_fence(F.concat(F.lit('```json\n{"a": '), k, F.lit("}\n```\n"))).alias("inside"),
        X.strip_preamble(F.concat(F.lit("Note: one\n\nInsight: two\nbody "), k)).alias("answer"),
    )


@query("SELECT o_orderkey, floor((epoch(TIMESTAMP '1999-01-01 12:00:00') - epoch(o_orderdate)) / 86400)::BIGINT AS age FROM orders")
def file_ages(spark, d):
    """X23."""
    return table(spark, d, "orders").select("o_orderkey", X.age_days(F.lit("1999-01-01 12:00:00"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("age"))


@query(f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'made' WHEN 1 THEN 'told' WHEN 2 THEN {_D} ELSE '' END AS created FROM orders")
def created_times(spark, d):
    """X27."""
    k = F.col("o_orderkey") % 4
    src = F.array(F.lit("log"), F.when(k == 2, F.concat(F.lit("codex:"), _day(), F.lit("/x"))).otherwise(F.lit("none")))
    return table(spark, d, "orders").select("o_orderkey", X.created_from(F.when(k == 0, F.lit("made")), F.when(k == 1, F.lit("told")), src).alias("created"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'head' || chr(10) || '<!--s-->' || chr(10) || o_orderkey || chr(10) || '<!--e-->' || chr(10) || 'tail' ELSE 'plain' || chr(10) || chr(10) || '<!--s-->' || chr(10) || o_orderkey || chr(10) || '<!--e-->' || chr(10) END AS text FROM orders""")
def marker_blocks(spark, d):
    """X28."""
    t = F.when(F.col("o_orderkey") % 2 == 0, F.lit("head\n<!--s-->\nold\nold\n<!--e-->\ntail")).otherwise(F.lit("plain\n"))
    return table(spark, d, "orders").select("o_orderkey", X.replace_block(t, F.col("o_orderkey").cast("string"), "<!--s-->", "<!--e-->").alias("text"))


# -- rules, cleanup and reports


_COMPANY_PATH = "'Entities/Companies/customer-' || c_custkey || '.md'"
_LINT = f"""SELECT 'frontmatter_parse' AS code, 'broken/' || c_custkey || '.md' AS path, 'no front matter' AS message FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT 'invalid_enum', {_COMPANY_PATH}, 'size=huge' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'invalid_enum', {_COMPANY_PATH}, 'status=draft' FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'missing_required', {_COMPANY_PATH}, 'positions[1].title' FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'relation_target_missing', {_COMPANY_PATH}, 'part_of nation-' || c_nationkey FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'index_stale', '', 'total=7 found=' || (count(*) + count(*) FILTER (c_custkey % 11 = 0)) FROM customer"""


@query(_LINT)
def full_lint(spark, d):
    """Dead links are removed first, so no company is left with related links only; then every rule."""
    rows = E.load_order(PG._companies(spark, d))
    faults = table(spark, d, "customer").where("c_custkey % 11 = 0").select(F.concat(F.lit("broken/"), "c_custkey", F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("meta"))
    return lint.full_lint(rows, faults, spark.createDataFrame([(7,)], "total long"))


@query(f"""WITH {_FILES} SELECT kind || '_stale' AS kind, path, age_days, size_bytes FROM f WHERE kind <> 'project' AND age_days >= CASE kind WHEN 'inbox' THEN 30 WHEN 'memory_inbox' THEN 60 ELSE 90 END AND (kind = 'report' OR NOT skip) UNION ALL {_DORMANT}
UNION ALL SELECT 'empty_card', {_COMPANY_PATH}, NULL, 3 FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 4 <> 0 AND c_custkey % 7 <> 0
UNION ALL SELECT 'empty_folder', 'nation-' || n_nationkey, NULL, 0 FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)""")
def full_cleanup_scan(spark, d):
    """All seven scans."""
    cards = PG._companies(spark, d).withColumns({"size_bytes": F.lit(3).cast("long"), "pinned": F.regexp_extract("slug", r"(\d+)", 1).cast("long") % 7 == 0, "cleanup": F.lit("")})
    folders = table(spark, d, "nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("path"))
    entries = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("nation-"), "c_nationkey").alias("parent"))
    return lint.scan_all(_files(spark, d), cards, folders, entries)


@query("""WITH t AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'Profile/' ELSE 'Inbox/' END || o_orderkey AS path, o_totalprice::BIGINT AS b FROM orders)
SELECT path LIKE 'Profile/%' AS protected, CASE WHEN path LIKE 'Profile/%' THEN 'protected' ELSE 'moved' END AS status, count(*) AS files, sum(b)::BIGINT AS bytes, min('99_Archive/_cleanup-2026-05-12/' || path) AS first_target FROM t GROUP BY 1, 2""")
def cleanup_manifest(spark, d):
    """FP15, M18, Z33-Z34."""
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(F.concat(F.when(k % 10 == 0, F.lit("Profile/")).otherwise(F.lit("Inbox/")), k).alias("path"), F.bround("o_totalprice").cast("long").alias("size_bytes"))
    done = lint.cleanup_status(c, dry_run=False).withColumns({"target": lint.archive_path("2026-05-12"), "protected": lint.protected()})
    return lint.manifest(done, ("protected",))


@query("SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 4 = 0 AS skipped FROM customer")
def skip_marks(spark, d):
    """FP16."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, F.lit(True)).alias("pinned"), F.when(k % 4 == 0, F.lit("SKIP")).alias("cleanup")).select("c_custkey", lint.skipped().alias("skipped"))


@query(f"""WITH {_FILES}, a AS (SELECT count(*) AS cards, count(*) FILTER (c_custkey % 5 = 0) AS drafts, count(*) FILTER (c_custkey % 5 = 0 AND c_custkey % 4 <> 0) AS empty_companies FROM customer),
b AS (SELECT count(*) FILTER (kind = 'inbox') AS inbox, count(*) FILTER (kind = 'inbox' AND age_days >= 30) AS inbox_stale FROM f) SELECT * FROM a, b""")
def assistant_counters(spark, d):
    """A17."""
    return lint.status_counts(PG._companies(spark, d), _files(spark, d))


@query("""SELECT c_custkey % 7 AS k, max(o_orderdate)::DATE::VARCHAR AS last, max(o_orderdate) < TIMESTAMP '1999-01-01' - INTERVAL 7 DAYS AS stale FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def watermark_freshness(spark, d):
    """L15."""
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") % 7).alias("k")).agg(F.max("o_orderdate").alias("t"))
    w = o.select("k", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("t", "yyyy-MM-dd").alias("last"))
    return lint.freshness(w, "1999-01-01").select("k", "last", "stale")


@query("""SELECT event_id AS line, 'token=<redacted> ' || props AS text FROM events WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-24 12:00:00' AND TIMESTAMP '2024-01-25 12:00:00' ORDER BY ts DESC, event_id DESC LIMIT 3""")
def recent_errors(spark, d):
    """The last three errors of a day (the limit is the report's)."""
    lines = table(spark, d, "events").where("event_type = 'error'").select("ts", F.col("event_id").alias("line"), F.concat(F.lit("token=abc "), "props").alias("text"))
    return lint.error_tail(lines, "2024-01-25 12:00:00").select("line", "text")


@query("""WITH t AS (SELECT c_custkey AS k FROM customer),
a AS (SELECT CASE WHEN k % 3 = 0 THEN concat_ws(',', CASE WHEN k % 2 <> 0 THEN 'fix' END, 'vault') ELSE concat_ws(',', CASE WHEN k % 2 <> 0 THEN 'fix' END, CASE WHEN k % 4 > 0 THEN 'review' END, CASE WHEN k % 5 > 0 THEN 'drafts' END, CASE WHEN k % 7 > 0 THEN 'companies' END, CASE WHEN k % 6 <> 0 THEN 'daily' END, CASE WHEN k % 3 > 1 THEN 'cleanup' END) END AS actions FROM t)
SELECT CASE WHEN actions = '' THEN 'none' ELSE actions END AS actions, count(*) AS n FROM a GROUP BY 1""")
def next_actions(spark, d):
    """S9."""
    k = F.col("c_custkey")
    s = table(spark, d, "customer").select((k % 2 == 0).alias("doctor_ok"), F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("v")).alias("vault_path"), (k % 4).alias("inbox"), (k % 5).alias("drafts"), (k % 7).alias("empty_companies"), F.when(k % 6 == 0, F.lit("done")).otherwise(F.lit("x")).alias("last_daily_state"), (k % 3 - 1).alias("cleanup"))
    return K.recommendations(s).groupBy(F.array_join("actions", ",").alias("actions")).agg(F.count("*").alias("n"))


_SUM = PT._summary("command")


@query(f"""SELECT printf('%-20s %8d %12d %12d %14.8f %12.4f', "group", calls, input_tokens, output_tokens, usd, elapsed_s) AS line FROM ({_SUM})""")
def cost_lines(spark, d):
    """Z22."""
    return C.summarize(PT._cost(spark, d), PT.NOW, 10).select(C.table_line().alias("line"))


@query("SELECT round(coalesce(sum(round(value, 4)), 0), 4) AS usd FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-21'")
def cost_of_a_day(spark, d):
    """Z23."""
    return C.of_day(PT._cost(spark, d), "2024-01-20").select(F.round("usd", 4).alias("usd"))


@query("""WITH m AS (SELECT count(*) AS n, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem)) AS t FROM part) SELECT printf('%.1f%%', t * 100.0 / n) AS typed FROM m""")
def metric_percents(spark, d):
    """Z38."""
    return R.relation_metrics(star.entities(spark, d, "part"), star.edges(spark, d, "uses")).select(R.percent("coverage").alias("typed"))


# -- states of an incremental ingest


@query("""WITH b AS (SELECT user_id AS batch, count(*) AS docs, count(*) FILTER (event_type = 'click') AS pages, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1), s AS (SELECT min(batch) AS s FROM b WHERE errors >= docs)
SELECT count(*) AS batches, sum(docs)::BIGINT AS docs, sum(pages)::BIGINT AS pages, sum(errors)::BIGINT AS errors, max(s) IS NOT NULL AS stopped FROM b, s WHERE s IS NULL OR batch <= s""")
def backfill_totals(spark, d):
    """Batches up to the first in which all documents fail."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("batch")).agg(F.count("*").alias("docs"), F.count_if(F.col("event_type") == "click").alias("pages"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return R.backfill(e)


@query("""SELECT doc_id AS ref, CASE WHEN doc_id % 3 = 0 AND strpos(text, chr(10)) > 0 THEN strlen(left(text, strpos(text, chr(10)) - 1)) + 1 ELSE 0 END AS from_,
  strlen(text) - strlen(list_extract(string_split(text, chr(10)), -1)) AS upto FROM documents
WHERE strlen(text) - strlen(list_extract(string_split(text, chr(10)), -1)) > CASE WHEN doc_id % 3 = 0 AND strpos(text, chr(10)) > 0 THEN strlen(left(text, strpos(text, chr(10)) - 1)) + 1 ELSE 0 END""")
def incremental_tails(spark, d):
    """SC10-SC11, ST1, ST7: what was appended to files already seen; an offset past the end reads the file anew."""
    docs = table(spark, d, "documents")
    nl = F.locate("\n", "text", 1)
    at = F.when(nl > 0, F.octet_length(F.left("text", nl - 1)) + 1).otherwise(F.lit(0))
    off = F.when(F.col("doc_id") % 3 == 0, at).when(F.col("doc_id") % 3 == 1, F.octet_length("text") + 9).otherwise(F.lit(None))
    files = docs.select(F.col("doc_id").alias("ref"), F.lit(5).alias("mtime_us"), F.col("text").cast("binary").alias("content"))
    return raw.new_tails(files, docs.select(F.col("doc_id").alias("ref"), off.cast("long").alias("offset"))).select("ref", "from_", "upto")


@query("SELECT event_type AS source, max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) AS iso FROM events WHERE user_id % 3 <> 1 GROUP BY 1")
def watermarks(spark, d):
    """ST2, M10: the latest time of what succeeded, was too large, or died."""
    u = F.col("user_id") % 3
    done = table(spark, d, "events").select(F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"), F.when(u == 0, F.lit("ok")).when(u == 1, F.lit("failed")).otherwise(F.lit("dead")).alias("outcome"))
    return ingest.advance(done)


@query("""SELECT 'sessions/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '/history.jsonl' WHEN doc_id % 5 = 1 THEN '/x.md' WHEN doc_id % 5 = 2 THEN '/session_index.jsonl' ELSE '/a.jsonl' END AS path FROM documents WHERE doc_id % 5 > 2""")
def compaction_targets(spark, d):
    """Z31."""
    k = F.col("doc_id") % 5
    name = F.when(k == 0, F.lit("/history.jsonl")).when(k == 1, F.lit("/x.md")).when(k == 2, F.lit("/session_index.jsonl")).otherwise(F.lit("/a.jsonl"))
    return raw.compaction_targets(table(spark, d, "documents").select(F.concat(F.lit("sessions/"), "doc_id", name).alias("path")), "codex")

"""Queries over entities and edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import entities as E
from tessera.operators import graph as G
from tessera.operators import history
from tessera.operators import lint as L
from tessera.operators import merge as M
from tessera.operators import metrics as R
from tessera.operators import retrieval
from tessera.operators import vocabulary as V
from tessera.plans.registry import query
from tessera.sources import star
from tessera.sources.star import ENTITIES, edges_sql, table

_ord = "tord || '/' || slug"


def _long(df, c: str):
    """Ranks are ints in Spark, and long ones in the SQL that checks them."""
    return df.withColumn(c, F.col(c).cast("long"))


@query(f"WITH {ENTITIES} SELECT type, slug, status FROM ents WHERE lower(status) <> 'superseded'")
def current_filter(spark, d):
    """FP1, SC6."""
    return E.scan(star.entities(spark, d), current=True).select("type", "slug", "status")


@query(f"WITH {ENTITIES} SELECT slug, {_ord} AS load_ord FROM ents WHERE type = 'concept'")
def type_scan(spark, d):
    """SC4, SC7."""
    return E.scan(star.entities(spark, d), "concept").select("slug", "load_ord")


@query("SELECT 'Logs/' || strftime(o_orderdate, '%Y/%m') || '/order-' || o_orderkey || '.md' AS path FROM orders")
def page_paths(spark, d):
    """SC9."""
    return star.entities(spark, d, "orders").select(E.page_path("created").alias("path"))


@query("""WITH t AS (SELECT doc_id, 'document-' || doc_id AS slug, lang AS title, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)
SELECT slug, title, CASE WHEN length(f) <= 200 THEN f ELSE rtrim(left(f, 200)) || '…' END AS summary FROM t""")
def page_index(spark, d):
    """FP8, X18."""
    docs = table(spark, d, "documents").select(star.slug("document", "doc_id").alias("slug"), F.col("lang").alias("title"), F.col("text").alias("body"))
    return E.page_index(docs)


@query("""WITH t AS (SELECT 'customer-' || c_custkey AS card_id, 'company' AS kind, c_name AS title, c_mktsegment AS summary FROM customer
UNION ALL SELECT 'supplier-' || s_suppkey, 'project', s_name, '' FROM supplier) SELECT * FROM t""")
def card_index(spark, d):
    """FP9, Z4-Z5."""
    return E.card_index(star.entities(spark, d, "customer", "supplier", "part"))


@query(f"""WITH {ENTITIES}, {edges_sql("uses", "related")},
p AS (SELECT DISTINCT s FROM (SELECT src_slug AS s FROM edges WHERE relation <> 'related' UNION ALL SELECT target FROM edges WHERE relation <> 'related')),
r AS (SELECT DISTINCT src_slug AS s FROM edges WHERE relation = 'related'),
c AS (SELECT count(*) AS entities, count(p.s) AS typed, count(*) FILTER (p.s IS NULL AND r.s IS NOT NULL) AS related_only, count(*) FILTER (p.s IS NULL AND r.s IS NULL) AS orphans
      FROM ents LEFT JOIN p ON slug = p.s LEFT JOIN r ON slug = r.s)
SELECT entities, typed, related_only, orphans, typed / entities::DOUBLE AS coverage, related_only / entities::DOUBLE AS residual, orphans / entities::DOUBLE AS orphan_ratio FROM c""")
def relation_metrics(spark, d):
    """A1-A2."""
    return R.relation_metrics(star.entities(spark, d), star.edges(spark, d, "uses", "related"))


@query(f"""WITH {ENTITIES}, {edges_sql("uses", "part_of")}
SELECT slug FROM ents WHERE type IN ('concept', 'company', 'profile') AND slug NOT IN (SELECT src_slug FROM edges) AND slug NOT IN (SELECT target FROM edges)""")
def orphans(spark, d):
    """G8 (CQ15)."""
    return R.orphans(star.entities(spark, d, "part", "customer", "nation", "region"), star.edges(spark, d, "uses", "part_of")).select("slug")


@query(f"WITH {edges_sql('part_of')} SELECT target, relation, src_slug AS source, row_number() OVER (PARTITION BY target ORDER BY src_ord, pos) AS ord FROM edges")
def reverse_relations(spark, d):
    """J4 (CQ01, CQ04)."""
    return _long(G.reverse_relations(star.edges(spark, d, "part_of")), "ord")


@query(f"WITH {edges_sql('related')} SELECT DISTINCT src_slug, target FROM edges WHERE target NOT IN (SELECT 'customer-' || c_custkey FROM customer WHERE c_acctbal > 0)")
def dead_links(spark, d):
    """J1."""
    pages = table(spark, d, "customer").where("c_acctbal > 0").select(star.slug("customer", "c_custkey").alias("slug"))
    return G.dead_links(star.edges(spark, d, "related"), pages)


@query(f"""WITH {edges_sql("uses", "supersedes", "related")},
f AS (SELECT src_slug, target, min(CASE relation WHEN 'uses' THEN 1 WHEN 'supersedes' THEN 5 ELSE 7 END * 1000 + pos) AS k FROM edges GROUP BY src_slug, target)
SELECT src_slug, row_number() OVER (PARTITION BY src_slug ORDER BY k, target) AS ord, target FROM f""")
def one_hop_neighbors(spark, d):
    """G2."""
    kinds = ("uses", "supersedes", "related")
    return _long(G.neighbor_links(star.edges(spark, d, *kinds), star.edge_rows(spark, d, *kinds)), "ord")


@query(f"WITH {edges_sql('uses', 'supersedes')} SELECT src_slug, relation, string_agg(target, ',' ORDER BY pos, target) AS targets FROM edges GROUP BY src_slug, relation")
def typed_neighbors(spark, d):
    """G1."""
    kinds = ("uses", "supersedes")
    return G.typed_neighbors(star.edges(spark, d, *kinds), star.edge_rows(spark, d, *kinds)).select("src_slug", "relation", F.array_join("targets", ",").alias("targets"))


@query(f"""WITH {edges_sql("part_of")},
h AS (SELECT src_slug, target, 1 AS hops FROM edges UNION ALL SELECT a.src_slug, b.target, 2 FROM edges a JOIN edges b ON a.target = b.src_slug)
SELECT src_slug, target, min(hops) AS hops FROM h WHERE src_slug <> target GROUP BY src_slug, target""")
def transitive_part_of(spark, d):
    """G3 (CQ05)."""
    return G.closure(star.edges(spark, d, "part_of"))


@query("""WITH o AS (SELECT 'order-' || o_orderkey AS slug, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS hop FROM orders)
SELECT n.slug AS start, o.slug, o.hop FROM o JOIN o n ON o.o_custkey = n.o_custkey AND n.hop = 0""")
def supersedes_history(spark, d):
    """G4 (CQ02, CQ07), over linear chains."""
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("chain"), F.struct("o_orderdate", "o_orderkey").alias("ord"), star.slug("order", "o_orderkey").alias("slug"))
    return _long(G.ancestors_by_version(v), "hop")


@query(f"""WITH RECURSIVE {edges_sql("supersedes")},
w AS (SELECT src_slug AS start, src_slug AS slug, 0::BIGINT AS hop FROM edges WHERE src_slug NOT IN (SELECT target FROM edges)
      UNION ALL SELECT w.start, e.target, w.hop + 1 FROM w JOIN edges e ON w.slug = e.src_slug)
SELECT start, slug, hop FROM w""")
def supersedes_walk(spark, d):
    """G4, as a walk."""
    e = star.edges(spark, d, "supersedes")
    newest = e.select(F.col("src_slug").alias("ref")).join(e.select(F.col("target").alias("ref")), "ref", "left_anti")
    return history.histories(e, star.entities(spark, d, "orders"), newest).select("start", "slug", "hop")


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS c, 'order-' || o_orderkey AS slug, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
e AS (SELECT a.slug AS src, b.slug AS target, CASE WHEN b.i = a.i - 1 THEN 2 WHEN b.i = a.i - 2 THEN 0 ELSE 1 END AS pos FROM o a JOIN o b ON a.c = b.c AND (b.i = a.i - 1 OR b.i = a.i - 2 OR (a.i % 3 = 1 AND b.i = a.n AND b.i > a.i + 1))),
k AS (SELECT src, list(target ORDER BY pos) AS kids FROM e GROUP BY src),
f AS (SELECT slug AS start, [slug] AS stack, []::VARCHAR[] AS seen FROM o WHERE i = n OR i = n // 2
      UNION ALL SELECT start, CASE WHEN list_contains(seen, stack[1]) THEN stack[2:] ELSE list_concat(coalesce(kids, []), stack[2:]) END, CASE WHEN list_contains(seen, stack[1]) THEN seen ELSE list_append(seen, stack[1]) END
      FROM f LEFT JOIN k ON k.src = stack[1] WHERE len(stack) > 0)
SELECT start, unnest(range(len(seen))) AS place, unnest(seen) AS slug FROM f WHERE len(stack) = 0""")
def supersedes_branching(spark, d):
    """An order supersedes the two before it of its customer, every third the last one too: diamonds and cycles."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    own = table(spark, d, "orders").select("o_custkey", star.slug("order", "o_orderkey").alias("slug"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))
    a, b = own.alias("a"), own.alias("b")
    near = (F.col("b.i") == F.col("a.i") - 1) | (F.col("b.i") == F.col("a.i") - 2) | ((F.col("a.i") % 3 == 1) & (F.col("b.i") == F.col("a.n")) & (F.col("b.i") > F.col("a.i") + 1))
    pos = F.when(F.col("b.i") == F.col("a.i") - 1, 2).when(F.col("b.i") == F.col("a.i") - 2, 0).otherwise(1)
    e = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & near).select(F.lit("log").alias("src_type"), F.col("a.slug").alias("src_slug"), F.lit("supersedes").alias("relation"), pos.alias("pos"), F.concat(F.lit("log:"), "b.slug").alias("target"))
    starts = own.where((F.col("i") == F.col("n")) | (F.col("i") == F.floor(F.col("n") / 2))).select(F.col("slug").alias("ref"))
    return history.histories(e, star.entities(spark, d, "orders"), starts).select("start", "place", "slug")


@query(f"""WITH {edges_sql("part_of")}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY src_ord) AS rank FROM edges WHERE src_slug NOT LIKE 'nation-%')
SELECT target AS seed, relation, src_slug AS source, rank FROM r WHERE rank <= 5 AND target LIKE 'nation-%'""")
def reverse_cap(spark, d):
    """W6."""
    return _long(G.reverse_capped(star.edges(spark, d, "part_of"), star.entities(spark, d, "nation").select("slug")), "rank")


def _questions(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    text = F.concat(F.lit("Which of them is part_of "), "n_name", F.lit(" or uses it, in "), F.lower("r_name"), F.lit("?"))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").cast("long").alias("query"), text.alias("text"))


def _linked(spark, d):
    """Edges of all kinds to nations: beside part_of, nations have related pages, suppliers are the same as them, customers use the next one."""
    n, s, c = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "customer")
    row = lambda df, kind, tord, src, rel, pos, target: df.select(F.lit(kind).alias("src_type"), src.alias("src_slug"), F.concat(F.lit(f"{tord}/"), src).alias("src_ord"), F.lit(rel).alias("relation"), F.lit(pos).alias("pos"), target.alias("target"))
    return (
        star.edges(spark, d, "part_of")
        .unionByName(row(n, "profile", "06", star.slug("nation", "n_nationkey"), "related", 0, star.slug("supplier", "n_nationkey")))
        .unionByName(row(n, "profile", "06", star.slug("nation", "n_nationkey"), "related", 1, star.slug("customer", "n_nationkey")))
        .unionByName(row(s.where("s_suppkey % 5 = 0"), "project", "01", star.slug("supplier", "s_suppkey"), "same_as", 0, star.slug("nation", "s_nationkey")))
        .unionByName(row(c.where("c_custkey % 4 = 0"), "company", "02", star.slug("customer", "c_custkey"), "uses", 0, F.concat(F.lit("nation-"), (F.col("c_nationkey") + 1) % 25)))
    )


_LINKED = edges_sql("part_of")[:-1] + """ UNION ALL SELECT 'profile', 'nation-' || n_nationkey, '06/nation-' || n_nationkey, 'related', 0, 'supplier-' || n_nationkey FROM nation
  UNION ALL SELECT 'profile', 'nation-' || n_nationkey, '06/nation-' || n_nationkey, 'related', 1, 'customer-' || n_nationkey FROM nation
  UNION ALL SELECT 'project', 'supplier-' || s_suppkey, '01/supplier-' || s_suppkey, 'same_as', 0, 'nation-' || s_nationkey FROM supplier WHERE s_suppkey % 5 = 0
  UNION ALL SELECT 'company', 'customer-' || c_custkey, '02/customer-' || c_custkey, 'uses', 0, 'nation-' || ((c_nationkey + 1) % 25) FROM customer WHERE c_custkey % 4 = 0)"""


def _by_seed(most: int) -> str:
    """Seed after seed: what stages (a) to (c) show, then up to five new sources of each relation asked for, then related pages."""
    steps = []
    for k in range(1, most + 1):
        seen = f"v{k - 1}"
        steps.append(f"""a{k} AS (SELECT query, page, min((0, so, step, o)) AS p FROM fixed WHERE so = {k} AND step < 3 GROUP BY query, page),
w{k} AS (SELECT * FROM {seen} UNION ALL SELECT * FROM a{k} WHERE NOT EXISTS (SELECT 1 FROM {seen} x WHERE x.query = a{k}.query AND x.page = a{k}.page)),
d{k} AS (SELECT query, page, min((0, so, 3, o || ' ' || r)) AS p FROM (SELECT *, row_number() OVER (PARTITION BY query, r ORDER BY o) AS n FROM asked WHERE so = {k} AND NOT EXISTS (SELECT 1 FROM w{k} x WHERE x.query = asked.query AND x.page = asked.page)) WHERE n <= 5 GROUP BY query, page),
y{k} AS (SELECT * FROM w{k} UNION ALL SELECT * FROM d{k}),
e{k} AS (SELECT query, page, min((0, so, step, o)) AS p FROM fixed WHERE so = {k} AND step = 4 GROUP BY query, page),
v{k} AS (SELECT * FROM y{k} UNION ALL SELECT * FROM e{k} WHERE NOT EXISTS (SELECT 1 FROM y{k} x WHERE x.query = e{k}.query AND x.page = e{k}.page))""")
    return ",\n".join(steps)


#: Names of nations hold one another, as NATION_1 and NATION_12 do: at most three seeds with the region.
_SEEDS = 3


@query(f"""WITH {ENTITIES}, {_LINKED},
p AS (SELECT *, {_ord} AS o FROM ents WHERE type IN ('company', 'project', 'profile')),
q AS (SELECT n_nationkey::BIGINT AS query, lower('Which of them is part_of ' || n_name || ' or uses it, in ' || r_name || '?') AS text FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT query, slug, row_number() OVER (PARTITION BY query ORDER BY o) AS so FROM q JOIN p ON contains(text, lower(title)) OR contains(text, slug)),
fixed AS (SELECT query, so, 0 AS step, target AS page, '' AS o FROM s JOIN edges ON slug = src_slug WHERE relation <> 'related'
      UNION ALL SELECT query, so, 1, e.target, '' FROM s JOIN edges m ON slug = m.src_slug AND m.relation = 'part_of' JOIN edges e ON m.target = e.src_slug AND e.relation = 'part_of'
      UNION ALL SELECT query, so, 2, src_slug, src_ord FROM s JOIN edges ON slug = target WHERE relation = 'same_as'
      UNION ALL SELECT query, so, 4, target, pos::VARCHAR FROM s JOIN edges ON slug = src_slug WHERE relation = 'related' AND target IN (SELECT slug FROM p)),
asked AS (SELECT query, so, src_slug AS page, src_ord AS o, CASE relation WHEN 'uses' THEN 1 ELSE 2 END AS r FROM s JOIN edges ON slug = target WHERE relation IN ('uses', 'part_of')),
v0 AS (SELECT query, slug AS page, (-1, so, 0, '') AS p FROM s),
{_by_seed(_SEEDS)},
g AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY p, page) AS rank, page AS slug FROM v{_SEEDS})
SELECT query, rank, slug FROM g WHERE rank <= 12""")
def related_pages(spark, d):
    """J2, FP18, G5, S2, W6 (CQ01, CQ03, CQ08, CQ12): the flagship, over all its stages."""
    pages = star.entities(spark, d, "customer", "supplier", "nation", "region")
    return _long(retrieval.related_pages(_questions(spark, d), pages, _linked(spark, d)), "rank")


@query(f"""WITH {ENTITIES}, q AS (SELECT doc_id AS query, lower(text) AS text FROM documents),
p AS (SELECT slug, title, {_ord} AS o FROM ents WHERE type IN ('concept', 'profile'))
SELECT query, slug, o AS load_ord FROM q JOIN p ON contains(text, lower(title)) OR contains(text, slug)""")
def name_matches(spark, d):
    """J2 by itself: every document against every part, nation and region."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("query"), "text")
    return retrieval.name_seeds(docs, star.entities(spark, d, "part", "nation", "region"))


@query(f"""WITH {edges_sql("part_of")},
c AS (SELECT c_custkey AS query, 'customer-' || c_custkey AS slug FROM customer UNION ALL SELECT c_custkey, 'nation-' || c_nationkey FROM customer
      UNION ALL SELECT c_custkey, 'region-' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT a.query, e.target, e.relation, string_agg(DISTINCT e.src_slug, ',' ORDER BY e.src_slug) AS sources
FROM edges e JOIN c a ON e.src_slug = a.slug JOIN c b ON e.target = b.slug AND a.query = b.query GROUP BY a.query, e.target, e.relation""")
def relation_context(spark, d):
    """J12 (CQ11)."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    chosen = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("query"), F.explode(F.array(star.slug("customer", "c_custkey"), star.slug("nation", "c_nationkey"), star.slug("region", "n_regionkey"))).alias("slug"))
    return G.relation_context(star.edges(spark, d, "part_of"), chosen).withColumn("sources", F.array_join("sources", ","))


@query("""SELECT o_orderkey AS query, CASE o_orderstatus WHEN 'F' THEN 'customer-' || o_custkey || ',order-' || o_orderkey
  WHEN 'O' THEN 'order-' || o_orderkey ELSE 'order-' || o_orderkey || ',customer-' || o_custkey END AS sources FROM orders""")
def citations(spark, d):
    """Links first, then plain names, else all that was provided."""
    o = table(spark, d, "orders")
    own, cust = star.slug("order", "o_orderkey"), star.slug("customer", "o_custkey")
    said = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("as ("), own, F.lit(") says, see [["), cust, F.lit("|them]] and [[no-page]]"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("see "), own)).otherwise(F.lit("nothing"))
    return retrieval.citations(o.select(F.col("o_orderkey").alias("query"), said.alias("answer"), F.array(own, cust).alias("provided"))).select("query", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {edges_sql("uses", "related", "part_of")},
t AS (SELECT 'part-' || p_partkey AS slug, CASE WHEN p_size > 40 THEN 'log' ELSE 'concept' END AS type FROM part
      UNION ALL SELECT 'nation-' || n_nationkey, 'profile' FROM nation UNION ALL SELECT 'nation-' || n_nationkey, 'company' FROM nation WHERE n_nationkey < 5)
SELECT e.src_slug, e.relation, e.target, CASE WHEN max(t.slug) IS NULL THEN 'relation_target_missing' WHEN count(*) > 1 THEN 'relation_target_ambiguous' ELSE 'relation_range' END AS code
FROM edges e LEFT JOIN t ON e.target = t.slug WHERE e.relation <> 'related' GROUP BY e.src_slug, e.relation, e.target
HAVING max(t.slug) IS NULL OR count(*) > 1 OR (e.relation = 'uses' AND max(t.type) <> 'concept')""")
def relation_rules(spark, d):
    """J6."""
    part = table(spark, d, "part").select(star.slug("part", "p_partkey").alias("slug"), F.when(F.col("p_size") > 40, F.lit("log")).otherwise(F.lit("concept")).alias("type"))
    nation = table(spark, d, "nation")
    n = star.slug("nation", "n_nationkey").alias("slug")
    pages = part.unionByName(nation.select(n, F.lit("profile").alias("type"))).unionByName(nation.where("n_nationkey < 5").select(n, F.lit("company").alias("type")))
    return L.relation_rules(star.edges(spark, d, "uses", "related", "part_of"), pages)


_PAGES = """p AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'Concepts/' ELSE 'Logs/' END || strftime(o_orderdate, '%Y/%m') || '/' || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END || 'order-' || o_orderkey || '.md' AS path,
  CASE WHEN o_orderkey % 11 = 0 THEN 'note' ELSE 'log' END AS type, 'order-' || o_orderkey AS slug, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS title, CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'active' END AS status, o_orderkey AS k FROM orders)"""


@query(f"""WITH {_PAGES}
SELECT 'missing_required' AS code, path, 'title' AS message FROM p WHERE title = ''
UNION ALL SELECT 'invalid_type', path, 'type=' || type FROM p WHERE type <> 'log'
UNION ALL SELECT 'invalid_enum', path, 'status=' || status FROM p WHERE type = 'log' AND status = 'open'
UNION ALL SELECT 'slug_filename_mismatch', path, 'slug=' || slug FROM p WHERE type = 'log' AND k % 5 = 0
UNION ALL SELECT 'type_folder_mismatch', path, 'type=log' FROM p WHERE type = 'log' AND k % 7 = 0""")
def lint_violations(spark, d):
    """L2-L3."""
    k = F.col("o_orderkey")
    own = star.slug("order", "o_orderkey")
    path = F.concat(F.when(k % 7 == 0, F.lit("Concepts/")).otherwise(F.lit("Logs/")), F.date_format("o_orderdate", "yyyy/MM"), F.lit("/"), F.when(k % 5 == 0, F.lit("x")).otherwise(F.lit("")), own, F.lit(".md"))
    pages = table(spark, d, "orders").select(path.alias("path"), F.when(k % 11 == 0, F.lit("note")).otherwise(F.lit("log")).alias("type"), own.alias("slug"), F.when(k % 13 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("title"), F.when(F.col("o_orderstatus") == "P", F.lit("open")).otherwise(F.lit("active")).alias("status"))
    return L.page_rules(pages)


def _companies(spark, d):
    """Companies with a size, positions and links that follow from their keys."""
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    size = F.when(k % 3 == 0, F.lit("huge")).when(k % 3 == 1, F.lit("small"))
    pos = F.when(k % 4 == 0, F.array(F.struct(F.lit("Engineer").alias("title")), F.struct(F.lit("").alias("title"))))
    attrs = F.struct(size.alias("size"), F.lit(None).cast("string").alias("resume_language"), F.lit(None).cast("string").alias("kind"), pos.alias("positions"), *[F.lit(None).cast("array<struct<name:string>>").alias("metrics")], *[none.alias(f) for f in ("keywords", "stack", "domains")])
    rel = {r: none for r in V.RELATIONS} | {"part_of": F.when(k % 2 == 0, F.array(star.slug("nation", "c_nationkey"))).otherwise(none)}
    return table(spark, d, "customer").select(
        F.lit("company").alias("type"), star.slug("customer", "c_custkey").alias("slug"), F.col("c_name").alias("title"), F.when(k % 5 == 0, F.lit("draft")).otherwise(F.lit("target")).alias("status"), F.concat(F.lit("Entities/Companies/customer-"), k.cast("string"), F.lit(".md")).alias("path"),
        attrs.alias("attrs"), F.when(k % 3 == 0, F.array(F.lit("nation-1"))).otherwise(none).alias("related"), *[v.alias(r) for r, v in rel.items()],
    )


@query("""SELECT 'invalid_enum' AS code, 'Entities/Companies/customer-' || c_custkey || '.md' AS path, 'size=huge' AS message FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'missing_required', 'Entities/Companies/customer-' || c_custkey || '.md', 'positions[1].title' FROM customer WHERE c_custkey % 4 = 0""")
def field_rules(spark, d):
    """L4."""
    return L.field_rules(_companies(spark, d))


@query("SELECT 'customer-' || c_custkey AS slug FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def residual_gate(spark, d):
    """L5."""
    return L.residual(_companies(spark, d)).select("slug")


@query("SELECT 'customer-' || c_custkey AS slug FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 4 <> 0")
def empty_cards(spark, d):
    """FP17, L11."""
    return _companies(spark, d).where(L.empty_card()).select("slug")


@query(f"""WITH {edges_sql("supersedes")}
SELECT 'order-' || o.o_orderkey AS slug, CASE WHEN e.target IS NULL THEN 'active' ELSE 'superseded' END AS status, coalesce(strftime(n.o_orderdate, '%Y-%m-%d'), '') AS t_invalid
FROM orders o LEFT JOIN edges e ON e.target = 'order-' || o.o_orderkey LEFT JOIN orders n ON e.src_slug = 'order-' || n.o_orderkey""")
def supersede_cascade(spark, d):
    """M3 (CQ13)."""
    pages = star.entities(spark, d, "orders").withColumns({"status": F.lit("active"), "updated": F.lit("")})
    return G.supersede(pages, star.edges(spark, d, "supersedes"), "2026-01-01").select("slug", "status", "t_invalid")


@query("""WITH g AS (SELECT o_custkey || ' ' || o_orderpriority AS title, count(*) AS seen, string_agg('order-' || o_orderkey, ',' ORDER BY o_orderkey) AS decided_in FROM orders GROUP BY 1)
SELECT 'promoted-' || trim(regexp_replace(regexp_replace(lower(replace(title, ' ', '-')), '[^0-9a-z-]+', '-', 'g'), '-+', '-', 'g'), '-') AS slug, title, decided_in, seen FROM g WHERE seen >= 2""")
def promotion_from_logs(spark, d):
    """A7 (CQ14)."""
    logs = table(spark, d, "orders").select(star.slug("order", "o_orderkey").alias("slug"), F.concat_ws(" ", "o_custkey", "o_orderpriority").alias("title"), F.col("o_orderkey").alias("ord"))
    return R.promotion_candidates(logs).withColumn("decided_in", F.array_join("decided_in", ","))


@query(f"""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents),
s AS (SELECT doc_id, {", ".join("(" + " + ".join(f"contains(t, '{w}')::INT" for w in ws) + f") AS {k}" for k, ws in V.KINDS.items())} FROM t)
SELECT doc_id, CASE {" ".join(f"WHEN {k} > 0 AND {k} = greatest({', '.join(V.KINDS)}) THEN '{k}'" for k in V.KINDS)} END AS kind FROM s""")
def kind_argmax(spark, d):
    """A8 (CQ09)."""
    docs = table(spark, d, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("body"))
    return docs.select("doc_id", R.kind_of().alias("kind"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority AS tag FROM orders), n AS (SELECT o_custkey, count(*) AS n FROM o GROUP BY 1),
g AS (SELECT o_custkey, tag, count(*) AS seen, min(o_orderkey) AS f FROM o GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY seen DESC, f) AS r FROM g)
SELECT o_custkey, tag, seen FROM r JOIN n USING (o_custkey) WHERE r = 1 AND seen / n::DOUBLE >= 0.3""")
def dominant_tag(spark, d):
    """A14."""
    rec = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), F.array("o_orderpriority").alias("tags"))
    return R.dominant_tag(rec, "o_custkey")


@query("""WITH ops AS (SELECT l_orderkey, (l_linenumber * 10000000::BIGINT + l_partkey) * 10000 + l_suppkey % 10000 AS ord, 'part-' || l_partkey AS part, l_returnflag AS flag, l_linenumber = 3 AS fresh FROM lineitem),
c AS (SELECT l_orderkey, max(ord) FILTER (fresh) AS f FROM ops GROUP BY 1),
live AS (SELECT ops.* FROM ops JOIN c USING (l_orderkey) WHERE f IS NULL OR ord >= f),
u AS (SELECT l_orderkey, part, min(ord) AS ord FROM live GROUP BY 1, 2)
SELECT 'order-' || l_orderkey AS slug, (SELECT max_by(flag, ord) FROM live WHERE live.l_orderkey = u.l_orderkey) AS title, string_agg(part, ',' ORDER BY ord) AS uses FROM u GROUP BY l_orderkey""")
def merge_apply(spark, d):
    """M1-M2: line items as operations on their order's page; the third line creates it anew."""
    li = table(spark, d, "lineitem")
    empty = F.array().cast("array<string>")
    ops = li.select(
        F.lit("log").alias("type"), star.slug("order", "l_orderkey").alias("slug"), F.col("l_returnflag").alias("title"), F.lit("active").alias("status"), F.lit("").alias("created"), F.lit("").alias("updated"), F.lit("").alias("observed_at"),
        F.array(star.slug("part", "l_partkey")).alias("uses"), *[empty.alias(c) for c in M.ARRAYS if c != "uses"], ((F.col("l_linenumber") * F.lit(10_000_000).cast("long") + F.col("l_partkey")) * 10_000 + F.col("l_suppkey") % 10_000).alias("op_ord"), F.when(F.col("l_linenumber") == 3, F.lit("create")).otherwise(F.lit("update")).alias("op"),
    )
    stored = ops.drop("op_ord", "op").where("false")
    return M.apply_ops(stored, ops, "2026-01-01").select("slug", "title", F.array_join("uses", ",").alias("uses"))


@query("""SELECT n_name AS stage, CASE WHEN n_regionkey = 0 THEN NULL WHEN n_regionkey = 1 THEN 'AFRICA' WHEN n_regionkey = 2 THEN 'AMERICA' WHEN n_regionkey = 3 THEN 'ASIA' END AS blocked_by FROM nation""")
def stage_blocking(spark, d):
    """ST10: nations need the region before theirs; of these one has failed, one is missing, one was skipped."""
    names = table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("after"), F.col("r_name").alias("needs"))
    n = table(spark, d, "nation")
    stages = n.join(names, n["n_regionkey"] == names["after"]).select(F.col("n_name").alias("stage"), F.lit(0).alias("pos"), "needs")
    results = spark.createDataFrame([("AFRICA", "failed", ""), ("ASIA", "skipped", "asked"), ("EUROPE", "ok", "")], "stage string, status string, reason string")
    own = n.where("n_regionkey = 0").select(F.col("n_name").alias("stage"), F.lit(0).alias("pos"), F.lit("EUROPE").alias("needs"))
    return M.blocking(stages.join(own.select("stage"), "stage", "left_anti").unionByName(own), results)

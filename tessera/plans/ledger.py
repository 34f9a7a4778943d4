"""Queries over the promotion ledger and dismissals. Events stand for sightings of a fact: an event type and a user."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import ledger as L
from tessera.operators import merge as M
from tessera.operators import similarity as S
from tessera.operators.absorb import ENTRY, absorb
from tessera.plans.registry import query
from tessera.sources.star import table

TODAY = "2024-01-30"
_CONF = "least(greatest(value / 100.0, 0.0), 1.0)"
_SIGHT = f"s AS (SELECT event_type || ' of ' || user_id AS fingerprint, strftime(ts, '%Y-%m-%d') AS day, event_id AS ord, props AS statement, {_CONF} AS confidence, event_type AS category FROM events)"
_LEDGER = f"""{_SIGHT},
c AS (SELECT fingerprint, list(confidence ORDER BY day, ord) AS ch FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY day DESC, ord DESC) AS r FROM s) WHERE r <= 30 GROUP BY 1),
h AS (SELECT fingerprint, min(day) AS first_seen, max(day) AS last_seen, count(*) AS seen_count FROM s GROUP BY 1),
ledger AS (SELECT *, list_max(ch) AS peak, list_sum(ch) / len(ch) AS mean FROM h JOIN c USING (fingerprint))"""


def _sightings(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.lit("fact").alias("kind"), F.concat_ws(" of ", "event_type", "user_id").alias("fingerprint"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("ord"),
        F.col("props").alias("statement"), (F.col("value") / 100.0).alias("confidence"), F.col("event_type").alias("category"),
    )


def _ledger(spark, d):
    return L.accumulate(_sightings(spark, d)).withColumns({"promoted": F.lit(False), "promoted_at": F.lit("")})


@query(f"""WITH {_LEDGER},
t AS (SELECT fingerprint, statement, min((day, ord)) AS o FROM s WHERE trim(statement) <> '' GROUP BY 1, 2),
u AS (SELECT fingerprint, string_agg(statement, '|' ORDER BY o) AS statements FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY o DESC) AS r FROM t) WHERE r <= 5 GROUP BY 1)
SELECT fingerprint, first_seen, last_seen, seen_count, round(peak, 6) AS peak, round(mean, 10) AS mean, len(ch)::INT AS kept, coalesce(statements, '') AS statements, split_part(fingerprint, ' of ', 1) AS categories FROM ledger LEFT JOIN u USING (fingerprint)""")
def ledger_accumulate(spark, d):
    """A9-A10."""
    return L.accumulate(_sightings(spark, d)).select("fingerprint", "first_seen", "last_seen", "seen_count", F.round(L.peak(), 6).alias("peak"), F.round(L.mean(), 10).alias("mean"), F.size("confidence_history").alias("kept"), F.array_join("statements", "|").alias("statements"), F.array_join("categories", "|").alias("categories"))


@query(f"""WITH {_LEDGER}, t AS (SELECT fingerprint, max(confidence) AS c FROM s WHERE day = '{TODAY}' GROUP BY 1)
SELECT fingerprint, CASE WHEN (seen_count >= 3 AND date_diff('day', last_seen::DATE, DATE '{TODAY}') BETWEEN 0 AND 14) OR coalesce(c, 0) >= 0.9 THEN 'promote' ELSE 'await' END AS decision FROM ledger LEFT JOIN t USING (fingerprint)""")
def ledger_promote(spark, d):
    """A11, FP14."""
    now = _sightings(spark, d).where(F.col("day") == TODAY).select("kind", "fingerprint", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    return L.promote(_ledger(spark, d), now, TODAY).select("fingerprint", "decision")


@query(f"WITH {_LEDGER} SELECT fingerprint, seen_count, round(peak, 6) AS peak FROM ledger ORDER BY seen_count DESC, peak DESC, fingerprint LIMIT 20")
def ledger_top(spark, d):
    """FP22: a top-20 report."""
    return L.top(_ledger(spark, d), 20).select("fingerprint", "seen_count", F.round("peak", 6).alias("peak"))


@query(f"WITH {_LEDGER} SELECT fingerprint, round(peak, 6) AS peak FROM ledger WHERE peak >= 0.8 AND date_diff('day', last_seen::DATE, DATE '{TODAY}') BETWEEN 0 AND 14")
def review_candidates(spark, d):
    """A12, Z27."""
    return L.review(_ledger(spark, d), TODAY, 0.8).select("fingerprint", F.round(L.peak(), 6).alias("peak"))


@query(f"""WITH {_SIGHT} SELECT fingerprint, min(day) AS first_seen, max(day) AS last_seen, count(*) AS seen_count FROM s GROUP BY 1""")
def ledger_merge(spark, d):
    """ST6: the ledger of the first half of the month, then the rest merged into it."""
    s = _sightings(spark, d)
    return L.merge(L.accumulate(s.where("day < '2024-01-15'")), L.accumulate(s.where("day >= '2024-01-15'"))).select("fingerprint", "first_seen", "last_seen", "seen_count")


@query(f"WITH {_LEDGER} SELECT split_part(fingerprint, ' of ', 1) AS category, fingerprint AS statement, row_number() OVER (PARTITION BY split_part(fingerprint, ' of ', 1) ORDER BY peak DESC, seen_count DESC, fingerprint) AS place FROM ledger")
def fact_ranks(spark, d):
    """W8, A18."""
    f = _ledger(spark, d).select(F.col("categories")[0].alias("category"), F.col("fingerprint").alias("statement"), L.peak().alias("peak"), "seen_count")
    return L.ranked_facts(f).select("category", "statement", F.col("place").cast("long").alias("place"))


_REASONS = ("user_changed", "misclassified", "one_time", "irrelevant", "other", "")
_DISMISSED = f"""r AS (SELECT 'fact' AS kind, 'event ' || event_id AS fingerprint, strftime(ts, '%Y-%m-%d') AS dismissed_at, CASE user_id % 6 {" ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_REASONS))} END AS reason FROM events),
a AS (SELECT *, date_diff('day', dismissed_at::DATE, DATE '2024-04-15') AS age, CASE reason WHEN 'user_changed' THEN 30 WHEN 'misclassified' THEN 90 WHEN 'one_time' THEN 180 WHEN 'irrelevant' THEN 365 ELSE 90 END AS ttl FROM r)"""


def _dismissed(spark, d):
    reason = F.coalesce(*[F.when(F.col("user_id") % 6 == i, F.lit(r)) for i, r in enumerate(_REASONS)])
    return table(spark, d, "events").select(F.lit("fact").alias("kind"), F.concat(F.lit("event "), "event_id").alias("fingerprint"), F.date_format("ts", "yyyy-MM-dd").alias("dismissed_at"), reason.alias("reason"))


@query(f"WITH {_DISMISSED} SELECT fingerprint, ttl::INT AS ttl, age::INT AS age, age > ttl AS expired FROM a")
def dismissed_ttl(spark, d):
    """A13, FP21, Z25."""
    return L.dismissed(_dismissed(spark, d), "2024-04-15").select("fingerprint", "ttl", "age", "expired")


@query(f"WITH {_DISMISSED} SELECT reason, count(*) FILTER (age <= ttl) AS live, count(*) FILTER (age > ttl) AS expired FROM a GROUP BY reason")
def dismissed_reasons(spark, d):
    """A19."""
    return L.dismissed(_dismissed(spark, d), "2024-04-15").groupBy("reason").agg(F.count_if(~F.col("expired")).alias("live"), F.count_if("expired").alias("expired"))


@query(f"WITH {_DISMISSED} SELECT fingerprint, reason FROM a WHERE age <= ttl")
def dismissed_purge(spark, d):
    """M8."""
    return L.purge(_dismissed(spark, d), "2024-04-15").select("fingerprint", "reason")


@query("SELECT event_type || ' ' || user_id AS fingerprint, min_by(reason, ord) AS reason FROM (SELECT event_type, user_id, CASE WHEN event_id % 2 = 0 THEN 'one_time' ELSE 'other' END AS reason, event_id AS ord FROM events) GROUP BY 1")
def dismiss_once(spark, d):
    """M7: the first reason of a key stays."""
    new = table(spark, d, "events").select(F.lit("fact").alias("kind"), F.concat_ws(" ", "event_type", "user_id").alias("fingerprint"), F.lit("2024-01-01").alias("dismissed_at"), F.when(F.col("event_id") % 2 == 0, F.lit("one_time")).otherwise(F.lit("other")).alias("reason"), F.col("event_id").alias("ord"))
    return L.dismiss(new.drop("ord").where("false"), new).select("fingerprint", "reason")


@query("""WITH l AS (SELECT user_id, event_type, event_id AS line, value FROM events) SELECT user_id, event_type, max(line) AS line, max_by(round(value, 6), line) AS value FROM l GROUP BY 1, 2""")
def latest_offsets(spark, d):
    """SC24, D5, M11: the last line of each key."""
    l = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("line"), F.round("value", 6).alias("value"))  # noqa: E741
    return L.latest(l, ("user_id", "event_type"))


@query("""SELECT user_id, event_type, action FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r, props AS action FROM events) p JOIN (SELECT DISTINCT user_id FROM events) u USING (user_id) WHERE r = 1""")
def enrich_latest(spark, d):
    """Each type's last props, through its normalised trigger."""
    e = table(spark, d, "events")
    p = e.select(F.concat(F.upper("event_type"), F.lit(" !")).alias("trigger"), F.col("props").alias("action"), F.lit("").alias("rationale"), F.col("event_id").alias("ord"))
    last = e.groupBy("event_type").agg(F.max_by("user_id", "event_id").alias("user_id"))
    return L.enrich(last.withColumn("trigger", F.col("event_type")), p).select("user_id", "event_type", "action")


_WHOLE = "regexp_replace(lower(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')), '[ .。!?:,;・…]+$', '')"
_WHOLE_WORDS = f"list_filter(list_distinct(string_split({_WHOLE}, ' ')), lambda x: x <> '')"


@query(f"""WITH c AS (SELECT doc_id AS cand, {_WHOLE} AS n, {_WHOLE_WORDS} AS w FROM documents), l AS (SELECT DISTINCT ON (n) {_WHOLE} AS n, {_WHOLE_WORDS} AS w, item_id AS ord FROM benchmark ORDER BY n, ord),
p AS (SELECT cand, l.n AS fingerprint, ord, CASE WHEN c.n = l.n THEN 2.0 ELSE len(list_intersect(c.w, l.w)) / (len(c.w) + len(l.w) - len(list_intersect(c.w, l.w)))::DOUBLE END AS s FROM c, l WHERE len(c.w) > 0 AND len(l.w) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY s DESC, ord DESC) AS r FROM p WHERE s >= 0.75)
SELECT cand, fingerprint, round(least(s, 1.0), 9) AS score FROM r WHERE r = 1""")
def ledger_best_match(spark, d):
    """J9."""
    c = table(spark, d, "documents").select(F.col("doc_id").alias("cand"), F.lit("fact").alias("kind"), F.col("text").alias("statement"))
    led = table(spark, d, "benchmark").groupBy(X.normalize("text").alias("fingerprint")).agg(F.min("item_id").alias("ord"))
    led = led.select(F.lit("fact").alias("kind"), "fingerprint", F.array().cast("array<string>").alias("statements"), "ord")
    return S.best_entries(c, led).select("cand", "fingerprint", F.round("score", 9).alias("score"))


# A batch of statements with ten words or so, of which neighbours differ in one: entries are leaders, and order decides.
_SAID = "'A customer of segment ' || c_mktsegment || ' in N' || c_nationkey || ' with balance B' || floor(c_acctbal / 2000)::INT"
_DAYS = ("2024-01-01", "2024-01-02")


def _absorbing() -> str:
    """Row after row: the ledger is a list that each step turns into the next; a day begins with it in order, as it is stored."""
    jac = "len(list_intersect(v, r.w)) / (len(v) + len(r.w) - len(list_intersect(v, r.w)))::DOUBLE"
    tail = lambda x, n: f"({x})[greatest(len({x}) - {n} + 1, 1):]"
    new = "struct_pack(fp := r.fp, seen := 1, last := r.day, st := [r.s], wst := [r.w], wfp := r.w, conf := [r.c])"
    upd = f"""struct_pack(fp := e.fp, seen := e.seen + 1, last := r.day, st := CASE WHEN list_contains(e.st, r.s) THEN e.st ELSE {tail("list_append(e.st, r.s)", 5)} END,
      wst := CASE WHEN list_contains(e.st, r.s) THEN e.wst ELSE {tail("list_append(e.wst, r.w)", 5)} END, wfp := e.wfp, conf := {tail("list_append(e.conf, r.c)", 30)})"""
    return f"""
WITH RECURSIVE b AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'pattern' ELSE 'fact' END AS kind, {_SAID} AS s, c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '{_DAYS[0]}' ELSE '{_DAYS[1]}' END AS day, (c_custkey % 100) / 100.0 AS c FROM customer),
n AS (SELECT *, lower(s) AS fp, list_distinct(string_split(lower(s), ' ')) AS w, row_number() OVER (PARTITION BY kind ORDER BY day, k) AS i, row_number() OVER (PARTITION BY kind, day ORDER BY k) = 1 AS begins FROM b),
f AS (SELECT kind, 0::BIGINT AS i, []::STRUCT(fp VARCHAR, seen INT, last VARCHAR, st VARCHAR[], wst VARCHAR[][], wfp VARCHAR[], conf DOUBLE[])[] AS es FROM (SELECT DISTINCT kind FROM n)
      UNION ALL
      SELECT kind, i, CASE WHEN hit = 0 THEN list_append(es, {new}) ELSE list_transform(es, lambda e, j: CASE WHEN j = hit THEN {upd} ELSE e END) END
      FROM (SELECT r.kind, r.i, r, f.es, CASE WHEN list_position(list_transform(f.es, lambda e: e.fp), r.fp) > 0 THEN list_position(list_transform(f.es, lambda e: e.fp), r.fp)
              ELSE list_reduce(list_prepend(struct_pack(j := 0::BIGINT, best := 0.75::DOUBLE, sc := []::DOUBLE[]), list_transform(f.es, lambda e, j: struct_pack(j := j::BIGINT, best := 0::DOUBLE, sc := list_transform(list_prepend(e.wfp, e.wst), lambda v: {jac})))),
                   lambda a, x: CASE WHEN len(list_filter(x.sc, lambda y: y >= a.best)) > 0 THEN struct_pack(j := x.j, best := list_filter(x.sc, lambda y: y >= a.best)[1], sc := x.sc) ELSE a END).j END AS hit
            FROM (SELECT f.kind, f.i, CASE WHEN begins THEN list_sort(es) ELSE es END AS es FROM f JOIN n ON n.kind = f.kind AND n.i = f.i + 1) f JOIN n r ON r.kind = f.kind AND r.i = f.i + 1)),
e AS (SELECT kind, unnest(es) AS e FROM f QUALIFY row_number() OVER (PARTITION BY kind ORDER BY i DESC) = 1)
SELECT kind, e.fp AS fingerprint, e.seen::BIGINT AS seen_count, e.last AS last_seen, array_to_string(e.st, '|') AS statements, len(e.conf) AS kept, round(list_sum(e.conf), 6) AS confidence FROM e"""


@query(_absorbing())
def ledger_absorb(spark, d):
    """ST6, J9, D2: two days' statements absorbed in order; each may match an entry that one before it opened."""
    c = table(spark, d, "customer")
    said = F.concat(F.lit("A customer of segment "), "c_mktsegment", F.lit(" in N"), "c_nationkey", F.lit(" with balance B"), F.floor(F.col("c_acctbal") / 2000).cast("int"))
    rows = c.select(F.when(F.col("c_custkey") % 3 == 0, "pattern").otherwise("fact").alias("kind"), said.alias("statement"), ((F.col("c_custkey") % 100) / 100.0).alias("confidence"), F.lit(None).cast("string").alias("category"), F.col("c_custkey").alias("ord"))
    ledger = spark.createDataFrame([], ENTRY)
    for i, day in enumerate(_DAYS):
        ledger = absorb(ledger, rows.where(F.col("ord") % 2 == i), day).drop("today_confidence", "opened")
    return ledger.select("kind", "fingerprint", "seen_count", "last_seen", F.array_join("statements", "|").alias("statements"), F.size("confidence_history").cast("long").alias("kept"), F.round(F.aggregate("confidence_history", F.lit(0.0), lambda x, y: x + y), 6).alias("confidence"))


@query("""WITH f AS (SELECT 'user ' || user_id AS ref, count(*) FILTER (event_type = 'click') AS n, bool_or(event_type = 'purchase') AS ok FROM events GROUP BY 1)
SELECT ref, n, n >= 2 AS dead FROM f WHERE n > 0""")
def failure_counts(spark, d):
    """M12, ST3: clicks stand for failures."""
    e = table(spark, d, "events").select(F.concat(F.lit("user "), "user_id").alias("ref"), "event_type")
    none = spark.createDataFrame([], "ref string, n long")
    return M.count_failures(none, e.where("event_type = 'click'"), e.where("false"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN 'new' ELSE c_mktsegment END AS segment FROM customer")
def keyed_upsert(spark, d):
    """M9-M10."""
    old = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = table(spark, d, "customer").where("c_nationkey < 10").select("c_custkey", F.lit("new").alias("segment"))
    return M.upsert(old, new, ["c_custkey"])


@query("SELECT ord, item FROM (SELECT o_orderpriority AS item, min(o_orderkey) AS ord FROM orders GROUP BY 1) ORDER BY ord LIMIT 100")
def excluded_items(spark, d):
    """D3."""
    return L.excluded(table(spark, d, "orders").select(F.col("o_orderpriority").alias("item"), F.col("o_orderkey").alias("ord")))

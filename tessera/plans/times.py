"""Queries over costs, sessions and the timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import cost as C
from tessera.operators import timeline as T
from tessera.plans.registry import query
from tessera.sources.star import slug, table
from tessera.streaming import ingest

NOW = "2024-01-25 12:00:00"


def _cost(spark, d):
    return table(spark, d, "events").select(
        "ts", F.col("event_type").alias("command"), F.concat(F.lit("model-"), F.col("user_id") % 5).alias("model"), F.length("props").cast("long").alias("input_tokens"),
        F.col("event_id").alias("output_tokens"), F.round("value", 4).alias("usd"), (F.col("user_id") / 8.0).alias("elapsed_s"),
    )


def _summary(by: str) -> str:
    g = {"command": "event_type", "model": "'model-' || (user_id % 5)"}[by]
    aggs = "count(*) AS calls, sum(length(props))::BIGINT AS input_tokens, sum(event_id)::BIGINT AS output_tokens, round(sum(round(value, 4)), 4) AS usd, round(sum(user_id / 8.0), 4) AS elapsed_s, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first_seen, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_seen"
    where = f"FROM events WHERE ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 10 DAYS AND TIMESTAMP '{NOW}'"
    return f'SELECT {g} AS "group", {aggs} {where} GROUP BY 1 UNION ALL SELECT \'TOTAL\', {aggs} {where}'


@query(_summary("command"))
def cost_summary_by_command(spark, d):
    """A3."""
    return C.summarize(_cost(spark, d), NOW, 10).withColumn("usd", F.round("usd", 4))


@query(_summary("model"))
def cost_summary_by_model(spark, d):
    """A3."""
    return C.summarize(_cost(spark, d), NOW, 10, "model").withColumn("usd", F.round("usd", 4))


_MONTH = "coalesce(sum(round(value, 4)) FILTER (ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'), 0)"


@query(f"SELECT round({_MONTH}, 4) AS usd FROM events")
def month_to_date_cost(spark, d):
    """A4: one row, from a partial sum of every partition."""
    return C.month_to_date(_cost(spark, d), NOW).select(F.round("usd", 4).alias("usd"))


@query(f"SELECT round(usd, 4) AS usd, round(usd / 1000, 6) AS ratio, round(greatest(1000 - usd, 0), 4) AS remaining, usd >= 1000 AS over, usd / 1000 >= 0.8 AND usd < 1000 AS warn FROM (SELECT {_MONTH} AS usd FROM events)")
def cost_cap_status(spark, d):
    """A5, Z40."""
    return C.cap_status(C.month_to_date(_cost(spark, d), NOW), 1000.0).select(F.round("usd", 4).alias("usd"), F.round("ratio", 6).alias("ratio"), F.round("remaining", 4).alias("remaining"), "over", "warn")


@query("""SELECT event_id, CASE WHEN nullif(event_id % 3, 0) IS NULL THEN length(props) ELSE event_id % 3 END::BIGINT AS tokens, CASE WHEN event_type = 'click' THEN 0.0 ELSE round_even(greatest(value - 50, 0.0), 8) END AS usd,
  CASE WHEN event_type = 'click' THEN 'unknown' ELSE 'provider' END AS pricing_source FROM events""")
def usage_prices(spark, d):
    """A22, X24, Z20."""
    e = table(spark, d, "events").withColumns({"tokens": C.usage([F.col("event_id") % 3], F.length("props").cast("long")), "provider_usd": F.when(F.col("event_type") != "click", F.col("value") - 50), "elapsed_s": F.lit(0.0)})
    return C.cost_event(e).select("event_id", "tokens", "usd", "pricing_source")


@query("""WITH f AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'accept' WHEN user_id % 3 = 1 THEN 'reject' ELSE 'weight' END AS action, CASE WHEN user_id % 3 = 2 THEN value / 50.0 END AS w, CASE WHEN user_id % 2 = 0 THEN 'why' ELSE '' END AS reason FROM events)
SELECT event_id, action, round_even(coalesce(w, CASE action WHEN 'accept' THEN 0.2 ELSE -0.3 END), 4) AS weight FROM f WHERE coalesce(w, 0) BETWEEN -1 AND 1 AND (action <> 'reject' OR reason <> '')""")
def feedback_events(spark, d):
    """X25, Z19."""
    u = F.col("user_id")
    e = table(spark, d, "events").select("event_id", F.when(u % 3 == 0, F.lit("accept")).when(u % 3 == 1, F.lit("reject")).otherwise(F.lit("weight")).alias("action"), F.when(u % 3 == 2, F.col("value") / 50.0).alias("weight"), F.when(u % 2 == 0, F.lit("why")).otherwise(F.lit("")).alias("reason"))
    return C.feedback_event(e).select("event_id", "action", "weight")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTES, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS events FROM h GROUP BY user_id, n""")
def settled_sessions(spark, d):
    """ST4."""
    s = ingest.settled_sessions(table(spark, d, "events"))
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("user_id", f("start"), f("end"), "events")


@query("""SELECT event_id, map_from_entries([('n', event_id), ('k', user_id)])['n'] AS n, user_id AS k FROM events""")
def parsed_counters(spark, d):
    """Written as a line of counters and read again."""
    line = F.concat(F.lit("n=1 k+="), "user_id", F.lit(" text n="), "event_id")
    m = table(spark, d, "events").select("event_id", X.counters(line).alias("m"))
    return m.select("event_id", F.col("m")["n"].alias("n"), F.col("m")["k"].alias("k"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end FROM orders""")
def source_dates(spark, d):
    """X8-X9."""
    o = table(spark, d, "orders")
    ref = F.when(F.col("o_orderkey") % 3 == 0, F.lit("codex:sessions/2026/13/40/x")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("codex:sessions/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/rollout"))).otherwise(F.concat(F.lit("claude-code:"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".jsonl")))
    return o.select("o_orderkey", X.source_date(ref).alias("day"), X.iso_or_month(F.date_format("o_orderdate", "yyyy-MM")).cast("string").alias("month_end"))


def _cards(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        slug("order", "o_orderkey").alias("card_id"), F.when(k % 4 == 0, F.lit("card_company")).otherwise(F.lit("card_project")).alias("source_kind"), F.col("o_orderpriority").alias("display_name"),
        F.when(F.col("o_orderstatus") == "O", F.lit("active")).otherwise(F.lit("archived")).alias("status"), F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM")).alias("period_end"),
        F.when(k % 7 != 0, day).otherwise(F.concat(day, F.lit("T00:00:00+00:00"))).alias("created"), F.when(k % 8 == 0, day).alias("last_reviewed"), F.col("o_totalprice").alias("distance"), F.col("o_orderpriority").alias("document"),
    )


_CARDS = """k AS (SELECT 'order-' || o_orderkey AS card_id, o_orderkey AS k, o_orderdate::DATE AS day, o_orderstatus AS st, o_totalprice AS distance, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS made, o_orderkey % 4 = 0 AS co FROM orders),
t AS (SELECT *, CASE WHEN NOT co AND k % 2 = 0 THEN 'period_end' WHEN NOT co AND st = 'O' THEN 'today_fallback' WHEN co AND k % 8 = 0 THEN 'last_reviewed' WHEN made IS NOT NULL THEN 'created' ELSE 'no_time_meta' END AS src FROM k),
c AS (SELECT *, CASE src WHEN 'period_end' THEN last_day(day) WHEN 'today_fallback' THEN DATE '2026-05-12' WHEN 'last_reviewed' THEN day WHEN 'created' THEN made END AS tt FROM t)"""
TODAY = "2026-05-12"


@query(f"WITH {_CARDS} SELECT card_id, src AS sort_ts_source, tt::VARCHAR AS sort_ts FROM c")
def timeline_sort_ts(spark, d):
    """W1, X9."""
    return T.sort_time(_cards(spark, d), TODAY).select("card_id", "sort_ts_source", F.col("sort_ts").cast("string").alias("sort_ts"))


@query(f"""WITH {_CARDS} SELECT year(tt) || ' Q' || quarter(tt) AS label, max(tt)::VARCHAR AS sort_ts, count(*)::INT AS n, sha256(string_agg(card_id, ',' ORDER BY tt DESC, made DESC NULLS LAST, card_id)) AS members,
(SELECT string_agg(m, ',') FROM (SELECT unnest(list_reverse_sort(list(DISTINCT month(tt)))) AS m)) AS months FROM c WHERE src <> 'no_time_meta' GROUP BY year(tt), quarter(tt)""".replace("(SELECT string_agg(m, ',') FROM (SELECT unnest(list_reverse_sort(list(DISTINCT month(tt)))) AS m))", "array_to_string(list_reverse_sort(list(DISTINCT month(tt))), ',')"))
def timeline_quarters(spark, d):
    """W2, S1."""
    q = T.quarters(T.sort_time(_cards(spark, d), TODAY))
    return q.select("label", F.col("sort_ts").cast("string").alias("sort_ts"), F.size("members").alias("n"), F.sha2(F.array_join("members", ","), 256).alias("members"), F.array_join(F.transform("months", lambda m: m.cast("string")), ",").alias("months"))


@query(f"""WITH {_CARDS}, r AS (SELECT *, row_number() OVER (ORDER BY tt IS NULL, tt DESC, CASE WHEN tt IS NOT NULL THEN made END DESC NULLS LAST, distance, card_id) AS rank FROM c),
q AS (SELECT year(tt) AS y, quarter(tt) AS q, count(*) AS n, count(DISTINCT month(tt)) AS m FROM c WHERE tt IS NOT NULL GROUP BY 1, 2),
h AS (SELECT rank, card_id, coalesce(year(tt) || ' Q' || quarter(tt), '## 시간 정보 없음 — distance 순 폴백') AS head, strftime(tt, '%Y-%m') AS mon, n, m FROM r LEFT JOIN q ON year(tt) = y AND quarter(tt) = q WHERE rank <= 50)
SELECT rank, card_id, CASE WHEN head IS DISTINCT FROM lag(head) OVER (ORDER BY rank) THEN head END AS header, CASE WHEN n >= 2 AND m >= 2 AND mon IS DISTINCT FROM lag(mon) OVER (ORDER BY rank) THEN mon END AS month_header FROM h""")
def timeline_limit(spark, d):
    """The first 50 lines (the limit is the feature)."""
    return T.limited(T.sort_time(_cards(spark, d), TODAY), 50).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_CARDS} SELECT card_id, '- **' || card_id || '** (' || o_orderpriority || ') — ' || coalesce(tt::VARCHAR, '0001-01-01') || CASE src WHEN 'today_fallback' THEN ' (오늘 ' || tt || ')' WHEN 'created' THEN ' (created)' WHEN 'last_reviewed' THEN ' (last reviewed)' ELSE '' END
|| chr(10) || '  > ' || o_orderpriority || chr(10) || '  [' || CASE WHEN co THEN 'card_company' ELSE 'card_project' END || ':' || card_id || ']' AS line FROM c JOIN orders ON k = o_orderkey""")
def timeline_lines(spark, d):
    """Z24."""
    return T.sort_time(_cards(spark, d), TODAY).select("card_id", T.line().alias("line"))

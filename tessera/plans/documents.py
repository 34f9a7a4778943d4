"""Queries over texts, logs and statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import metrics as R
from tessera.operators import similarity as S
from tessera.plans.registry import query
from tessera.sources import raw
from tessera.sources import pages as P
from tessera.sources.star import table

# DuckDB's \s is ASCII; driver texts hold no other white space.
_FLAT = "regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"
_NORM = "regexp_replace(lower(" + _FLAT + "), '[ .。!?:,;・…]+$', '')"


def _chat_lines(spark, d):
    """conversations as JSON lines of a client, the second of every three as a list of blocks."""
    c = table(spark, d, "conversations")
    block = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message")))
    plain = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    return c.select(F.col("conv_id").alias("ref"), F.col("turn").alias("line"), F.when(F.col("turn") % 3 == 1, block).otherwise(plain).alias("raw"))


def _codex_lines(spark, d):
    c = table(spark, d, "conversations")
    user = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("user_message").alias("type"), F.col("text").alias("message")).alias("payload")))
    other = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("output_text").alias("type"), "text")).alias("content")).alias("payload")))
    return c.select(F.col("conv_id").alias("ref"), F.col("turn").alias("line"), F.when(F.col("role") == "user", user).otherwise(other).alias("raw"))


@query("SELECT conv_id AS ref, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def raw_doc_assembly(spark, d):
    """SC12, FP3."""
    return raw.documents(_chat_lines(spark, d))


_CODEX = "SELECT conv_id AS ref, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE text <> '' AND role IN ('user', 'assistant') GROUP BY conv_id"


@query(_CODEX)
def codex_doc_assembly(spark, d):
    """SC12, FP4."""
    return raw.documents(_codex_lines(spark, d), "codex")


@query("""SELECT lang, count(*) AS pending, count(*) FILTER (length(text) <= 1000) AS small, count(*) FILTER (length(text) > 1000 AND length(text) <= 4000) AS sampled, count(*) FILTER (length(text) > 4000) AS oversize,
  sum(CASE WHEN length(text) <= 1000 THEN 2 WHEN length(text) <= 4000 THEN 1 ELSE 0 END)::BIGINT AS calls, max(length(text))::BIGINT AS max_chars FROM documents GROUP BY lang""")
def ingest_route_audit(spark, d):
    """FP7, A6; lower bounds than the defaults, so that all routes occur."""
    return R.ingest_audit(table(spark, d, "documents"), ("lang",), small=1000, sampled=4000)


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE floor(length(regexp_replace(text, '[^가-힣]', '', 'g')) / 1.5 + (length(text) - length(regexp_replace(text, '[^가-힣]', '', 'g'))) / 4.0)::BIGINT + 1 END AS tokens FROM documents")
def token_estimate(spark, d):
    """X7."""
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens("text").alias("tokens"))


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def normalize_text(spark, d):
    """X1."""
    return table(spark, d, "documents").select("doc_id", X.normalize("text").alias("norm"))


def _slug_sql(c: str, outside: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(replace(trim({c}), ' ', '-')), '{outside}', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), ''), 'untitled')"


@query(f"SELECT doc_id, {_slug_sql('text', '[^0-9a-z가-힣-]+')} AS page_slug, {_slug_sql('text', '[^a-zA-Z0-9가-힣_-]+')} AS card_slug, '2026-05-12-' || left({_slug_sql('text', '[^a-zA-Z0-9가-힣_-]+')}, 40) AS insight_id FROM documents")
def slugs(spark, d):
    """X4-X6."""
    t = F.col("text")
    made = table(spark, d, "documents").select("doc_id", X.slugify(t).alias("page_slug"), X.slugify_card(t).alias("card_slug"))
    return made.select("doc_id", "page_slug", "card_slug", X.insight_id(t, F.lit("2026-05-12").cast("date"), "card_slug").alias("insight_id"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS t, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) AS i FROM pages),
f AS (SELECT page_id, trim(split_part(t, '|', 1)) AS t, min(i) AS i FROM l WHERE t NOT LIKE '%]%' GROUP BY 1, 2)
SELECT p.page_id, coalesce((SELECT string_agg(t, ' ' ORDER BY i) FROM f WHERE f.page_id = p.page_id AND t <> ''), '') AS links FROM pages p""")
def link_extract(spark, d):
    """Page links, written as wikilinks."""
    t = F.regexp_replace("html", 'href="([^"]+)"', "[[$1]]")
    return table(spark, d, "pages").select("page_id", F.array_join(F.filter(X.wikilinks(F.array_join(F.regexp_extract_all(t, F.lit(r"\[\[[^\]]+\]\]"), F.lit(0)), " ")), lambda s: F.lit(True)), " ").alias("links"))


@query(f"""WITH t AS (SELECT doc_id, {_FLAT.format("text")} AS f FROM documents)
SELECT doc_id, CASE WHEN length(f) <= 240 THEN f ELSE rtrim(left(f, 239)) || '…' END AS line, CASE WHEN length(f) <= 240 THEN f ELSE rtrim(left(f, 240)) || '...' END AS summary FROM t""")
def clipped(spark, d):
    """X14, X18 (both marks), FP10."""
    return table(spark, d, "documents").select("doc_id", X.one_line("text").alias("line"), X.summarize("text", 240, X.DOTS).alias("summary"))


@query(r"""SELECT doc_id, regexp_replace(text, '(?i)(session[_-]?id|request[_-]?id|api[_-]?key|authorization|token)(["'']?\s*[:=]\s*["'']?)(?:(?:bearer|basic|token)\s+)?[^"''\s,}]+', '\1\2<redacted>', 'g') AS redacted FROM documents""")
def redacted(spark, d):
    """X13."""
    return table(spark, d, "documents").select("doc_id", X.redact("text").alias("redacted"))


@query("""SELECT doc_id, left(sha256(text), 16) AS file_hash, 'pattern-' || left(sha1(lang || '|' || source), 12) AS pattern_id, regexp_replace(rtrim(left(regexp_replace(trim(regexp_replace(text, '[\\\\/\\x00\\r\\n]', '-', 'g')), '^\\.+|\\.+$', '', 'g'), 80)), '\\.+$', '') AS name FROM documents""")
def identifiers(spark, d):
    """X10-X11, X26, Z18."""
    return table(spark, d, "documents").select("doc_id", X.file_hash("text").alias("file_hash"), X.pattern_id("lang", "source").alias("pattern_id"), X.safe_filename(F.col("text")).alias("name"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE lang END AS locale, 'company_card' AS origin FROM documents")
def locales(spark, d):
    """X21."""
    r = X.resolve_locale(F.lit(None).cast("string"), F.col("lang"), F.lit("ko"))
    return table(spark, d, "documents").withColumn("r", r).select("doc_id", F.col("r.locale").alias("locale"), F.col("r.source").alias("origin"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', round_even(n / 1024.0, 1)) ELSE printf('%.1f MiB', round_even(n / 1048576.0, 1)) END AS size FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def human_sizes(spark, d):
    """X20."""
    return table(spark, d, "documents").select("doc_id", X.human_bytes(F.octet_length("text").cast("long")).alias("size"))


@query(f"""WITH docs AS ({_CODEX}), l AS (SELECT ref, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
f AS (SELECT ref, i, {_FLAT.format("s")} AS s FROM l), g AS (SELECT * FROM f WHERE s LIKE 'User:%' OR s LIKE 'Assistant:%'),
c AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY ref ORDER BY i) AS used FROM g)
SELECT d.ref, coalesce(string_agg(c.s, chr(10) ORDER BY c.i) FILTER (used <= 600), '') AS signals FROM docs d LEFT JOIN c ON d.ref = c.ref GROUP BY d.ref""")
def budgeted_lines(spark, d):
    """W4."""
    docs = raw.documents(_codex_lines(spark, d), "codex")
    return docs.select("ref", F.array_join(R.signal_lines("text", 600), "\n").alias("signals"))


@query("""SELECT doc_id, trim(left('# 원문 정보' || chr(10) || '- 원문 문자 수: ' || length(text) || chr(10) || '- 처리 방식: 비용 제한 샘플. 전체 원문은 raw ref를 통해 보존됨.' || chr(10) || chr(10) || '# 앞부분 샘플' || chr(10)
  || trim(left(text, 100), ' ' || chr(10)) || chr(10) || chr(10) || '# 고신호 라인' || chr(10) || '(추출된 고신호 라인 없음)' || chr(10) || chr(10) || '# 뒷부분 샘플' || chr(10) || trim(right(text, 100), ' ' || chr(10)), 300), ' ' || chr(10)) AS sample FROM documents""")
def sample_text(spark, d):
    """W5, with small edges."""
    return table(spark, d, "documents").select("doc_id", R.sample_text("text", 100, 0, 300).alias("sample"))


_WHOLE = _NORM.format("text")
_WHOLE_WORDS = f"list_filter(list_distinct(string_split({_WHOLE}, ' ')), lambda x: x <> '')"
_WHOLE_SETS = f"""c AS (SELECT doc_id, {_WHOLE} AS n, {_WHOLE_WORDS} AS w FROM documents), k AS (SELECT DISTINCT {_WHOLE} AS n, {_WHOLE_WORDS} AS w FROM benchmark),
p AS (SELECT c.doc_id, c.n = k.n AS same, len(list_intersect(c.w, k.w)) AS shared, len(c.w) + len(k.w) AS total FROM c, k WHERE len(c.w) > 0 AND len(k.w) > 0),
j AS (SELECT doc_id, max(CASE WHEN same THEN 1.0 ELSE shared / (total - shared)::DOUBLE END) AS s FROM p WHERE same OR shared / (total - shared)::DOUBLE >= 0.75 GROUP BY 1)"""


def _whole_claims(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("statement")), table(spark, d, "benchmark").select(F.col("text").alias("statement"))


@query(f"WITH {_WHOLE_SETS} SELECT c.doc_id, round(s, 9) AS best FROM c LEFT JOIN j USING (doc_id)")
def jaccard_dedupe(spark, d):
    """J7 (CQ08): whole documents against the whole benchmark."""
    c, k = _whole_claims(spark, d)
    return S.best_scores(c, k).select("doc_id", F.round("best", 9).alias("best"))


@query(f"WITH {_WHOLE_SETS}, f AS (SELECT n, min(doc_id) AS f FROM c GROUP BY n) SELECT c.doc_id, c.n <> '' AND j.s IS NULL AND c.doc_id = f.f AS kept FROM c LEFT JOIN j USING (doc_id) JOIN f ON c.n = f.n")
def exact_dedupe(spark, d):
    """Whole documents against the whole benchmark."""
    c, k = _whole_claims(spark, d)
    return S.dedupe(c, k, "doc_id").select("doc_id", "kept")


@query(f"""WITH w AS (SELECT doc_id, list_distinct(string_split({_WHOLE}, ' ')) AS w FROM documents), b AS (SELECT item_id, list_distinct(string_split({_WHOLE}, ' ')) AS w FROM benchmark)
SELECT doc_id, item_id, len(w.w)::INT AS n, round(len(list_intersect(w.w, b.w)) / (len(w.w) + len(b.w) - len(list_intersect(w.w, b.w)))::DOUBLE, 9) AS score
FROM w JOIN b ON item_id = doc_id % (SELECT count(*) FROM benchmark)""")
def token_jaccard(spark, d):
    """Each document against one benchmark passage, in turn."""
    b = table(spark, d, "benchmark")
    docs = table(spark, d, "documents").select("doc_id", X.tokens("text").alias("w"), (F.col("doc_id") % b.count()).alias("item_id"))
    return docs.join(b.select("item_id", X.tokens("text").alias("b")), "item_id").select("doc_id", "item_id", F.size("w").alias("n"), F.round(X.jaccard(F.col("w"), F.col("b")), 9).alias("score"))


@query("SELECT conv_id AS ref, turn AS line, role <> 'system' AS keep FROM conversations")
def compact_keep_lines(spark, d):
    """FP5-FP6."""
    return raw.kept_lines(_codex_lines(spark, d), "codex").select("ref", "line", "keep")


@query("SELECT conv_id AS ref, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line, text AS raw FROM conversations")
def rehydrate(spark, d):
    """User lines kept, the rest dropped, and both put together again."""
    from pyspark.sql import Window

    c = table(spark, d, "conversations").withColumn("line", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).withColumnRenamed("conv_id", "ref")
    kept = c.where("role = 'user'").select("ref", (F.row_number().over(Window.partitionBy("ref").orderBy("line")) - 1).alias("pos"), F.col("text").alias("raw"))
    return raw.rehydrated(kept, c.where("role <> 'user'").select("ref", "line", F.col("text").alias("raw")))


@query("""WITH t AS (SELECT *, row_number() OVER (ORDER BY conv_id DESC, turn DESC) AS r FROM conversations WHERE text <> '') SELECT conv_id, turn, '[' || right('conversation-of-project-number-' || conv_id, 30) || '] ' || text AS text FROM t WHERE r <= 200""")
def history_tail(spark, d):
    """SC26: the last 200 lines of a history (the feature is the tail)."""
    c = table(spark, d, "conversations")
    lines = c.select(F.struct("conv_id", "turn").alias("line"), F.to_json(F.struct(F.col("text").alias("display"), F.concat(F.lit("conversation-of-project-number-"), "conv_id").alias("project"))).alias("raw"))
    return raw.history_tail(lines, 200).select("line.conv_id", "line.turn", "text")


def _page_lines(spark, d):
    """Conversations as profile pages: a system turn heads a section, assistant turns are third-level headings, user turns bullets."""
    c = table(spark, d, "conversations")
    head = F.when(F.col("role") == "system", F.concat(F.lit("## "), F.when(F.col("conv_id") % 2 == 0, F.lit("Approved Patterns")).otherwise(F.lit("Preference")))).when(F.col("role") == "assistant", F.concat(F.lit("### heading "), "turn")).otherwise(F.concat(F.lit("- [0.92] fact "), "turn"))
    return c.select(F.col("conv_id").alias("page"), F.col("turn").alias("pos"), head.alias("line"))


@query("""WITH l AS (SELECT conv_id AS page, turn AS pos, role, last_value(CASE WHEN role = 'system' THEN conv_id % 2 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations)
SELECT page, pos, 'fact ' || pos AS statement FROM l WHERE role = 'user' AND h IS NOT NULL""")
def fill_forward_headings(spark, d):
    """SC31: bullets under any second-level heading other than decision patterns and the page's own."""
    return P.profile_facts(_page_lines(spark, d))


@query("""WITH l AS (SELECT conv_id AS page, turn AS pos, role, last_value(CASE WHEN role = 'system' THEN conv_id % 2 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations)
SELECT page, pos, 'heading ' || pos AS trigger FROM l WHERE role = 'assistant' AND h = 0""")
def approved_triggers(spark, d):
    """SC32."""
    return P.pattern_triggers(_page_lines(spark, d))


@query("""WITH l AS (SELECT conv_id AS page, turn, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS rec FROM conversations),
g AS (SELECT page, rec, max(turn) FILTER (role = 'user') AS t, max(turn) FILTER (role = 'assistant') AS a FROM l GROUP BY 1, 2)
SELECT page, 'pattern-' || left(sha1('when ' || t || '|do ' || a), 12) AS pattern_id, 'when ' || t AS trigger, 'do ' || a AS action FROM g WHERE t IS NOT NULL AND a IS NOT NULL""")
def pattern_records(spark, d):
    """SC33."""
    c = table(spark, d, "conversations")
    line = F.when(F.col("role") == "user", F.concat(F.lit("- trigger: when "), "turn")).when(F.col("role") == "assistant", F.concat(F.lit("  action: do "), "turn")).otherwise(F.lit("# note"))
    return P.pattern_records(c.select(F.col("conv_id").alias("page"), F.col("turn").alias("pos"), line.alias("line")))


@query("SELECT doc_id, source AS slug, text AS body FROM documents")
def front_matter(spark, d):
    """SC1-SC3: documents written as pages and read again."""
    docs = table(spark, d, "documents")
    text = P.page_text(docs.select("doc_id", F.to_json(F.struct(F.col("source").alias("slug"))).alias("meta"), F.col("text").alias("body")))
    back = P.split_front_matter(text.select("doc_id", "text"))
    return back.select("doc_id", F.get_json_object("yaml", "$.slug").alias("slug"), F.regexp_replace("body", r"\A\n", "").alias("body"))

"""One query for each operator of this package, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, chat, exact_dedup, mixing, phrases, pieces, quality, repeats, secrets, sharding, simhash, structure, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex(col: str):
    return F.lower(F.hex(col))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at 3 or fewer differing bits."""
    out = simhash.fingerprint_components(_table(spark, sf_dir, "documents"), 3, 3)
    return out.select("doc_id", F.lpad(_hex("fingerprint"), 16, "0").alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.decisions(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", _hex("digest").alias("text_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.read_warc(warc.archive_pages(_table(spark, sf_dir, "pages")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    n = [F.size(F.expr(f"filter(spans, s -> s.kind = {i})")).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)]
    return out.select("doc_id", *n, F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


#: Sources may be repeated up to twice; the budget is the least that reads every document.
MAX_REPEATS = 2.0
SEED = 17


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each reading of a document: its source's exponent and weight, the reading, its key in the permutation."""
    out = mixing.mix(_table(spark, sf_dir, "documents"), max_repeats=MAX_REPEATS, seed=SEED)
    return out.select("doc_id", "source", F.round("mix_alpha", 6).alias("alpha"), F.round("mix_weight", 6).alias("weight"), F.col("mix_epoch").alias("epoch"), F.col("mix_key").alias("position_key"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256"), check="documents")


#: Conversation -1.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return chat.read_back(chat.to_events(rows.unionByName(extra)))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels)
    return quality.score(docs, model, keep=("doc_id",)).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of windows of 35 words that also start elsewhere are removed."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), texts_out=False)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of 2 to 4 words."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of each damaged conversation."""
    return structure.repair_damaged(_table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_exact_dedup, op3_warc, op4_secrets, op5_mixing, op6_sentencepiece, op7_chat, op8_ann, op9_sharding, op10_quality, op11_repeats, op12_phrases, op13_structure)}


_SPACES = r"[\x20\x09-\x0D]+"
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _op2() -> str:
    return f"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)"""


def _op3() -> str:
    return f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM t),
f AS (SELECT *, CASE WHEN payload_bytes >= {warc.MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f"""


def _op4() -> str:
    rules = [(0, "assign", _ASSIGN, 2, 6), (1, "access", "AKIA[A-Z0-9]+", 0, 20), (2, "hex", "[0-9a-f]+", 0, 24)]
    rules += [(i, r.kind, r.pattern, 0, 1) for i, r in enumerate(secrets.RULES) if i >= 3]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS g, regexp_split_to_array(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')"
        for i, kind, p, g, least in rules
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
e AS (SELECT doc_id, k, kind, m[i] AS m,
             (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f) WHERE length(g[i]) >= least),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, k) FILTER (k < 3) AS base,
             string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, k) AS spans FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


def _op5() -> str:
    word = mixing.WORD
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{word}'))::BIGINT AS tokens FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY source),
r AS (SELECT ln(max(tokens)::DOUBLE / min(tokens)) AS spread FROM s WHERE tokens > 0),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
      UNION ALL
      SELECT i + 1, CASE WHEN (1 - (lo + hi) / 2) * spread > ln({MAX_REPEATS}::DOUBLE) THEN (lo + hi) / 2 ELSE lo END,
             CASE WHEN (1 - (lo + hi) / 2) * spread > ln({MAX_REPEATS}::DOUBLE) THEN hi ELSE (lo + hi) / 2 END
      FROM b, r WHERE i < {mixing.STEPS}),
a AS (SELECT round(hi, {mixing.DIGITS}) AS alpha FROM b WHERE i = {mixing.STEPS}),
p AS (SELECT source, tokens, alpha, CASE WHEN tokens > 0 THEN pow(tokens / sum(tokens) OVER ()::DOUBLE, alpha) ELSE 0 END AS raw FROM s, a),
w AS (SELECT source, tokens, alpha, raw / sum(raw) OVER () AS weight FROM p),
q AS (SELECT *, floor(weight * max(CASE WHEN weight > 0 THEN tokens / weight END) OVER () + 1e-6)::BIGINT AS quota FROM w),
v AS (SELECT d.doc_id, d.source, d.tokens, alpha, weight, CASE WHEN q.tokens = 0 THEN 1 ELSE quota // q.tokens END AS passes,
             CASE WHEN q.tokens = 0 THEN -1 ELSE quota % q.tokens END AS rest
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY ('0x' || left(md5('{SEED}:' || passes || ':' || doc_id), 15))::BIGINT) AS upto FROM v),
e AS (SELECT doc_id, source, alpha, weight, unnest(range(0, passes + (upto <= rest)::BIGINT)) AS epoch FROM c)
SELECT doc_id, source, round(alpha, 6) AS alpha, round(weight, 6) AS weight, epoch, ('0x' || left(md5('{SEED}:' || epoch || ':' || doc_id), 15))::BIGINT AS position_key
FROM e"""


def _op7() -> str:
    controls = "|".join(c.translate(str.maketrans({x: "\\" + x for x in "[]|<>/"})).replace("\\<", "<").replace("\\>", ">").replace("\\/", "/") for c in chat.CONTROLS)
    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in chat.MARKS.items())
    named = sum(map(len, (*chat.NAMED, *chat.NAME)))
    more = lambda c: f"length({c}) + length({c}) - length(replace({c}, '\\', '')) + len(regexp_extract_all({c}, '{controls}'))"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({more('text')} + CASE role {marks} ELSE {named} + {more('role')} END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


def _op12() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH d AS (SELECT coalesce(lang, '{phrases.NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?
-
]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM d),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, {phrases.DEPTH + 1})) AS k)) GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.j, f.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (f.a::HUGEINT + r.a) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
      JOIN g f ON f.lang = c.lang AND f.phrase = array_to_string(c.w[1:c.j], ' ')
      JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
h AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
      FROM b LEFT JOIN h ON b.lang = h.lang AND b.phrase = h.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < {phrases.INSIDE}::HUGEINT * b.a)
SELECT q.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM q JOIN n ON q.lang = n.lang WHERE rank <= {phrases.TOP}"""


def _op13() -> str:
    lines = {0: "[]::VARCHAR[]", 1: "['user:']", 2: "['user:', 'assistant:']"}
    inserted = lambda q, n: lines[n] if q != structure.USER else {0: lines[0], 1: "['assistant:']", 2: "['assistant:', 'user:']"}[n]
    values = []
    for (initial, gone), moves in structure.MOVES.items():
        for q, t, cost, code in moves:
            edits = structure.CODES[code]
            role = f"'{structure.ROLE[t]}'" if edits[-1] == "R" else "''"
            values.append(f"('{initial}', {str(gone).lower()}, {q}, {t}, {cost}, '{edits}', {inserted(q, len(edits) - 1)}, {role})")
    ends = ", ".join(f"({q}, {structure.INSERT * n}, '{'I' * n}', {inserted(q, n)})" for q, n in structure.CLOSING.items())
    return rf"""
WITH RECURSIVE z AS (SELECT list(list_reduce(list_prepend(n::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
                             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, z),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM k WHERE kind <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS c,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS m FROM f GROUP BY conv_id),
moves(c, gone, q, t, cost, edits, pre, named) AS (VALUES {', '.join(values)}),
ends(q, cost, edits, post) AS (VALUES {ends}),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS b FROM n
       UNION ALL
       SELECT dp.conv_id, dp.i + 1, t, min({{'cost': b.cost + moves.cost + CASE WHEN fault = 'truncated' AND right(edits, 1) <> 'D' THEN {structure.CUT_OFF} ELSE 0 END, 'audit': b.audit || edits,
              'lines': list_concat(b.lines, pre, CASE right(edits, 1) WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [named || ':' || text] END)}})
       FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
       JOIN moves ON moves.q = dp.q AND moves.c = CASE WHEN f.c IN ('s', 'u', 'a') THEN f.c ELSE '' END AND moves.gone = (fault IN ('blank', 'duplicate'))
       GROUP BY dp.conv_id, dp.i + 1, t),
e AS (SELECT n.conv_id, min({{'cost': b.cost + ends.cost, 'audit': b.audit || edits, 'lines': list_concat(b.lines, post)}}) AS b
      FROM n JOIN dp ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.i = n.m JOIN ends ON ends.q = dp.q GROUP BY n.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": _op2(), "op3_warc": _op3(), "op4_secrets": _op4(), "op5_mixing": _op5(), "op7_chat": _op7(), "op12_phrases": _op12(), "op13_structure": _op13()}

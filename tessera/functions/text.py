"""Scalar text functions as column expressions (no Python UDF but where stated).

Nulls: unless stated otherwise a null input counts as the empty string. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters stripped from the end of a normalised statement; marks of a clipped text.
TRAILING = ".。!?:,;・…"
ELLIPSIS, DOTS = "…", "..."
# What a word of white space is (Unicode, as Python's str.split sees it).
BLANK = r"[\s\x1c-\x1f\x85   -     　]"
# Language names.
LOCALES = {
    "ko": "한국어", "kor": "한국어", "en": "English", "eng": "English", "ja": "Japanese", "jp": "Japanese", "jpn": "Japanese",
    "zh": "Chinese", "cn": "Chinese", "zh-cn": "Chinese", "es": "Spanish", "fr": "French", "de": "German", "pt": "Portuguese",
}
DEFAULT_LOCALE = "한국어"
# Fields whose values are hidden, status numbers, preambles, markers.
SENSITIVE = r"""(?i)(session[_-]?id|request[_-]?id|api[_-]?key|authorization|token)(["']?\s*[:=]\s*["']?)(?:(?:bearer|basic|token)\s+)?[^"'\s,}]+"""
STATUS = r"(?i)\b(?:status|code|error code)\D{0,8}(\d{3})\b"
PREAMBLE = r"(?i)^(?:\s*(?:Insight|Insights|Analysis|Observation|Thought|Note|Meta)\s*:\s*[^\n]*(?:\n+|$)\s*)+"
# Weights of feedback, characters for each token.
ACCEPT, REJECT = 0.2, -0.3
HANGUL_PER_TOKEN, OTHER_PER_TOKEN = 1.5, 4.0
LOG_CHARS = 240


def _c(x) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def collapse(x) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.btrim(F.regexp_replace(_c(x), f"{BLANK}+", " "), F.lit(" "))


def normalize(x) -> Column:
    """Collapsed, lower case, trailing punctuation gone."""
    return F.rtrim(F.lower(collapse(x)), F.lit(f" {TRAILING}"))


def tokens(x) -> Column:
    """Distinct words of the normalised text."""
    return F.array_distinct(F.filter(F.split(normalize(x), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """X3, over arrays of distinct words; an empty side gives 0."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def _slug(x, kept: str) -> Column:
    """One pass: what isn't kept becomes a hyphen, with the blanks and hyphens beside it; the ends have none."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(_c(x)), f"[^{kept}]+", "-"), F.lit("-")), F.lit("")), F.lit("untitled"))


def slugify(x) -> Column:
    """Lower-case ASCII letters, digits, Hangul syllables and hyphens."""
    return _slug(x, "0-9a-z가-힣")


def slugify_card(x) -> Column:
    """As X4, underscores stay."""
    return _slug(x, "a-zA-Z0-9가-힣_")


def insight_id(question, day, card: str | None = None) -> Column:
    """X6. card: a column that holds the question's ``slugify_card`` already."""
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("-"), F.left(F.col(card) if card else slugify_card(question), F.lit(40)))


def estimate_tokens(x) -> Column:
    """0 for an empty text."""
    t = _c(x)
    hangul = F.length(F.regexp_replace(t, "[^가-힣]", ""))
    n = F.floor(hangul / HANGUL_PER_TOKEN + (F.length(t) - hangul) / OTHER_PER_TOKEN) + 1
    return F.when(t == "", F.lit(0)).otherwise(n).cast("long")


def source_date(ref) -> Column:
    """The first YYYY-MM-DD or YYYY/MM/DD, null if that is no date."""
    part = lambda i: F.regexp_extract(_c(ref), r"(\d{4})[/-](\d{2})[/-](\d{2})", i)
    return F.date_format(F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd"), "yyyy-MM-dd")


def iso_or_month(x) -> Column:
    """YYYY-MM-DD, or the last day of YYYY-MM; else null."""
    t = _c(x)
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    month = F.when(t.rlike(r"^\d{1,4}-\d{1,2}$"), F.last_day(F.try_to_date(F.concat(F.lpad(F.split_part(t, F.lit("-"), F.lit(1)), 4, "0"), F.lit("-"), F.lpad(F.split_part(t, F.lit("-"), F.lit(2)), 2, "0")), "yyyy-MM")))
    return F.coalesce(day, month)


def pattern_id(trigger, action) -> Column:
    """X10."""
    return F.concat(F.lit("pattern-"), F.left(F.sha1(F.concat(_c(trigger), F.lit("|"), _c(action))), F.lit(12)))


def file_hash(content) -> Column:
    """X11: the first 16 hex digits of SHA-256."""
    return F.left(F.sha2(content, 256), F.lit(16))


def link_target(x) -> Column:
    """The inside of [[...]], without an alias."""
    t = F.trim(_c(x))
    inner = F.when(t.startswith("[[") & t.endswith("]]"), F.regexp_replace(t, r"^\[\[|\]\]$", "")).otherwise(t)
    return F.trim(F.split_part(inner, F.lit("|"), F.lit(1)))


def wikilinks(x) -> Column:
    """Distinct targets of [[...]], in order."""
    found = F.regexp_extract_all(_c(x), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.trim(F.split_part(t, F.lit("|"), F.lit(1)))), lambda t: t != ""))


def redact(x) -> Column:
    """X13."""
    return F.regexp_replace(_c(x), SENSITIVE, "$1$2<redacted>")


def one_line(x, most: int = LOG_CHARS) -> Column:
    """At most so many characters with the mark."""
    t = collapse(x)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(most - 1)), f"{BLANK}+$", ""), F.lit(ELLIPSIS)))


def log_message(x, most: int = LOG_CHARS) -> Column:
    """X13 then X14."""
    return one_line(redact(x), most)


def error_summary(x, kind: str = "Error") -> Column:
    """Status, provider, category and message of a JSON error, else the redacted line.

    Only JSON is read; other literals count as plain text.
    """
    t = _c(x)
    body = F.try_parse_json(F.regexp_extract(t, r"(?s)(\{.*\})", 1))
    get = lambda path: F.try_variant_get(body, path, "string")
    status = F.coalesce(F.nullif(F.regexp_extract(t, STATUS, 1), F.lit("")), get("$.status")).cast("int")
    category = F.coalesce(get("$.error.type"), get("$.error.code"), get("$.type"), get("$.code"), get("$.category"))
    message = F.coalesce(get("$.error.message"), get("$.message"))
    safe = F.to_json(F.struct(category.alias("category"), F.when(message.isNotNull(), log_message(message, 160)).alias("message"), get("$.provider").alias("provider"), F.coalesce(get("$.retry_after"), get("$.error.retry_after")).alias("retry_after"), status.alias("status")))
    return F.when(safe == "{}", one_line(F.concat(F.lit(f"{kind}: "), redact(t)))).otherwise(one_line(safe))


def strip_fence(x) -> Column:
    """The inside of a text that is one code fence."""
    t = F.regexp_replace(_c(x), r"^\s+|\s+$", "")
    fence = r"(?s)^```(?:json|JSON)?\s*\n?(.*?)\n?\s*```$"
    return F.when(t.rlike(fence), F.regexp_replace(F.regexp_extract(t, fence, 1), r"^\s+|\s+$", "")).otherwise(t)


def summarize(x, most: int = 200, mark: str = ELLIPSIS) -> Column:
    """The collapsed text, clipped to so many characters and a mark."""
    t = collapse(x)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(most))), F.lit(mark)))


def strip_preamble(x) -> Column:
    """Leading lines such as "Note: ..." go."""
    t = _c(x)
    return F.when(t.rlike(PREAMBLE), F.regexp_replace(t, PREAMBLE, "")).otherwise(F.regexp_replace(t, r"^\s+", ""))


def human_bytes(n) -> Column:
    """X20."""
    b = F.col(n) if isinstance(n, str) else n
    unit = lambda power, name: F.format_string(f"%.1f {name}", F.bround(b / float(1024**power), 1))
    return F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1024**2, unit(1, "KiB")).when(b < 1024**3, unit(2, "MiB")).otherwise(unit(3, "GiB"))


def locale_name(x) -> Column:
    """The name of a language code; unknown codes as they are, blank ones the default."""
    t = F.trim(_c(x))
    names = F.create_map(*[F.lit(v) for kv in LOCALES.items() for v in kv])
    return F.when(t == "", F.lit(DEFAULT_LOCALE)).otherwise(F.coalesce(F.try_element_at(names, F.lower(t)), t))


def resolve_locale(argument, company, profile) -> Column:
    """struct(locale, source) of the first that isn't blank."""
    pick = lambda c, name: F.when(F.trim(_c(c)) != "", F.struct(locale_name(c).alias("locale"), F.lit(name).alias("source")))
    return F.coalesce(pick(argument, "cli"), pick(company, "company_card"), pick(profile, "profile"), F.struct(F.lit(DEFAULT_LOCALE).alias("locale"), F.lit("default").alias("source")))


def counters(x) -> Column:
    """Map of ``key=1`` and ``key+=1``; the last of a key counts."""
    found = lambda i: F.regexp_extract_all(_c(x), F.lit(r"(\w+)\+?=(\d+)"), F.lit(i))
    keys, values = found(1), F.transform(found(2), lambda v: v.cast("long"))
    last = F.filter(F.sequence(F.lit(1), F.size(keys)), lambda i: ~F.array_contains(F.slice(keys, i + 1, F.size(keys)), F.element_at(keys, i)))
    last = F.when(F.size(keys) > 0, last).otherwise(F.array().cast("array<int>"))
    return F.map_from_entries(F.transform(last, lambda i: F.struct(F.element_at(keys, i), F.element_at(values, i))))


def age_days(now, then) -> Column:
    """Whole days of 24 hours, rounded down."""
    return F.floor((F.unix_micros(F.to_timestamp(now)) - F.unix_micros(F.to_timestamp(then))) / 86_400_000_000).cast("long")


def price(usd) -> Column:
    """struct(usd, source)."""
    known = usd.isNotNull()
    return F.struct(F.when(known, F.greatest(usd, F.lit(0.0))).otherwise(F.lit(0.0)).alias("usd"), F.when(known, F.lit("provider")).otherwise(F.lit("unknown")).alias("source"))


def feedback_weight(action, weight) -> Column:
    """Null where a weight is needed or out of [-1, 1]."""
    w = F.coalesce(weight, F.when(action == "accept", F.lit(ACCEPT)).when(action == "reject", F.lit(REJECT)))
    return F.when(w.between(-1.0, 1.0), F.bround(w, 4))


def safe_filename(x, most: int = 80) -> Column:
    """X26."""
    t = F.regexp_replace(F.trim(F.regexp_replace(_c(x), r"[\\/\x00\r\n]", "-")), r"^\.+|\.+$", "")
    return F.regexp_replace(F.rtrim(F.left(F.when(t == "", F.lit("untitled")).otherwise(t), F.lit(most))), r"\.+$", "")


def created_from(created, recorded, sources: Column) -> Column:
    """What is there, the recorded time, or the first ISO time in the sources."""
    first = F.regexp_extract(F.array_join(sources, " "), r"\d{4}-\d{2}-\d{2}(?:T[0-9:.]+(?:Z|[+-]\d{2}:?\d{2})?)?", 0)
    blank = lambda c: F.nullif(_c(c), F.lit(""))
    return F.coalesce(blank(created), blank(recorded), F.nullif(first, F.lit("")), F.lit(""))


def replace_block(text, body, start: str, end: str) -> Column:
    """The block between two marks replaced, or added at the end."""
    import re

    t, block = _c(text), F.concat(F.lit(f"{start}\n"), _c(body), F.lit(f"\n{end}"))
    s = F.instr(t, start)
    e = F.locate(end, t, 1)
    there = t.rlike(f"(?s){re.escape(start)}.*{re.escape(end)}") & (e > s)
    put = F.concat(F.substring(t, F.lit(1), s - 1), block, F.substring(t, e + len(end), F.length(t)))
    return F.when(there, put).otherwise(F.concat(F.regexp_replace(t, r"\s+$", ""), F.when(F.trim(t) == "", F.lit("")).otherwise(F.lit("\n\n")), block, F.lit("\n")))


def clip_utf8(x, most: int = 2048, mark: str = "\n…") -> Column:
    """At most so many bytes of UTF-8 with the mark, never inside a character.

    A binary cut; of a split character its first bytes are cut too.
    """
    t = _c(x)
    room = most - len(mark.encode())
    raw = t.cast("binary")
    # the byte after the cut tells whether the cut is inside a character (10xxxxxx)
    inside = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int").between(128, 191)
    cut = F.when(~inside(F.lit(room + 1)), F.lit(room)).when(~inside(F.lit(room)), F.lit(room - 1)).when(~inside(F.lit(room - 1)), F.lit(room - 2)).otherwise(F.lit(room - 3))
    return F.when(F.octet_length(t) <= most, t).otherwise(F.concat(F.substring(raw, F.lit(1), cut).cast("string"), F.lit(mark)))


@F.pandas_udf(T.StringType())
def first_json_value(texts):
    """The first balanced JSON object or list, as text. A scanner with states: Arrow batches, not a column expression."""
    import pandas as pd

    def scan(t):
        quoted = skip = False
        depth, start, pair = 0, -1, ""
        for i, ch in enumerate(t or ""):
            if skip:
                skip = False
            elif quoted:
                skip, quoted = ch == "\\", ch != '"'
            elif ch == '"':
                quoted = True
            elif not depth and ch in "{[":
                pair, start, depth = ch + {"{": "}", "[": "]"}[ch], i, 1
            elif depth and ch in pair:
                depth += 1 if ch == pair[0] else -1
                if not depth:
                    return t[start : i + 1]
        return None

    return pd.Series([scan(t) for t in texts], dtype="object")

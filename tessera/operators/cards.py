"""Recipes, registries, citations, feedback targets and reports
(SC34-SC36, FP19-FP20, J15-J16, S5, S8-S9, M15, Z11, Z13-Z18, Z28, Z36-Z39).

Recipes and registries are small tables by nature and partly driver-side; everything over entities or answers is a plan.
"""

from __future__ import annotations

import difflib
import json
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators import vocabulary as V

# Limits of a recipe; kinds that a recipe searches; nearest names.
RECIPE_NAME, DESCRIPTION_CHARS, PROMPT_BYTES = r"^[a-z][a-z0-9_]{0,63}$", 200, 32 * 1024
TOP_K, TIMEOUT = (8, 1, 50), (120, 1, 600)
CARD_KINDS = ("project", "company", "insight")
NEAREST, NEAREST_RATIO = 3, 0.5


# -- recipes


def valid_recipe() -> Column:
    """SC36: why a recipe (name, description, system_prompt, rag_top_k, timeout) is refused; null if it isn't."""
    def ranged(c: str, bounds) -> Column:
        n = F.coalesce(F.col(c), F.lit(bounds[0]))
        return F.when(~n.between(bounds[1], bounds[2]), F.lit(c))

    return F.coalesce(
        F.when(~F.coalesce(F.col("name"), F.lit("")).rlike(RECIPE_NAME), F.lit("name")),
        F.when((F.coalesce("description", F.lit("")) == "") | (F.length("description") > DESCRIPTION_CHARS), F.lit("description")),
        ranged("rag_top_k", TOP_K), ranged("timeout", TIMEOUT),
        F.when(F.octet_length(F.coalesce("system_prompt", F.lit(""))) > PROMPT_BYTES, F.lit("system_prompt")),
    )


def recipe_scan(builtin: DataFrame, user: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SC35: valid recipes, the user's over the built-in of the same name; and those skipped, with the reason."""
    rows = builtin.withColumn("rank", F.lit(0)).unionByName(user.withColumn("rank", F.lit(1))).withColumn("refused", valid_recipe())
    good = rows.where("refused IS NULL").drop("refused")
    cols = [c for c in good.columns if c not in ("name", "rank")]
    return good.groupBy("name").agg(F.max_by(F.struct(*cols), "rank").alias("r")).select("name", "r.*"), rows.where("refused IS NOT NULL").select("name", "refused")


def nearest_names(name: str, known: list[str]) -> list[str]:
    """At most three close names; names of recipes are few, so this is driver-side."""
    return difflib.get_close_matches(name, known, NEAREST, NEAREST_RATIO)


def kinds_of(source_kind: str | None) -> tuple[str, ...]:
    """FP19: the kinds that a recipe's ``source_kind`` asks for (card_ may lead); all cards if it names none."""
    asked = tuple(k for k in CARD_KINDS if k in re.split(r"[,\s|]+", (source_kind or "").replace("card_", "")))
    return asked or CARD_KINDS


def render_prompt(template: str, values: dict[str, str]) -> str:
    """Placeholders filled, missing ones with nothing; over 32 KB is an error."""
    out = template.format_map(defaultdict(str, values))
    if len(out.encode()) > PROMPT_BYTES:
        raise ValueError("the prompt is over 32 KB")
    return out


# -- schemas


def json_schema(kind: str) -> dict:
    """A type's fields as a JSON schema, from the same declarations as the rows' StructType."""
    def of(t: T.DataType, enum=None) -> dict:
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        if isinstance(t, T.StructType):
            need = [V.NESTED_REQUIRED[k] for k in V.NESTED_REQUIRED if k[0] == kind and V.NESTED_REQUIRED[k] in t.names]
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in t.fields}} | ({"required": need[:1]} if need else {})
        return {"type": "number" if isinstance(t, T.DoubleType) else "string"} | ({"enum": list(enum)} if enum else {})

    fields = {f.name: of(f.dataType, V.ENUMS.get((kind, f.name))) for f in V.ATTRS.fields}
    own = {"status": {"type": "string", "enum": list(V.TYPES[kind][2])}} | {r: of(T.ArrayType(T.StringType())) for r in V.RELATIONS}
    return {"type": "object", "required": ["type", "slug", "title"], "properties": {c: {"type": "string"} for c in ("slug", "title", "body")} | own | fields}


# -- registries


def registered_root(sessions: DataFrame, registry: DataFrame) -> DataFrame:
    """Sessions (session, cwd) with the first (ord) active root (path, state, ord) that cwd is in or under; null if none.

    A prefix join by equality: each folder above cwd is a row, and a path is one of those or isn't a prefix.
    """
    parts = F.split(F.regexp_replace("cwd", "/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = sessions.select("session", F.explode(above).alias("root"))
    roots = registry.where("state = 'active' AND coalesce(path, '') <> ''").select(F.regexp_replace("path", "/+$", "").alias("root"), "ord")
    hit = rows.join(roots, "root").groupBy("session").agg(F.min_by("root", "ord").alias("root"))
    return sessions.select("session").join(hit, "session", "left")


def summary_lines(facts: DataFrame, triggers: DataFrame, n_facts: int = 5, n_triggers: int = 4) -> DataFrame:
    """Page, part, pos, text: the first facts and triggers of each page."""
    first = lambda df, part, text, n: df.withColumn("r", F.row_number().over(Window.partitionBy("page").orderBy("pos"))).where(F.col("r") <= n).select("page", F.lit(part).alias("part"), "pos", F.col(text).alias("text"))
    return first(facts, "fact", "statement", n_facts).unionByName(first(triggers, "trigger", "trigger", n_triggers))


# -- answers and feedback


def card_targets(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """Asked (card_id) to kind: the project of that id, else the company, else null (an error to the caller)."""
    kind = F.when(F.col("type") == "project", 0).when(F.col("type") == "company", 1)
    known = entities.where(kind.isNotNull()).groupBy(F.col("slug").alias("card_id")).agg(F.min_by("type", kind).alias("kind"))
    return asked.join(known, "card_id", "left").select(asked.columns + ["kind"])


def answer_record(matched: DataFrame) -> DataFrame:
    """Matched (answer_id, rank, kind, card_id, title) to one row for each answer with its citations in order."""
    c = F.struct("rank", "kind", "card_id", "title")
    return matched.groupBy("answer_id").agg(F.array_sort(F.collect_list(c)).alias("citations"))


def answer_targets(answers: DataFrame) -> DataFrame:
    """The feedback targets of an answer's citations: answer_id, target_kind, target_ref."""
    return answers.select("answer_id", F.explode("citations").alias("c")).select("answer_id", F.concat(F.lit("card_"), "c.kind").alias("target_kind"), F.col("c.card_id").alias("target_ref"))


def pattern_target(asked: DataFrame, patterns: DataFrame) -> DataFrame:
    """Asked (pattern_id) with trigger and action; null if unknown."""
    return asked.join(patterns.select("pattern_id", "trigger", "action").dropDuplicates(["pattern_id"]), "pattern_id", "left")


def extracted_patterns(payload: DataFrame, json_col: str = "payload") -> DataFrame:
    """Patterns of a provider's JSON: trigger and action are needed; confidence in [0, 1], 0.5 if there is none."""
    each = payload.select(F.explode(F.from_json(json_col, "array<struct<trigger:string,action:string,rationale:string,confidence:string>>")).alias("p")).select("p.*")
    conf = F.coalesce(F.expr("try_cast(confidence AS DOUBLE)"), F.lit(0.5))
    return each.withColumns({"trigger": F.trim("trigger"), "action": F.trim("action"), "confidence": F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0))}).where("coalesce(trigger, '') <> '' AND coalesce(action, '') <> ''")


def answer_status(questions: DataFrame, matched: DataFrame, least: int = 1) -> DataFrame:
    """Query, matches, status: an endpoint without a match is refused and calls no provider."""
    n = matched.groupBy("query").agg(F.count("*").cast("long").alias("matches"))
    return questions.select("query").join(n, "query", "left").select("query", F.coalesce("matches", F.lit(0).cast("long")).alias("matches"), F.when(F.coalesce("matches", F.lit(0)) >= least, F.lit("ready")).otherwise(F.lit("refused")).alias("status"))


def write_back(answers: DataFrame, today: str) -> DataFrame:
    """Answers (question, answer, sources) as insight rows."""
    return answers.select(
        F.lit("insight").alias("type"), X.insight_id("question", F.lit(today).cast("date")).alias("slug"), F.col("question").alias("title"), F.lit("draft").alias("status"),
        F.lit(today).alias("created"), F.lit(today).alias("observed_at"), F.transform("sources", lambda s: F.concat(F.lit("[["), s, F.lit("]]"))).alias("related"), X.strip_preamble("answer").alias("body"),
    )


# -- reports


def recommendations(status: DataFrame) -> DataFrame:
    """Rules in order of priority over one row of counters; without a vault only the first two can apply."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    fix = F.when(~F.coalesce("doctor_ok", F.lit(False)), F.lit("fix"))
    vault = F.when(F.coalesce("vault_path", F.lit("")) == "", F.lit("vault"))
    rest = F.array(F.when(n("inbox"), F.lit("review")), F.when(n("drafts"), F.lit("drafts")), F.when(n("empty_companies"), F.lit("companies")), F.when(F.coalesce("last_daily_state", F.lit("")) != "done", F.lit("daily")), F.when(n("cleanup"), F.lit("cleanup")))
    every = F.when(vault.isNotNull(), F.array(fix, vault)).otherwise(F.concat(F.array(fix), rest))
    some = F.filter(every, lambda x: x.isNotNull())
    return status.select(F.when(F.size(some) == 0, F.array(F.lit("none"))).otherwise(some).alias("actions"))


def ingest_rollup(results: DataFrame) -> DataFrame:
    """Results (source, docs, pages, errors) to one row; any error fails the stage."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return results.agg(s("docs"), s("pages"), s("errors")).withColumn("failed", F.col("errors") > 0)


def daily_report(results: list[tuple[str, str, str]], day: str, usd: float) -> str:
    """Stages (name, status, note) as Markdown; a report has a handful of lines."""
    head = [f"# Daily report {day}", "", "| stage | status | note |", "|---|---|---|"]
    return "\n".join([*head, *(f"| {n} | {s} | {t} |" for n, s, t in results), "", f"Estimated cost: ${usd:.4f}"])


def pending_reviews(files: DataFrame) -> DataFrame:
    """FP20: files (name, text) of the form Profile-YYYY-MM-DD.md whose status isn't ``applied``: date, name, status."""
    day = F.regexp_extract("name", r"^Profile-(\d{4}-\d{2}-\d{2})\.md$", 1)
    status = F.nullif(F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), r"(?m)^status:(.*)$", 1)), F.lit(""))
    return files.select(day.alias("date"), "name", F.coalesce(status, F.lit("pending_review")).alias("status")).where("date <> '' AND status <> 'applied'")


def registry_text(entries: list[dict]) -> str:
    """SC34: a registry as text; positions are kept, so a round trip changes nothing."""
    return json.dumps({"projects": entries}, ensure_ascii=False, indent=1)


def registry_rows(texts: DataFrame, col: str = "text") -> DataFrame:
    """SC34: path, target, registered_at, last_sync, state and place of the entries of registries (JSON, which is YAML)."""
    entry = "struct<path:string,target:string,registered_at:string,last_sync:string,state:string>"
    each = texts.select(F.posexplode(F.from_json(col, f"struct<projects:array<{entry}>>")["projects"]).alias("place", "e")).select("place", "e.*")
    return each.where("coalesce(path, '') <> '' AND coalesce(target, '') <> ''").withColumn("state", F.coalesce("state", F.lit("active")))

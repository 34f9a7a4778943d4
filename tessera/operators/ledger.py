"""The promotion ledger and dismissals (A9-A13, D2-D4, FP14, FP21-FP22, J10, M6-M8, SC24-SC25, W8, Z25-Z29)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import similarity as S
from tessera.operators.absorb import absorb
from tessera.operators.components import written

# Bounds of an entry, promotion rules, days that a dismissal holds by its reason (blank and "other": the default).
STATEMENTS, CONFIDENCES = 5, 30
LEAST_SEEN, WINDOW_DAYS, FAST = 3, 14, 0.90
TTL, TTL_BY_REASON = 90, {"user_changed": 30, "misclassified": 90, "one_time": 180, "irrelevant": 365}
EXCLUDED = 100


def day(c) -> Column:
    """An ISO day, null if it is none."""
    return F.try_to_date(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def within(last, today: str, days: int = WINDOW_DAYS) -> Column:
    """FP14."""
    d = F.datediff(F.lit(today).cast("date"), day(last))
    return F.coalesce(d.between(0, days), F.lit(False))


def accumulate(sightings: DataFrame, by: tuple[str, ...] = ("kind", "fingerprint")) -> DataFrame:
    """A9 over a batch of sightings (by, day, ord, statement, confidence, category): an entry for each key.

    The last 30 confidences and last 5 distinct statements (each by its first sighting) are taken with two-level
    windows, so a frequent key is never collected.
    """
    o = F.struct("day", "ord")
    head = sightings.groupBy(*by).agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count("*").cast("long").alias("seen_count"))
    # WindowGroupLimit prunes before the shuffle
    late = Window.partitionBy(*by).orderBy(F.desc("day"), F.desc("ord"))
    conf = sightings.withColumn("r", F.row_number().over(late)).where(F.col("r") <= CONFIDENCES).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "ord", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)).alias("c")))), lambda x: x["c"]).alias("confidence_history"))
    stated = sightings.withColumn("s", F.trim(F.coalesce("statement", F.lit("")))).where("s <> ''").groupBy(*by, "s").agg(F.min(o).alias("o"))
    stated = stated.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("o")))).where(F.col("r") <= STATEMENTS).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: x["s"]).alias("statements"))
    cats = sightings.where("kind = 'fact' AND coalesce(category, '') <> ''").groupBy(*by, "category").agg(F.min(o).alias("o")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "category"))), lambda x: x["category"]).alias("categories"))
    empty = F.array().cast("array<string>")
    return head.join(conf, list(by), "left").join(stated, list(by), "left").join(cats, list(by), "left").withColumns({"statements": F.coalesce("statements", empty), "categories": F.coalesce("categories", empty)})


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """ST6: yesterday's ledger and today's entries, key by key (both as from ``accumulate``)."""
    k = ["kind", "fingerprint"]
    o, n = old.alias("o"), new.alias("n")
    a = lambda c: F.col(f"o.{c}")
    b = lambda c: F.col(f"n.{c}")
    arr = lambda c, t="string": F.concat(F.coalesce(a(c), F.array().cast(f"array<{t}>")), F.coalesce(b(c), F.array().cast(f"array<{t}>")))
    tail = lambda c, m: F.slice(c, F.greatest(F.size(c) - m + 1, F.lit(1)), m)
    return o.join(n, k, "full").select(
        *k, F.coalesce(a("first_seen"), b("first_seen")).alias("first_seen"), F.coalesce(b("last_seen"), a("last_seen")).alias("last_seen"),
        (F.coalesce(a("seen_count"), F.lit(0)) + F.coalesce(b("seen_count"), F.lit(0))).alias("seen_count"),
        tail(arr("confidence_history", "double"), CONFIDENCES).alias("confidence_history"), tail(F.array_distinct(arr("statements")), STATEMENTS).alias("statements"),
        F.array_distinct(arr("categories")).alias("categories"),
    )


def peak(c: str = "confidence_history") -> Column:
    """A10."""
    return F.coalesce(F.array_max(c), F.lit(0.0))


def mean(c: str = "confidence_history") -> Column:
    """A10."""
    return F.coalesce(F.aggregate(c, F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size(c), F.lit(0)), F.lit(0.0))


def promote(ledger: DataFrame, today_best: DataFrame, today: str, least: int = LEAST_SEEN, days: int = WINDOW_DAYS, fast: float = FAST) -> DataFrame:
    """Ledger with status promote, await or done. today_best: kind, fingerprint, confidence (the day's highest)."""
    c = today_best.groupBy("kind", "fingerprint").agg(F.max("confidence").alias("__c"))
    now = ((F.col("seen_count") >= least) & within("last_seen", today, days)) | (F.coalesce("__c", F.lit(0.0)) >= fast)
    return ledger.join(c, ["kind", "fingerprint"], "left").withColumn("decision", F.when(F.coalesce("promoted", F.lit(False)), F.lit("done")).when(now, F.lit("promote")).otherwise(F.lit("await"))).drop("__c")


def mark_promoted(decided: DataFrame, today: str) -> DataFrame:
    """M6."""
    new = F.col("decision") == "promote"
    return decided.withColumns({"promoted_at": F.when(new, F.lit(today)).otherwise(F.col("promoted_at")), "promoted": new | F.coalesce("promoted", F.lit(False))}).drop("decision")


def review(ledger: DataFrame, today: str, least: float, days: int = WINDOW_DAYS) -> DataFrame:
    """A12."""
    return ledger.where(~F.coalesce("promoted", F.lit(False)) & (peak() >= least) & within("last_seen", today, days))


def enrich(promoted: DataFrame, patterns: DataFrame) -> DataFrame:
    """Promoted (trigger) with action and rationale of the day's last pattern of the same normalised trigger (ord)."""
    last = patterns.groupBy(X.normalize("trigger").alias("__n")).agg(F.max_by(F.struct("action", "rationale"), "ord").alias("__p"))
    return promoted.withColumn("__n", X.normalize("trigger")).join(last, "__n", "left").withColumns({"action": F.coalesce("__p.action", F.lit("")), "rationale": F.coalesce("__p.rationale", F.lit(""))}).drop("__n", "__p")


def latest(lines: DataFrame, by: tuple[str, ...], order: str = "line") -> DataFrame:
    """SC24, D5, M11: the last line of each key."""
    rest = [c for c in lines.columns if c not in by]
    return lines.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("__x")).select(*by, "__x.*")


def save(ledger: DataFrame, path: str) -> None:
    """SC25: a full rewrite, rows of a file in key order."""
    ledger.sortWithinPartitions("kind", "fingerprint").write.mode("overwrite").json(path)


def top(ledger: DataFrame, n: int, kind: str | None = None, promoted: bool | None = None) -> DataFrame:
    """FP22: the n most seen, then of the highest peak (ties by fingerprint)."""
    rows = ledger.where(F.col("kind") == kind) if kind else ledger
    rows = rows if promoted is None else rows.where(F.coalesce("promoted", F.lit(False)) == promoted)
    return rows.withColumn("peak", peak()).orderBy(F.desc("seen_count"), F.desc("peak"), "kind", "fingerprint").limit(n)


def ttl(reason: str = "reason", default: int = TTL, overrides: dict[str, int] | None = None) -> Column:
    """Z25."""
    by = TTL_BY_REASON if overrides is None else overrides
    return F.coalesce(*[F.when(F.col(reason) == r, F.lit(d)) for r, d in by.items()], F.lit(default))


def dismissed(records: DataFrame, today: str, default: int = TTL, overrides: dict[str, int] | None = None) -> DataFrame:
    """A13, FP21: the first record of each key with days, ttl, age and expired. An unreadable date never expires (TR16)."""
    out = records.withColumn("ttl", ttl("reason", default, overrides)).withColumn("age", F.datediff(F.lit(today).cast("date"), day("dismissed_at")))
    return out.withColumn("expired", F.coalesce((F.col("ttl") > 0) & (F.col("age") > F.col("ttl")), F.lit(False)))


def dismissed_index(records: DataFrame, today: str, **limits) -> DataFrame:
    """Kind, reason, live fingerprints, expired."""
    return dismissed(records, today, **limits).groupBy("kind", "reason").agg(F.array_sort(F.collect_set(F.when(~F.col("expired"), F.col("fingerprint")))).alias("live"), F.count_if("expired").cast("long").alias("expired"))


def strong(records: DataFrame) -> DataFrame:
    """What was misclassified or irrelevant."""
    return records.where(F.col("reason").isin("misclassified", "irrelevant"))


def dismiss(records: DataFrame, new: DataFrame) -> DataFrame:
    """New records whose key isn't there; the first reason of a key stays (TR15). new has ord."""
    k = ["kind", "fingerprint"]
    first = new.groupBy(*k).agg(F.min_by(F.struct(*[c for c in records.columns if c not in k]), "ord").alias("__x")).select(*k, "__x.*")
    return records.unionByName(first.join(records, k, "left_anti"))


def purge(records: DataFrame, today: str, **limits) -> DataFrame:
    """M8."""
    return dismissed(records, today, **limits).where(~F.col("expired")).select(records.columns)


def excluded(items: DataFrame, most: int = EXCLUDED) -> DataFrame:
    """D3: distinct items without regard to case, the first of each, at most 100 in order."""
    return items.where(F.trim("item") != "").groupBy(F.lower(F.trim("item")).alias("k")).agg(F.min("ord").alias("ord"), F.min_by("item", "ord").alias("item")).orderBy("ord").limit(most).select("ord", "item")


def ranked_facts(facts: DataFrame) -> DataFrame:
    """Place in the category by peak confidence and sightings."""
    w = Window.partitionBy("category").orderBy(F.desc("peak"), F.desc("seen_count"), "statement")
    return facts.withColumn("place", F.row_number().over(w))


def _hundredths(c: Column, digits: int) -> Column:
    """Two digits, halves up, of the figure at so many digits: a half that a sum of doubles has missed by its last bit is a half."""
    return c.cast(f"decimal(18,{digits})").cast("decimal(9,2)").cast("string")


def suffix() -> Column:
    """Days between first and last sighting, peak, mean."""
    return F.format_string("%d days, seen %d, peak %s, mean %s", F.coalesce(F.datediff(day("last_seen"), day("first_seen")), F.lit(0)), "seen_count", _hundredths(peak(), 6), _hundredths(mean(), 9))


def daily(batch: DataFrame, ledger: DataFrame, today: str) -> DataFrame:
    """ST6, A11, M6: the ledger with the day's batch (kind, statement, confidence, category, ord) absorbed in order, and ``decision``: promote, await or done.

    An entry is marked as promoted by ``mark_promoted``, once its row has gone out.
    """
    entries = absorb(ledger, batch, today)
    now = ((F.col("seen_count") >= LEAST_SEEN) & within("last_seen", today)) | (F.coalesce("today_confidence", F.lit(0.0)) >= FAST)
    return entries.withColumn("decision", F.when(F.coalesce("promoted", F.lit(False)), F.lit("done")).when(now, F.lit("promote")).otherwise(F.lit("await"))).drop("today_confidence")


def stated(entries: DataFrame) -> DataFrame:
    """Entries with statement (the latest, else the fingerprint), category (the latest, else ``preference``) and confidence (the peak), as candidates."""
    return entries.withColumns({
        "statement": F.coalesce(F.try_element_at("statements", F.lit(-1)), "fingerprint"),
        "category": F.when(F.col("kind") == "fact", F.coalesce(F.try_element_at("categories", F.lit(-1)), F.lit("preference"))), "confidence": peak(),
    })


def fresh(entries: DataFrame, known: DataFrame) -> DataFrame:
    """D1 over entries in the ledger's order (stored ones by fingerprint, then new ones as they were opened): those whose statement isn't known, and the first of equal statements."""
    rows = stated(entries if "opened" in entries.columns else entries.withColumn("opened", F.lit(None).cast("long")))
    w = Window.partitionBy("kind", X.normalize("statement")).orderBy(F.asc_nulls_first("opened"), "fingerprint")
    rows = rows.withColumn("ord", F.row_number().over(w))
    first = written(rows.where("ord = 1").drop("ord", "opened"), "first")
    best = S.best_scores(first, known)
    return best.where("best IS NULL AND __some").select(first.columns)


def gate(candidates: DataFrame, ledger: DataFrame, known: DataFrame, today: str) -> DataFrame:
    """The day's candidates recorded one after the other, promoted, checked against what is known: new ledger rows with status promote.

    candidates: kind, statement, confidence, category, ord (further columns are ignored).
    """
    return fresh(daily(candidates, ledger, today).where("decision = 'promote'"), known)


def review_marked(ledger: DataFrame, known: DataFrame, today: str, least: float) -> tuple[DataFrame, DataFrame]:
    """A12, then D1, then M6: the rows to review, and the ledger in which their entries are promoted."""
    rows = fresh(review(ledger, today, least), known)
    hit = rows.select("kind", "fingerprint", F.lit(True).alias("__hit"))
    out = ledger.join(hit, ["kind", "fingerprint"], "left")
    new = F.coalesce("__hit", F.lit(False))
    marked = out.withColumns({"promoted_at": F.when(new, F.lit(today)).otherwise(F.col("promoted_at")), "promoted": new | F.coalesce("promoted", F.lit(False))})
    return rows, marked.select(ledger.columns)

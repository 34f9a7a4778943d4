"""Cost and feedback events (A3-A5, A22, SC20-SC23, Z19-Z23, Z40).

events: ts (timestamp, UTC), command, model, input_tokens, output_tokens, usd, elapsed_s. Sums are rounded half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

# Share of the cap at which to warn; columns that no event may carry; length of a reason.
WARN = 0.8
FORBIDDEN = ("prompt", "response", "text", "content")
REASON_CHARS = 500


def _exact(c: str, digits: int) -> Column:
    """The sum to that many digits: added as decimals, so neither order nor number of rows leaves a trace in the last digits; infinite or huge figures add up as doubles."""
    d = F.col(c).try_cast("decimal(28,12)")
    return F.bround(F.when(F.count_if(F.col(c).isNotNull() & d.isNull()) > 0, F.sum(c)).otherwise(F.sum(d).cast("double")), digits)


def summarize(events: DataFrame, now: str, days: int = 30, by: str = "command") -> DataFrame:
    """A3: each group and TOTAL over now - days <= ts <= now."""
    at = F.lit(now).cast("timestamp_ntz")
    rows = events.where(F.col("ts").between(at - F.expr(f"INTERVAL {days} DAYS"), at))
    aggs = [
        F.count("*").cast("long").alias("calls"), F.sum("input_tokens").cast("long").alias("input_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens"),
        _exact("usd", 8).alias("usd"), _exact("elapsed_s", 4).alias("elapsed_s"),
        F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first_seen"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_seen"),
    ]
    return rows.rollup(F.col(by).alias("group")).agg(*aggs, F.grouping_id().alias("g")).withColumn("group", F.when(F.col("g") == 1, F.lit("TOTAL")).otherwise(F.col("group"))).where("calls > 0").drop("g")


def month_to_date(events: DataFrame, now: str) -> DataFrame:
    """A4: usd in the month of now, [start, next)."""
    start = F.date_trunc("month", F.lit(now).cast("timestamp"))
    inside = (F.col("ts").cast("timestamp") >= start) & (F.col("ts").cast("timestamp") < F.add_months(start, 1).cast("timestamp"))
    return events.where(inside).agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))


def of_day(events: DataFrame, day: str) -> DataFrame:
    """Usd of the one-day window that ends at the next midnight, both ends included as in A3."""
    start = F.lit(day).cast("date").cast("timestamp_ntz")
    return events.where(F.col("ts").between(start, start + F.expr("INTERVAL 1 DAY"))).agg(F.coalesce(F.bround(F.sum("usd"), 8), F.lit(0.0)).alias("usd"))


def cap_status(month: DataFrame, cap: float | None) -> DataFrame:
    """month's usd against a cap (none: no limit)."""
    if not cap:
        return month.select("usd", F.lit(0.0).alias("ratio"), F.lit(float("inf")).alias("remaining"), F.lit(False).alias("over"), F.lit(False).alias("warn"))
    ratio = F.col("usd") / cap
    return month.select("usd", ratio.alias("ratio"), F.greatest(F.lit(cap) - F.col("usd"), F.lit(0.0)).alias("remaining"), (F.col("usd") >= cap).alias("over"), ((ratio >= WARN) & (F.col("usd") < cap)).alias("warn"))


def usage(known: list[Column], estimate: Column) -> Column:
    """The first of alternative counters that is there and not 0, else the estimate."""
    return F.coalesce(*[F.nullif(k.cast("long"), F.lit(0)) for k in known], estimate)


def cost_event(rows: DataFrame) -> DataFrame:
    """Rounded figures; price and its source from the provider's figure."""
    p = X.price(F.col("provider_usd"))
    return rows.withColumns({"usd": F.bround(p["usd"], 8), "pricing_source": p["source"], "elapsed_s": F.bround("elapsed_s", 4)}).drop("provider_usd")


def feedback_event(rows: DataFrame) -> DataFrame:
    """Rows whose weight is valid; a rejection needs a reason of at most 500 characters."""
    out = rows.withColumn("weight", X.feedback_weight(F.col("action"), F.col("weight"))).withColumn("reason", F.nullif(X.collapse("reason"), F.lit("")))
    return out.where(F.col("weight").isNotNull() & ((F.col("action") != "reject") | F.col("reason").isNotNull()) & (F.coalesce(F.length("reason"), F.lit(0)) <= REASON_CHARS))


def append(events: DataFrame, path: str) -> None:
    """SC22-SC23: the append sink; a column that may hold content is refused."""
    if bad := [c for c in events.columns if c in FORBIDDEN]:
        raise ValueError(f"columns that events may not carry: {bad}")
    events.write.mode("append").json(path)


def good_prefix(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """SC20-SC21, Z21: (file, line, value) split at each file's first bad line: events before it, and the tail from it on."""
    parsed = lines.withColumn("e", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = parsed.where(F.col("e").isNull() | F.col("e._bad").isNotNull()).where(F.trim("value") != "").groupBy("file").agg(F.min("line").alias("first_bad"))
    rows = parsed.join(bad, "file", "left")
    good = rows.where((F.col("first_bad").isNull() | (F.col("line") < F.col("first_bad"))) & (F.trim("value") != ""))
    return good.select("file", "line", "e.*").drop("_bad"), rows.where(F.col("line") >= F.col("first_bad")).select("file", "line", "value")


def table_line() -> Column:
    """A row of the summary as text."""
    return F.format_string("%-20s %8d %12d %12d %14.8f %12.4f", "group", "calls", "input_tokens", "output_tokens", "usd", "elapsed_s")

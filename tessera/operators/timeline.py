"""The quarter timeline (W1-W3, S1, Z24). Cards: card_id, source_kind, display_name, status, period_end, created,
last_reviewed, distance, document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.ranking import ranked

# Labels of lines.
TODAY, CREATED, REVIEWED = "(오늘 {})", "(created)", "(last reviewed)"
FALLBACK = "## 시간 정보 없음 — distance 순 폴백"


def sort_time(cards: DataFrame, today: str) -> DataFrame:
    """Adds kind, sort_ts (null: no time), sort_ts_source and created_ts (dates)."""
    kind = F.when(F.col("source_kind") == "card_company", F.lit("card_company")).otherwise(F.lit("card_project"))
    end, made, seen = X.iso_or_month("period_end"), X.iso_or_month("created"), X.iso_or_month("last_reviewed")
    first = F.when(F.col("kind") == "card_project", F.when(end.isNotNull(), F.lit("period_end")).when(F.col("status") == "active", F.lit("today_fallback"))).otherwise(F.when(seen.isNotNull(), F.lit("last_reviewed")))
    source = F.coalesce(first, F.when(made.isNotNull(), F.lit("created")), F.lit("no_time_meta"))
    at = F.when(F.col("sort_ts_source") == "period_end", end).when(F.col("sort_ts_source") == "today_fallback", F.lit(today).cast("date")).when(F.col("sort_ts_source") == "last_reviewed", seen).when(F.col("sort_ts_source") == "created", made)
    return cards.withColumn("kind", kind).withColumn("sort_ts_source", source).withColumn("sort_ts", at).withColumn("created_ts", made)


def by_time() -> list[Column]:
    """Newest first; equals by id."""
    return [F.desc_nulls_last("sort_ts"), F.desc_nulls_last("created_ts"), F.asc("card_id")]


def quarters(timed: DataFrame) -> DataFrame:
    """Year, quarter, label, sort_ts, members (ids in order), months (newest first); a group for each quarter."""
    rows = timed.where("sort_ts_source <> 'no_time_meta'").withColumns({"year": F.year("sort_ts"), "quarter": F.quarter("sort_ts"), "month": F.month("sort_ts")})
    far = F.lit("0001-01-01").cast("date")
    key = F.struct((-F.datediff("sort_ts", far)).alias("a"), (-F.datediff(F.coalesce("created_ts", far), far)).alias("b"), "card_id")
    g = rows.groupBy("year", "quarter").agg(F.max("sort_ts").alias("sort_ts"), F.transform(F.array_sort(F.collect_list(key)), lambda x: x["card_id"]).alias("members"), F.sort_array(F.collect_set("month"), asc=False).alias("months"))
    return g.withColumn("label", F.concat("year", F.lit(" Q"), "quarter"))


def quarter_places(timed: DataFrame) -> DataFrame:
    """W2, S1 for quarters of any size: card_id, year, quarter, place (from 1, newest first); no quarter is gathered."""
    rows = timed.where("sort_ts_source <> 'no_time_meta'").select("card_id", F.year("sort_ts").alias("year"), F.quarter("sort_ts").alias("quarter"), "sort_ts", "created_ts")
    return ranked(rows, ["year", "quarter"], by_time()).select("card_id", "year", "quarter", "place")


def limited(timed: DataFrame, limit: int) -> DataFrame:
    """Rank, card_id, header (a new quarter's), month_header (a new month's, in quarters of two cards and months or more).

    Timed cards newest first, then those without a time by distance (nulls last). The limit is the feature; only
    it many rows are ranked, after a distributed top-k.
    """
    late = F.when(F.col("sort_ts").isNull(), 1).otherwise(0)
    order = [late, F.desc_nulls_last("sort_ts"), F.when(late == 0, F.col("created_ts")).desc_nulls_last(), F.asc_nulls_last("distance"), F.asc("card_id")]
    q = F.concat(F.year("sort_ts"), F.lit(" Q"), F.quarter("sort_ts"))
    size = timed.where("sort_ts IS NOT NULL").groupBy(q.alias("label")).agg(F.count("*").alias("n"), F.count_distinct(F.month("sort_ts")).alias("m"))
    top = timed.orderBy(*order).limit(limit).withColumn("label", q)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).join(size, "label", "left")
    w = Window.partitionBy(F.lit(0)).orderBy("rank")
    head = F.coalesce("label", F.lit(FALLBACK))
    before, month = F.lag(head).over(w), F.date_format("sort_ts", "yyyy-MM")
    return top.select(
        "rank", "card_id", F.when(~head.eqNullSafe(before), head).alias("header"),
        F.when((F.col("n") >= 2) & (F.col("m") >= 2) & ~month.eqNullSafe(F.lag(month).over(w)), month).alias("month_header"),
    )


def line() -> Column:
    """A card as lines."""
    label = F.when(F.col("sort_ts_source") == "today_fallback", F.concat(F.lit(" (오늘 "), F.col("sort_ts").cast("string"), F.lit(")"))).when(F.col("sort_ts_source") == "created", F.lit(f" {CREATED}")).when(F.col("sort_ts_source") == "last_reviewed", F.lit(f" {REVIEWED}")).otherwise(F.lit(""))
    body = F.split(F.regexp_replace(F.coalesce("document", F.lit("")), r"^\s+|\s+$", ""), r"\r?\n")[0]
    body = F.when(F.length(body) > 200, F.concat(F.rtrim(F.left(body, F.lit(200))), F.lit("..."))).otherwise(body)
    head = F.concat(F.lit("- **"), "card_id", F.lit("** ("), F.coalesce("display_name", "card_id"), F.lit(") — "), F.coalesce(F.col("sort_ts").cast("string"), F.lit("0001-01-01")), label)
    return F.concat_ws("\n", head, F.when(body != "", F.concat(F.lit("  > "), body)), F.concat(F.lit("  ["), "kind", F.lit(":"), "card_id", F.lit("]")))

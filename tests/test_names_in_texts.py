"""Names in texts by runs of bytes, against looking for each name in each text."""

import random

from pyspark.sql import functions as F

from tessera.operators import retrieval


def _pages(spark, names):
    return spark.createDataFrame([(f"id-{i}", n, f"03/{i:05d}") for i, n in enumerate(names)], "slug string, title string, load_ord string")


def _brute(texts, names):
    titled = [(f"id-{i}", n.lower(), f"03/{i:05d}") for i, n in enumerate(names)]
    return {(q, s, o) for q, t in texts for s, n, o in titled if t is not None and (n and n in t.lower() or s in t.lower())}


def test_runs_of_bytes_find_what_looking_does(spark, monkeypatch):
    """Names of 1 to 20 characters of one to four bytes; pieces end inside names; texts that touch make no name; a null query is a query."""
    monkeypatch.setattr(retrieval, "PIECE", 64)
    r = random.Random(4)
    chars = ["a", "b", "c", "é", "한", "𝄞", " "]
    names = ["".join(r.choices(chars, k=r.randint(1, 20))) for _ in range(300)] + ["", "zzzz", "yx"]
    long = [n for n in names if len(n) > 9]
    texts = [(i, "".join(r.choices(chars, k=r.randint(0, 90))) + r.choice(["", *long]) + "".join(r.choices(chars, k=3))) for i in range(150)]
    texts += [(None, f"of no query: {long[0]} and id-7"), (500, None), (501, ""), (502, "...zz"), (503, "zz..y"), (504, "x ID-12")]
    df = spark.createDataFrame(texts, "query long, text string").coalesce(2)
    got = {tuple(x) for x in retrieval.name_seeds(df, _pages(spark, names), most=0).select("query", "slug", "load_ord").collect()}
    assert got == _brute(texts, names)
    assert len({q for q, _, _ in got}) > 100 and any(q is None for q, _, _ in got)


def test_texts_are_not_exploded(spark):
    """Runs of a text that no name stands under don't leave its task."""
    docs = spark.range(200).select(F.col("id").alias("query"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(400)), lambda k: F.hex(F.xxhash64(k, F.col("id"))))).alias("text"))
    names = [f"part number {i}" for i in range(500)]
    found = retrieval.name_seeds(docs.unionByName(spark.createDataFrame([(999, "see PART NUMBER 77")], "query long, text string")), _pages(spark, names), most=0)
    assert {(x.query, x.slug) for x in found.collect()} == {(999, "id-7"), (999, "id-77")}
    texts = docs.select("query", F.lower("text").alias("low"))
    rows = retrieval._by_runs(texts, spark.createDataFrame([(n,) for n in names], "name string"))
    assert rows.count() == 0


def test_seeds_are_worked_out_once(spark):
    """related_pages' last plan reads seeds, own and inbound edges; it holds no copy of the seeds' window and no join that shuffles edges to a hub."""
    pages = _pages(spark, ["hub", "other"]).withColumns({"type": F.lit("concept"), "status": F.lit("active"), "t_invalid": F.lit("")})
    e = spark.range(300).select(F.lit("concept").alias("src_type"), F.concat(F.lit("id-"), F.col("id") % 2).alias("src_slug"), F.concat(F.lit("03/0000"), F.col("id") % 2).alias("src_ord"), F.lit("uses").alias("relation"), F.col("id").cast("int").alias("pos"), F.lit("id-0").alias("target"))
    df = retrieval.related_pages(spark.createDataFrame([(1, "what uses the hub?")], "query long, text string"), pages, e)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [row_number") == 1 and "SortMergeJoin" not in plan
    assert [(r["rank"], r["slug"]) for r in df.orderBy("rank").collect()] == [(1, "id-0"), (2, "id-1")]

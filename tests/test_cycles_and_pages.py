"""Incremental cycles, locks, pages read back, and related pages against a sequential reading."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import entities as E
from tessera.operators import graph as G
from tessera.operators import retrieval
from tessera.operators import vocabulary as V
from tessera.sources import pages as P
from tessera.streaming import ingest


def files(spark, rows):
    return spark.createDataFrame([(r, t, len(c), bytearray(c)) for r, t, c in rows], "ref string, mtime_us long, size long, content binary")


def test_a_cycle_reads_only_what_was_appended_and_gives_up_after_two_failures(spark):
    none = spark.createDataFrame([], "ref string, offset long"), spark.createDataFrame([], "ref string, n long")
    got = []

    def apply(ref, df):
        if ref == "bad":
            raise ValueError("no")
        got.append((ref, bytes(df.first().tail)))

    first = [("a", 1, b"one\ntwo\n"), ("b", 2, "é\nhalf".encode()), ("bad", 3, b"x\n"), ("young", 99, b"y\n")]
    off, bad, done = ingest.run_cycle(files(spark, first), *none, apply, now_us=50, min_age_us=10)
    assert got == [("a", b"one\ntwo\n"), ("b", "é\n".encode())] and done == [("a", "ok"), ("b", "ok"), ("bad", "failed")]
    got.clear()
    # a and b have grown, and only their tails come; c shrank since its offset was taken
    off = off.unionByName(spark.createDataFrame([("c", 100), ("d", 2)], off.schema))
    second = [("a", 5, b"one\ntwo\nthree\n"), ("b", 6, "é\nhalf a line\n".encode()), ("bad", 3, b"x\n"), ("c", 7, b"new\n"), ("d", 8, b"line\nmore\n")]
    off, bad, done = ingest.run_cycle(files(spark, second), off, bad, apply)
    assert sorted(got) == [("a", b"three\n"), ("b", b"half a line\n"), ("c", b"new\n"), ("d", b"line\nmore\n")]
    assert dict(done)["bad"] == "dead"
    assert {r.ref: r.offset for r in off.collect()} == {"a": 14, "b": 15, "c": 4, "d": 10}
    got.clear()
    assert ingest.run_cycle(files(spark, second), off, bad, apply)[2] == [] and not got
    assert ingest.run_cycle(files(spark, []), off, bad, apply)[2] == []


def test_a_source_has_one_writer(spark, tmp_path):
    at = f"file://{tmp_path}/lock"
    with ingest.source_lock(spark, at) as held:
        assert held
        with ingest.source_lock(spark, at, "skip") as other:
            assert not other
        with pytest.raises(RuntimeError), ingest.source_lock(spark, at):
            pass
        with pytest.raises(RuntimeError), ingest.source_lock(spark, at, "wait", 0.01, 0.05):
            pass
    with ingest.source_lock(spark, at, "wait") as held:
        assert held


def test_entities_of_every_type_survive_a_page(spark):
    rows = []
    for i, t in enumerate(V.TYPES):
        attrs = {f.name: None for f in V.ATTRS.fields} | {"role": "r: x", "confidence": 0.5, "stack": ["a", "b, c"], "metrics": [{"name": "m", "before": "1", "after": None, "value": None}], "positions": [{"title": "t", "seniority": None, "keywords": ["k"], "jd_url": None}], "question": "why?"}
        dated = t in V.OCCURRENTS
        rows.append({"slug": f"s{i}", "title": f"Title: {i} é", "type": t, "status": V.TYPES[t][2][0], "created": "2024-01-02", "updated": "2024-02-03", "observed_at": "2024-01-01" if dated else "", "t_invalid": "", "sources": ["x"], "related": ["[[a|b]]"], **{r: ([f"{r}-1"] if i % 2 else []) for r in V.RELATIONS}, "attrs": attrs, "body": "line\n\n# head\n", "path": f"p{i}"})
    df = spark.read.schema(V.ENTITY).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    text = P.page_text(E.front_matter(df).select(F.concat(F.lit("p"), F.substring("slug", 2, 9)).alias("path"), "meta", "body"))
    back = E.from_front_matter(P.front_matter_json(P.split_front_matter(text.select("path", "text"))))
    key = lambda r: r.slug
    want = [r.asDict(True) for r in sorted(df.collect(), key=key)]
    got = [r.asDict(True) for r in sorted(back.collect(), key=key)]
    for g in got:
        g["body"] = g["body"].lstrip("\n")
    assert got == want


def sequential(text, pages, rel, most=12, cap=5):
    """The same in a plain loop. pages: [(type, slug, title)] in load order; rel: {slug: {relation: [targets]}}."""
    low, slugs = text.lower(), {s for _, s, _ in pages}
    shown = [s for _, s, t in pages if t.lower() in low or s.lower() in low]
    seeds = list(shown)

    def show(t):
        if t in shown or t not in slugs:
            return False
        shown.append(t)
        return True

    typed = lambda s: [(r, list(dict.fromkeys(rel.get(s, {}).get(r, [])))) for r in V.RELATIONS]
    into = lambda t: [(r, s) for _, s, _ in pages for r, ts in typed(s) for x in ts if x == t]
    words = set("".join(c if c.isascii() and c.isalnum() or c == "_" else " " for c in low).split())
    asked = {r for r, (ws, _) in V.INTENTS.items() if words & set(ws)}
    for seed in seeds:
        for _, ts in typed(seed):
            for t in ts:
                show(t)
        front, walked = [seed], {seed}
        for _ in range(2):
            ahead = []
            for p in front:
                for r, ts in typed(p):
                    if r in V.TRANSITIVE:
                        for t in ts:
                            show(t)
                            if t not in walked:
                                walked.add(t)
                                ahead += [t] if t in slugs else []
            front = ahead
        for r, s in into(seed):
            if r in V.SYMMETRIC:
                show(s)
        n = dict.fromkeys(asked, 0)
        for r, s in into(seed):
            if r in asked and n[r] < cap and show(s):
                n[r] += 1
        for t in rel.get(seed, {}).get("related", []):
            show(t)
    return shown[:most]


def check(spark, pages, rel, texts, **limits):
    none = F.array().cast("array<string>")
    schema = "type string, slug string, title string, " + ", ".join(f"{r} array<string>" for r in (*V.RELATIONS, "related"))
    ents = spark.createDataFrame([(t, s, n, *[rel.get(s, {}).get(r, []) for r in (*V.RELATIONS, "related")]) for t, s, n in pages], schema)
    ents = E.load_order(ents.withColumns({"status": F.lit("active"), "t_invalid": F.lit("")}))
    queries = spark.createDataFrame(list(enumerate(texts)), "query long, text string")
    got = {}
    for r in retrieval.related_pages(queries, ents, G.edges(ents), **limits).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.slug)
    assert none is not None
    order = {s: (list(V.TYPES).index(t), s) for t, s, _ in pages}
    pages = sorted(pages, key=lambda p: order[p[1]])
    for i, t in enumerate(texts):
        assert got.get(i, []) == sequential(t, pages, rel, **limits), (i, t)


def test_a_related_page_counts_in_the_cap_of_the_stage_before(spark):
    pages = [("concept", "hub", "hub"), *[("project", f"s{i}", f"Source {i}") for i in range(1, 8)]]
    rel = {"hub": {"related": ["s1"]}} | {f"s{i}": {"uses": ["hub"]} for i in range(1, 8)}
    check(spark, pages, rel, ["what uses hub", "hub"])


def test_related_pages_are_those_of_a_sequential_reading(spark):
    r = random.Random(9)
    types = list(V.TYPES)
    pages = [(r.choice(types), f"p{i:02d}x", f"Name {i:02d}y") for i in range(40)]
    slugs = [s for _, s, _ in pages] + ["gone"]
    hubs = slugs[:4]
    rel = {}
    for s in slugs[:-1]:
        mine = rel.setdefault(s, {})
        for kind in (*V.RELATIONS, "related"):
            if r.random() < 0.45:
                mine[kind] = [r.choice(hubs if r.random() < 0.5 else slugs) for _ in range(r.randint(1, 3))]
                mine[kind] = [t for t in mine[kind] if t != s]
    texts = [f"which uses or part_of or decision about {' and '.join(r.sample(hubs, r.randint(1, 4)))} {r.choice(slugs)}" for _ in range(25)] + ["nothing", "uses p00x", ""]
    check(spark, pages, rel, texts)
    check(spark, pages, rel, texts, most=30, cap=2)

"""Histories against the recursive walk."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from tessera.operators import history

PAGE, EDGE = "type string, slug string, load_ord string", "src_type string, src_slug string, relation string, pos int, target string, start string"


def recursive(pages, edges, ref):
    index = {}
    for t, s, _ in sorted(pages, key=lambda p: p[2]):
        index.setdefault(s, (t, s))
        index[f"{t}:{s}"] = (t, s)
    find = lambda r: index.get(r) or index.get(r.split(":", 1)[-1])
    out, seen = [], set()

    def walk(p, hop):
        if p in seen:
            return
        seen.add(p)
        out.append((ref, len(out), p))
        for _, target in sorted((pos, t) for a, b, _, pos, t, _ in edges if (a, b) == p):
            if (q := find(target)) is not None:
                walk(q, hop + 1)

    if (p := find(ref)) is not None:
        walk(p, 0)
    return out


def got(spark, pages, edges, refs, **kw):
    rows = history.histories(spark.createDataFrame(edges, EDGE), spark.createDataFrame(pages, PAGE), spark.createDataFrame([(r,) for r in refs], "ref string"), **kw).collect()
    return sorted((r.start, r.place, (r.type, r.slug)) for r in rows)


@pytest.mark.parametrize("small", [10**6, 0])
def test_random_graphs(spark, small):
    """Cycles, diamonds, clashing slugs, references to nothing, with either form; in tasks and by rounds."""
    r = random.Random(3 + small % 7)
    pages = [(r.choice(["log", "insight"]), f"p{i}", f"{r.randint(0, 99):02}/{i:03}") for i in range(40)]
    pages += [("concept", "p1", "00/0"), ("concept", "a:b", "50/0"), ("log", "b", "51/0")]
    pages = list({p[:2]: p for p in pages}.values())
    refs = [f"p{i}" for i in range(45)] + ["log:p3", "nope:p4", "x:nothing", "a:b", "concept:a:b", "concept:p1"]
    edges = []
    for t, s, _ in pages:
        edges += [(t, s, "supersedes", k, r.choice(refs), "") for k in range(r.choice([0, 1, 1, 2, 3]))]
    edges += [("log", "p3", "related", 9, "p2", "")]
    want = sorted(x for ref in set(refs) for x in recursive(pages, [e for e in edges if e[2] == "supersedes"], ref))
    assert got(spark, pages, edges, refs, small=small) == want and len(want) > 100


def test_diamonds_and_long_chains_in_linear_work(spark):
    """Two hundred diamonds one after the other: 2^200 paths."""
    sys.setrecursionlimit(5000)
    pages, edges = [], []
    for i in range(200):
        pages += [("log", f"{x}{i:03}", f"{i:03}{x}") for x in "abc"]
        edges += [("log", f"a{i:03}", "supersedes", 0, f"b{i:03}", ""), ("log", f"a{i:03}", "supersedes", 1, f"c{i:03}", "")]
        edges += [("log", f"{x}{i:03}", "supersedes", 0, f"a{i + 1:03}", "") for x in "bc" if i < 199]
    assert got(spark, pages, edges, ["a000", "b150"]) == sorted(recursive(pages, edges, "a000") + recursive(pages, edges, "b150"))
    few = [p for p in pages if p[1][1:] < "006"]
    assert got(spark, few, edges, ["a000"], small=0) == recursive(few, edges, "a000")


def test_many_chains(spark):
    """A million links, more rows than a recursive plan may make."""
    n = 400_000
    pages = spark.range(3 * n).select(F.lit("log").alias("type"), F.concat(F.lit("p"), "id").alias("slug"), F.format_string("%09d", "id").alias("load_ord"))
    e = spark.range(3 * n).where("id % 3 < 2").select(F.lit("log").alias("src_type"), F.concat(F.lit("p"), "id").alias("src_slug"), F.lit("supersedes").alias("relation"), F.lit(0).alias("pos"), F.concat(F.lit("p"), F.col("id") + 1).alias("target"))
    starts = spark.range(n).select(F.concat(F.lit("p"), F.col("id") * 3).alias("ref"))
    out = history.histories(e, pages, starts)
    assert out.where("slug = concat('p', cast(substring(start, 2) AS long) + place)").count() == out.count() == 3 * n


def test_nothing(spark):
    assert got(spark, [], [], ["a"]) == [] == got(spark, [("log", "a", "0")], [], [])


def test_components_shrink_their_links_from_round_to_round(spark, monkeypatch):
    from tessera.operators import components as C

    rows = []

    def written(df, name, put=C.written):
        out = put(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(C, "written", written)
    chain = [(f"{i:04d}", f"{i + 1:04d}") for i in range(600)]
    more = [("x", "x"), ("y", None), (None, "z"), ("b", "a"), ("a", "c"), ("c", "b"), ("c", "b")]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(chain + more, "u string, v string")).collect()}
    assert got == {f"{i:04d}": "0000" for i in range(601)} | {"x": "x", "a": "a", "b": "a", "c": "a"}
    # all that the rounds write is a few times the input
    assert sum(n for _, n in rows) < 9 * len(chain)
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0

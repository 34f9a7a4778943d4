"""Free names against saving one after the other; places against a window."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.naming import free_names
from tessera.operators.ranking import ranked


def one_by_one(rows, stored):
    taken, out = set(stored), {}
    for scope, name, ord_ in sorted(rows, key=lambda r: (r[2], r[1])):
        got, n = name, 2
        while (scope, got) in taken:
            got, n = f"{name}-{n}", n + 1
        taken.add((scope, got))
        out[ord_] = got
    return out


def free(spark, rows, stored):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "dir string, slug string, ord long, name string").repartition(4)
    there = spark.createDataFrame(list(stored), "dir string, slug string")
    got = free_names(df, there, scope="dir")
    assert got.columns == ["dir", "slug", "ord", "name"]
    return {r.ord: r.slug for r in got.collect()}


@pytest.mark.parametrize("seed", [0, 5])
def test_random_names(spark, seed):
    """Few stems, names that end in numbers, stored pages in the gaps, in two folders."""
    r = random.Random(seed)
    name = lambda: r.choice(["a", "a", "a", "b", "", "a-1", "a-02"]) + "".join(f"-{r.randint(2, 9)}" for _ in range(r.choice([0, 0, 0, 1, 1, 2])))
    n = 200
    rows = [(r.choice(["x", "x", "y"]), name(), i) for i in r.sample(range(1000), n)]
    stored = {(r.choice(["x", "y"]), name()) for _ in range(15)}
    assert free(spark, rows, stored) == one_by_one(rows, stored)


def test_names_whose_turns_meet(spark):
    """Each folder is a case of its own."""
    cases = {"p": ["a", "a", "a-2"], "q": ["a-2", "a", "a"], "r": ["a", "a"]}
    rows = [(d, x, 100 * i + k) for i, (d, xs) in enumerate(cases.items()) for k, x in enumerate(xs)]
    # each own number pushes the rows after it on, so that later own numbers come too late or not
    own = [("s", "a", 1000 + i) for i in range(0, 40, 2)] + [("s", f"a-{k}", 1000 + 2 * k - 3 + (k % 3)) for k in range(2, 14)]
    rows += list({r[2]: r for r in own}.values())
    stored = {("r", "a"), ("r", "a-3")}
    got = free(spark, rows, stored)
    assert [got[i] for i in (0, 1, 2, 100, 101, 102, 200, 201)] == ["a", "a-2", "a-2-2", "a-2", "a", "a-3", "a-2", "a-4"]
    assert got == one_by_one(rows, stored)


def test_one_hot_name(spark):
    rows = [("x", "untitled", i) for i in range(3000)]
    stored = {("x", f"untitled-{i}") for i in range(3, 4000, 7)}
    assert free(spark, rows, stored) == one_by_one(rows, stored)


def test_null_and_no_names(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3)], "slug string, ord long")
    got = free_names(df, df.where("slug = 'a'").select("slug"))
    assert {r.ord: r.slug for r in got.collect()} == {1: None, 2: "a-2", 3: "a-3"}
    assert free_names(df.where("false"), df.select("slug")).count() == 0


def test_places(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(r.choice([None, 0, 0, 0, 0, 1, 2]), i) for i in r.sample(range(9999), 700)], "k int, v long").repartition(5)
    got = {(x.k, x.v): x.place for x in ranked(df, ["k"], [F.desc("v")]).collect()}
    own = sorted(got, key=lambda x: -x[1])
    assert got == {x: [y for y in own if y[0] == x[0]].index(x) + 1 for x in got}
    assert sorted(x.place for x in ranked(df, [], [F.col("v")]).collect()) == list(range(1, 701))

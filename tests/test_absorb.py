"""Absorbing statements in order, against a reading one by one; components against union-find."""

import random
import re

import pytest

from tessera.operators import ledger as L
from tessera.operators.absorb import ENTRY, absorb
from tessera.operators.components import components

TODAY = "2024-05-02"


def norm(s):
    return re.sub("[ .。!?:,;・…]+$", "", re.sub(r"^ | $", "", re.sub(r"\s+", " ", s)).lower())


def words(s):
    return {w for w in norm(s).split(" ") if w}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def look_up(entries, kind, statement):
    for e in entries:
        if (e["kind"], e["fingerprint"]) == (kind, norm(statement)):
            return e
    found, best = None, 0.75
    for e in entries:
        if e["kind"] == kind:
            for v in (e["fingerprint"], *e["statements"]):
                if (score := jaccard(words(statement), words(v))) >= best:
                    found, best = e, score
                    break
    return found


def one_by_one(stored, batch):
    entries = [dict(e) for e in sorted(stored, key=lambda e: (e["kind"], e["fingerprint"]))]
    batch = sorted((b for b in batch if b["statement"] is not None and norm(b["statement"])), key=lambda b: (b["kind"], b["ord"]))
    for b in batch:
        e = look_up(entries, b["kind"], b["statement"])
        if e is None:
            e = {"kind": b["kind"], "fingerprint": norm(b["statement"]), "statements": [], "categories": [], "first_seen": "", "last_seen": "", "seen_count": 0, "confidence_history": [], "promoted": False, "promoted_at": ""}
            entries.append(e)
        e["first_seen"] = e["first_seen"] or TODAY
        e["last_seen"] = TODAY
        e["seen_count"] += 1
        e["confidence_history"] = [*e["confidence_history"], max(0.0, min(1.0, b["confidence"] or 0.0))][-30:]
        s = b["statement"].strip()
        if s not in e["statements"]:
            e["statements"] = [*e["statements"], s][-5:]
        if b["category"] and b["kind"] == "fact" and b["category"] not in e["categories"]:
            e["categories"] = [*e["categories"], b["category"]]
    best = {}
    for b in batch:
        if (e := look_up(entries, b["kind"], b["statement"])) is not None:
            best[id(e)] = max(best.get(id(e), 0.0), b["confidence"] or 0.0)
    return [e | {"today_confidence": best.get(id(e))} for e in entries]


def made(seed, n, stored):
    """Chains of statements that each differ in one word from some other, so that it matters which came first."""
    r = random.Random(seed)
    base = [[f"w{g}x{i}" for i in range(r.choice([4, 7, 8, 9]))] for g in range(6)]
    pool = []
    for g in base:
        now = list(g)
        for k in range(14):
            now = list(now)
            now[r.randrange(len(now))] = f"v{k}"
            pool.append(" ".join(now))
    say = lambda: r.choice(pool).replace("v", r.choice(["v", "V"])) + r.choice(["", ".", " !", "  "])
    batch = [{"kind": r.choice(["fact", "fact", "pattern"]), "statement": r.choice([say(), say(), say(), "", " .", None]), "confidence": r.choice([None, r.random(), 1.7, -1.0]), "category": r.choice([None, "", "a", "b"]), "ord": i} for i in range(n)]
    old = {}
    for _ in range(stored):
        s, kind = say(), r.choice(["fact", "pattern"])
        old[kind, norm(s)] = {"kind": kind, "fingerprint": norm(s), "statements": [say().strip() for _ in range(r.randint(0, 5))], "categories": [], "first_seen": "2024-01-01", "last_seen": "2024-01-03", "seen_count": r.randint(1, 4), "confidence_history": [r.random() for _ in range(r.randint(1, 30))], "promoted": r.random() < 0.2, "promoted_at": ""}
    old["fact", "nothing like it"] = {"kind": "fact", "fingerprint": "nothing like it", "statements": [], "categories": ["z"], "first_seen": "", "last_seen": "", "seen_count": 1, "confidence_history": [0.5], "promoted": False, "promoted_at": ""}
    return list(old.values()), batch


def rows(entries):
    return sorted((e["kind"], e["fingerprint"], tuple(e["statements"]), tuple(e["categories"]), e["first_seen"], e["last_seen"], e["seen_count"], tuple(round(c, 9) for c in e["confidence_history"]), e["promoted"], e["today_confidence"]) for e in entries)


SHAPE = "kind string, statement string, confidence double, category string, ord long, norm string"


@pytest.mark.parametrize(("seed", "n", "stored"), [(1, 300, 0), (2, 300, 30)])
def test_same_as_one_by_one(spark, seed, n, stored):
    old, batch = made(seed, n, stored)
    ledger = spark.createDataFrame([tuple(e.values()) for e in old], ENTRY)
    df = spark.createDataFrame([(*b.values(), "clash") for b in batch], SHAPE).repartition(5)
    got = absorb(ledger, df, TODAY).collect()
    assert rows(r.asDict() for r in got) == rows(one_by_one(old, batch))


def test_later_rows_match_entries_of_the_same_batch(spark):
    """The middle statement joins the first's entry and draws the third to it."""
    said = ["a b c d e f g h", "a b c d e f g x", "a b c d e f y x"]
    df = spark.createDataFrame([("fact", s, 0.5, None, i, "") for i, s in enumerate(said)], SHAPE)
    one = absorb(spark.createDataFrame([], ENTRY), df, TODAY).collect()
    assert [(r.fingerprint, r.seen_count, r.statements, r.opened) for r in one] == [(said[0], 3, said, 0)]
    apart = absorb(spark.createDataFrame([], ENTRY), df.where("ord <> 1"), TODAY).collect()
    assert len(apart) == 2


def test_empty_batch_and_ledger(spark):
    old, batch = made(4, 5, 3)
    ledger = spark.createDataFrame([tuple(e.values()) for e in old], ENTRY)
    none = spark.createDataFrame([], SHAPE)
    assert rows(r.asDict() for r in absorb(ledger, none, TODAY).collect()) == rows(e | {"today_confidence": None} for e in old)
    assert absorb(spark.createDataFrame([], ENTRY), none, TODAY).count() == 0


def test_gate_and_review_mark_what_is_new(spark):
    df = spark.createDataFrame([("fact", "I prefer tabs", 0.95, "style", 0, ""), ("fact", "i prefer tabs!", 0.4, "style", 1, ""), ("fact", "Known thing here", 0.99, "x", 2, ""), ("pattern", "when a build fails", 0.2, None, 3, "")], SHAPE)
    known = spark.createDataFrame([("known thing here",)], "statement string")
    none = spark.createDataFrame([], ENTRY)
    got = L.gate(df, none, known, TODAY).collect()
    assert [(r.kind, r.statement, r.category, r.confidence, r.seen_count) for r in got] == [("fact", "i prefer tabs!", "style", 0.95, 2)]
    entries = L.daily(df, none, TODAY)
    marked = {r.fingerprint: r.promoted for r in L.mark_promoted(entries, TODAY).collect()}
    assert marked == {"i prefer tabs": True, "known thing here": True, "when a build fails": False}
    shown, after = L.review_marked(entries.drop("decision", "opened"), known, TODAY, 0.1)
    assert sorted(r.statement for r in shown.collect()) == ["i prefer tabs!", "when a build fails"]
    assert {r.fingerprint for r in after.where("promoted").collect()} == {"i prefer tabs", "when a build fails"}


def test_components_of_chains_stars_and_pairs(spark):
    links = [(f"a{i:03}", f"a{i + 1:03}") for i in range(150)] + [("s", f"t{i}") for i in range(80)] + [("z", "z"), (None, "q")]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u string, v string").repartition(6)).collect()}
    assert got == {f"a{i:03}": "a000" for i in range(151)} | {"s": "s"} | {f"t{i}": "s" for i in range(80)} | {"z": "z"}
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0

"""Keyed state over restarts, leases, mirror states, schema checks, places in quarters."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import lint, merge, timeline
from tessera.streaming import lease, state

OUTCOME = "ref string, upto long, ok boolean, ord long, ts timestamp"


def outcomes(seed, n):
    r = random.Random(seed)
    return [(f"f{r.randint(0, 8)}", i * 10, r.random() < 0.6, i, f"2024-05-01 00:{i // 60:02}:{i % 60:02}") for i in range(n)]


def folded(rows, dead=2):
    out = {}
    for ref, upto, ok, *_ in rows:
        offset, failures, gone = out.get(ref, (0, 0, False))
        if not gone:
            offset, failures = (upto, 0) if ok else (offset, failures + 1)
            out[ref] = (offset, failures, failures >= dead)
    return out


def put(spark, rows, shape, at, n):
    df = spark.createDataFrame(rows, shape.replace("ts timestamp", "ts string"))
    df = df.withColumn("ts", F.to_timestamp("ts")) if "ts" in df.columns else df
    df.coalesce(1).write.mode("append").parquet(f"{at}/part={n}")


def test_references_go_on_after_a_restart(spark, tmp_path):
    rows = outcomes(1, 80)
    for name, cuts in (("one", [80]), ("three", [25, 26, 80])):
        src, start = str(tmp_path / name / "in"), 0
        for n, end in enumerate(cuts):
            put(spark, rows[start:end], OUTCOME, src, n)
            start = end
            stream = spark.readStream.schema(OUTCOME).parquet(src)
            state.run_to(state.reference_states(stream), str(tmp_path / name / "out"), str(tmp_path / name / "ck"))
        got = {r.ref: (r.offset, r.failures, r.dead) for r in state.latest_states(spark, str(tmp_path / name / "out"), "ref").collect()}
        assert got == folded(rows)
    assert any(x[2] for x in got.values()) and not all(x[2] for x in got.values())


def test_references_settle(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for n, rows in enumerate(([("a", 5, True, 0, "2024-05-01 00:00:00"), ("b", 7, True, 1, "2024-05-01 00:20:00")], [("b", 9, True, 2, "2024-05-01 01:00:00")], [("c", 1, False, 3, "2024-05-01 03:00:00")])):
        put(spark, rows, OUTCOME, src, n)
        state.run_to(state.reference_states(spark.readStream.schema(OUTCOME).parquet(src), idle="1800 seconds"), out, ck)
    seen = {(r.ref, r.offset) for r in spark.read.parquet(out).where("status = 'settled'").collect()}
    assert ("a", 5) in seen and ("b", 7) not in seen


def test_sightings_go_on_after_a_restart(spark, tmp_path):
    r = random.Random(2)
    shape = "kind string, fingerprint string, day string, ord long, statement string, confidence double"
    rows = [("fact", r.choice("xyz"), f"2024-05-{1 + i // 20:02}", i, r.choice([None, " ", "s", "t ", "u", "v", "w", "q", "p"]), r.choice([None, r.random(), 2.0])) for i in range(160)]
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for n, (a, b) in enumerate(((0, 50), (50, 51), (51, 160))):
        put(spark, rows[a:b], shape, src, n)
        state.run_to(state.sighting_states(spark.readStream.schema(shape).parquet(src)), out, ck)
    want = {}
    for _, key, day, _, said, c in rows:
        e = want.setdefault(key, [day, day, 0, [], []])
        e[1], e[2], e[3] = day, e[2] + 1, [*e[3], max(0.0, min(1.0, c or 0.0))][-30:]
        if said and said.strip() and said.strip() not in e[4]:
            e[4] = [*e[4], said.strip()][-5:]
    got = {x.fingerprint: [x.first_seen, x.last_seen, x.seen_count, x.confidence_history, x.statements] for x in state.latest_states(spark, out, "kind", "fingerprint").collect()}
    assert got == want


def test_a_lease_is_taken_over_and_late_writes_are_refused(spark, tmp_path):
    at, table, now = str(tmp_path / "lease"), str(tmp_path / "table"), [1000.0]
    clock = lambda: now[0]
    df = lambda x: spark.createDataFrame([(x,)], "x long")
    one = lease.acquire(spark, at, "one", 10, clock)
    assert one.number == 1 and lease.acquire(spark, at, "two", 10, clock) is None
    assert lease.commit(df(1), table, one) == 1
    now[0] += 8
    one.renew()
    now[0] += 8
    assert lease.acquire(spark, at, "two", 10, clock) is None
    now[0] += 3  # the holder has died
    two = lease.acquire(spark, at, "two", 10, clock)
    assert two.number == 2
    with pytest.raises(lease.LeaseLost):
        lease.commit(df(99), table, one)
    assert lease.commit(df(2), table, two) == 2
    # a former holder that had passed its check before it was taken over
    one.check = lambda: None
    with pytest.raises(lease.LeaseLost):
        lease.commit(df(98), table, one)
    log = lease._Folder(spark, f"{table}/_commits")
    df(97).write.parquet(f"{table}/late")
    assert log.create("000000003")
    log.put("000000003", {"term": 1, "at": "late"})
    assert sorted(r.x for r in lease.committed(spark, table).collect()) == [1, 2]
    two.release()
    assert lease.acquire(spark, at, "three", 10, clock).number == 3
    assert lease.committed(spark, str(tmp_path / "none")) is None


def test_lease_modes(spark, tmp_path):
    at = str(tmp_path / "lease")
    with lease.source_lease(spark, at, ttl_s=0.6) as held:
        with lease.source_lease(spark, at, "skip") as other:
            assert other is None
        with pytest.raises(RuntimeError):
            with lease.source_lease(spark, at, "fail"):
                pass
        import time

        time.sleep(1.2)  # it renews itself
        held.check()
    with lease.source_lease(spark, at, "wait", most_s=5) as next_:
        assert next_.number == held.number + 1


def test_mirror_states_same_as_a_sequential_fold(spark):
    r = random.Random(5)
    shape = "rel_path string, mtime double, size long, sha string"
    files, before, own = {}, spark.createDataFrame([], shape), {}
    for day in range(6):
        for name in [f"n{i}.md" for i in range(25)]:
            what = r.random()
            if what < 0.25:
                files[name] = (float(day * 100 + r.randint(0, 50)), r.randint(1, 5), f"s{r.randint(0, 9)}")
            elif what < 0.35 and name in files:
                files[name] = (files[name][0] + 1, *files[name][1:])
            elif what < 0.45:
                files.pop(name, None)
        since = float(day * 100 - 100) if day % 2 else None
        step = merge.mirror_next(spark.createDataFrame([(k, *v) for k, v in files.items()], shape), before, since)
        next_, counts = {}, dict.fromkeys(("scanned", "mirrored", "unchanged", "skipped", "bytes"), 0)
        for name, (t, size, sha) in files.items():
            counts["scanned"] += 1
            had = own.get(name)
            if since is not None and t < since:
                counts["skipped"] += 1
                if had:
                    next_[name] = had
            elif had and had[:2] == (t, size):
                counts["unchanged"] += 1
                next_[name] = had
            else:
                key = "unchanged" if had and had[2] == sha else "mirrored"
                counts[key] += 1
                counts["bytes"] += size if key == "mirrored" else 0
                next_[name] = (t, size, sha)
        got = {x.rel_path: (x.mtime, x.size, x.sha) for x in merge.mirror_state(step).collect()}
        assert got == next_ and merge.mirror_counts(step).first().asDict() == counts
        own, before = next_, spark.createDataFrame([(k, *v) for k, v in next_.items()], shape)


SCHEMAS = {
    "a": {
        "kind": {"type": "enum", "values": ["x", "y"], "required": True},
        "parts": {"type": "list", "required": True, "items": {"type": "object", "fields": {"name": {"type": "string", "required": True}, "levels": {"type": "list", "items": {"type": "enum", "values": ["lo", "hi"]}}, "inner": {"type": "object", "required": True, "fields": {"unit": {"type": "enum", "values": ["m"], "required": True}}}}}},
    },
    "b": {"note": {"type": "string", "required": True}, "kind": {"type": "enum", "values": ["z"]}},
    "c": {},
}


def recursive(value, path, spec):
    out = [("missing_required", path)] if spec.get("required") and value in (None, "", []) else []
    if value is None:
        return out
    if spec["type"] == "enum" and value not in spec["values"]:
        out.append(("invalid_enum", f"{path}={value}"))
    if spec["type"] == "list":
        out += [x for i, v in enumerate(value) if v is not None for x in recursive(v, f"{path}[{i}]", spec["items"] | {"required": False})]
    if spec["type"] == "object":
        out += [x for f, s in spec["fields"].items() for x in recursive(value.get(f), f"{path}.{f}", s)]
    return out


def test_schema_checks_same_as_a_recursive_checker(spark):
    r = random.Random(7)
    some = lambda *xs: r.choice([None, "", *xs])
    part = lambda: r.choice([None, {"name": some("n"), "levels": r.choice([None, [], [some("lo", "hi", "no") for _ in range(3)]]), "inner": r.choice([None, {"unit": some("m", "km")}])}])
    rows = [(f"p{i}", r.choice([*SCHEMAS, "d", None]), {"kind": some("x", "y", "z"), "note": some("t"), "parts": r.choice([None, [], [part() for _ in range(r.randint(1, 4))]])}) for i in range(120)]
    attrs = "struct<kind:string,note:string,parts:array<struct<name:string,levels:array<string>,inner:struct<unit:string>>>>"
    df = spark.createDataFrame([json.dumps({"path": p, "type": t, "attrs": a}) for p, t, a in rows], "string").select(F.from_json("value", f"path string, type string, attrs {attrs}").alias("x")).select("x.*")
    got = sorted((x.path, x.code, x.message) for x in lint.schema_rules(df, SCHEMAS).collect())
    want = sorted((p, *v) for p, t, a in rows for f, s in SCHEMAS.get(t, {}).items() for v in recursive(a[f], f, s))
    assert got == want and len(want) > 60


def test_quarter_places_without_lists(spark):
    r = random.Random(1)
    rows = [(f"c{i:03}", "card_project", "P", "active" if i % 3 else "done", r.choice(["2024-02", "2024-03-05", None]), r.choice([None, "2023-11-02", "2024-01-01"]), None, 0.5, "") for i in range(200)]
    cards = spark.createDataFrame(rows, "card_id string, source_kind string, display_name string, status string, period_end string, created string, last_reviewed string, distance double, document string")
    timed = timeline.sort_time(cards, "2024-05-05")
    got = {(x.year, x.quarter, x.place): x.card_id for x in timeline.quarter_places(timed).collect()}
    want = {(q.year, q.quarter, i + 1): m for q in timeline.quarters(timed).collect() for i, m in enumerate(q.members)}
    assert got == want and len({k[:2] for k in want}) > 1 and itertools


def test_sightings_are_folded_from_rows_with_one_reading_of_the_state():
    from pyspark.sql import Row

    class Kept:
        value, asked = None, 0

        def get(self):
            self.asked += 1
            return self.value

        def update(self, value):
            self.value = value

    p = state.Sightings(2, 2)
    p.state = Kept()
    row = lambda day, n, said, c: Row(kind="fact", fingerprint="f", day=day, ord=n, statement=said, confidence=c)
    (a,) = p.handleInputRows(("fact", "f"), iter([row("d2", 1, " b ", 2.0), row("d1", 2, None, None), row("d1", 1, "a", -1.0)]), None)
    assert (a["first_seen"], a["last_seen"], a["seen_count"], a["confidence_history"], a["statements"]) == ("d1", "d2", 3, [0.0, 1.0], ["a", "b"])
    (b,) = p.handleInputRows(("fact", "f"), iter([row("d3", 1, "c", float("nan"))]), None)
    assert (b["first_seen"], b["seen_count"], b["confidence_history"], b["statements"]) == ("d1", 4, [1.0, 0.0], ["b", "c"]) and p.state.asked == 2

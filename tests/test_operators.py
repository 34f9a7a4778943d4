"""Facts of the operators on small inline rows."""

from pyspark.sql import functions as F

from tessera import session
from tessera.operators import entities as E
from tessera.operators import graph as G
from tessera.operators import ledger as L
from tessera.operators import history, lint, merge, metrics, retrieval, similarity
from tessera.operators import timeline as T
from tessera.operators import vocabulary as V
from tessera.sources import star

EDGE = "src_type string, src_slug string, src_ord string, relation string, pos int, target string"


def pages(spark, *rows):
    df = spark.createDataFrame([(t, s, n, st, ti) for t, s, n, st, ti in rows], "type string, slug string, title string, status string, t_invalid string")
    return E.load_order(df.withColumn("observed_at", F.lit("")).withColumn("updated", F.lit("")))


def links(spark, *rows):
    return spark.createDataFrame([("x", s, s, r, i, t) for i, (s, r, t) in enumerate(rows)], EDGE)


def found(spark, text, p, e, **kw):
    q = spark.createDataFrame([(1, text)], "query long, text string")
    return [r.slug for r in retrieval.related_pages(q, p, e, **kw).orderBy("rank").collect()]


def page(t, s, title=None, status="active", gone=""):
    return (t, s, title or s, status, gone)


def test_reverse_uses_and_cap(spark):
    p = pages(spark, page("concept", "rag"), *[page("project", f"p{i}") for i in range(7)])
    e = links(spark, *[(f"p{i}", "uses", "rag") for i in range(7)])
    assert found(spark, "what uses RAG?", p, e) == ["rag", "p0", "p1", "p2", "p3", "p4"]
    assert found(spark, "tell me about RAG", p, e) == ["rag"]


def test_closure_symmetry_and_order(spark):
    p = pages(spark, page("project", "feature"), page("project", "product"), page("project", "portfolio"), page("concept", "alias-x"))
    e = links(spark, ("feature", "part_of", "product"), ("product", "part_of", "portfolio"), ("alias-x", "same_as", "feature"), ("feature", "related", "missing"))
    assert found(spark, "the FEATURE", p, e) == ["feature", "product", "portfolio", "alias-x"]
    assert found(spark, "the feature", p, e, most=2) == ["feature", "product"]


def test_current_excluded_and_null_text(spark):
    p = pages(spark, page("log", "topic"), page("concept", "topic-b", "topic"), page("concept", "topic-c", "topic", gone="2026-01-01"))
    e = links(spark)
    assert found(spark, "topic", p, e, exclude=("log",)) == ["topic-b"]
    assert found(spark, None, p, e) == []
    assert "topic-c" in found(spark, "topic", p, e, history=True)


def test_history_survives_cycles(spark):
    e = links(spark, ("v3", "supersedes", "v2"), ("v2", "supersedes", "v1"), ("v1", "supersedes", "v3")).withColumn("src_type", F.lit("log"))
    p = pages(spark, *(page("log", f"v{i}") for i in (1, 2, 3)))
    start = spark.createDataFrame([("v3",)], "ref string")
    assert [r.slug for r in history.histories(e, p, start).orderBy("place").collect()] == ["v3", "v2", "v1"]


def test_closure_depth_is_monotone(spark):
    e = links(spark, *[(f"n{i}", "part_of", f"n{i + 1}") for i in range(6)])
    sets = [{(r.src_slug, r.target) for r in G.closure(e, depth=k).collect()} for k in (1, 2, 3, 5)]
    assert all(a < b for a, b in zip(sets, sets[1:], strict=False))


def test_metrics_and_empty(spark):
    p = pages(spark, page("project", "a"), page("concept", "b"), page("concept", "c"))
    e = links(spark, ("a", "uses", "nowhere"), ("b", "related", "c"))
    r = metrics.relation_metrics(p, e).first()
    assert (r.typed, r.related_only, r.orphans, round(r.coverage, 4)) == (1, 1, 1, 0.3333)
    r = metrics.relation_metrics(p.where("false"), e.where("false")).first()
    assert (r.entities, r.coverage, r.residual, r.orphan_ratio) == (0, 0.0, 0.0, 0.0)


def test_dead_link_removal_twice_is_once(spark):
    p = pages(spark, page("project", "a"), page("project", "b")).withColumn("related", F.when(F.col("slug") == "a", F.array(F.lit("[[b]]"), F.lit("gone"))))
    once = G.without_dead_links(p, p)
    assert {r.slug: r.related for r in once.collect()} == {"a": ["[[b]]"], "b": []}
    assert sorted(map(tuple, G.without_dead_links(once, p).select("slug", "related").collect())) == sorted(map(tuple, once.select("slug", "related").collect()))


def test_supersede_with_and_without_type(spark):
    p = pages(spark, page("insight", "new"), page("insight", "old"), page("log", "old"))
    e = spark.createDataFrame([("insight", "new", "1", "supersedes", 0, "old"), ("insight", "new", "1", "supersedes", 1, "log:old")], EDGE)
    assert {(r.type, r.slug): (r.status, r.t_invalid) for r in G.supersede(p, e, "2026-07-01").collect()} == {
        ("insight", "new"): ("active", ""), ("insight", "old"): ("superseded", "2026-07-01"), ("log", "old"): ("superseded", "2026-07-01")}


def test_construct_rejects_and_defaults(spark):
    rows = [("project", "a", "A", None, None, None), ("nope", "b", "B", None, None, None), ("log", "", "C", None, None, None), ("log", "d", "D", "", "2026-01-02", "2026-01-01"), ("log", "e", "E", "", "soon", "")]
    df = spark.createDataFrame([(t, s, n, st, u, c, None) for t, s, n, st, u, c in rows], "type string, slug string, title string, status string, updated string, created string, observed_at string").withColumn("t_invalid", F.lit(None).cast("string"))
    assert {r.slug: (r.status, r.observed_at) for r in E.construct(df).collect()} == {"a": ("active", ""), "d": ("active", "2026-01-01")}


def test_dedupe_exact_fuzzy_blank(spark):
    c = spark.createDataFrame([(1, "I like Rust"), (2, "i like rust!"), (3, "prefers small functions in code reviews"), (4, " .. "), (5, "brand new"), (6, None)], "ord long, statement string")
    k = spark.createDataFrame([("Prefers small functions in code",)], "statement string")
    assert {r.ord: r.kept for r in similarity.dedupe(c, k).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_similarity_join_is_complete(spark):
    import itertools
    import random

    rnd = random.Random(4)
    sets = [sorted({f"w{int(rnd.random() ** 2 * 25)}" for _ in range(rnd.randint(1, 9))}) for _ in range(120)]
    df = spark.createDataFrame([(" ".join(s), s) for s in sets], "set_id string, words array<string>")
    got = {(r.li, r.ri): r.score for r in similarity.similar_sets(df, df, 0.75).collect()}
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert got == {(" ".join(a), " ".join(b)): j(a, b) for a, b in itertools.product(sets, sets) if j(a, b) >= 0.75}
    assert similarity.similar_sets(df, df.where("false"), 0.75).count() == 0


def test_ledger_bounds_and_promotion(spark):
    s = spark.createDataFrame([("fact", "f", f"2026-05-{1 + i // 10:02d}", i, f"s{i % 8}", 2.0 if i == 39 else 0.5, "style") for i in range(40)], "kind string, fingerprint string, day string, ord long, statement string, confidence double, category string")
    e = L.accumulate(s).first()
    assert (e.seen_count, len(e.confidence_history), e.confidence_history[-1], e.statements, e.categories) == (40, 30, 1.0, ["s3", "s4", "s5", "s6", "s7"], ["style"])
    led = L.accumulate(s).withColumns({"promoted": F.lit(False), "promoted_at": F.lit("")})
    none = spark.createDataFrame([], "kind string, fingerprint string, confidence double")
    assert L.promote(led, none, "2026-05-10").first().decision == "promote"
    assert L.promote(led, none, "2026-06-10").first().decision == "await"
    fast = spark.createDataFrame([("fact", "f", 0.9)], none.schema)
    done = L.mark_promoted(L.promote(led, fast, "2026-06-10"), "2026-06-10")
    assert (done.first().promoted, L.promote(done, fast, "2026-06-11").first().decision) == (True, "done")


def test_ledger_merge_equals_one_pass(spark):
    s = spark.createDataFrame([("fact", f"f{i % 3}", f"2026-05-{1 + i:02d}", i, f"s{i}", i / 20, "c") for i in range(15)], "kind string, fingerprint string, day string, ord long, statement string, confidence double, category string")
    cols = ["kind", "fingerprint", "first_seen", "last_seen", "seen_count", "confidence_history", "statements"]
    key = lambda df: sorted(map(str, df.select(cols).collect()))
    assert key(L.merge(L.accumulate(s.where("ord < 8")), L.accumulate(s.where("ord >= 8")))) == key(L.accumulate(s))


def test_best_entry_ties_to_the_later(spark):
    led = spark.createDataFrame([("fact", "a b c d", [], 1), ("fact", "a b c e", [], 2), ("pattern", "a b c", [], 3)], "kind string, fingerprint string, statements array<string>, ord long")
    c = spark.createDataFrame([(1, "fact", "a b c"), (2, "fact", "zzz"), (3, "fact", "A b c d.")], "cand long, kind string, statement string")
    assert {r.cand: r.fingerprint for r in similarity.best_entries(c, led).collect()} == {1: "a b c e", 3: "a b c d"}


def test_gate_records_promotes_and_drops_known(spark):
    led = spark.createDataFrame([("fact", "likes tea", "2026-05-01", "2026-05-09", 2, [0.5, 0.6], ["likes tea"], ["x"], False, "")], "kind string, fingerprint string, first_seen string, last_seen string, seen_count long, confidence_history array<double>, statements array<string>, categories array<string>, promoted boolean, promoted_at string")
    c = spark.createDataFrame([(1, "fact", "Likes tea!", 0.7, "x", 1), (2, "fact", "new thing", 0.95, "x", 2), (3, "fact", "weak thing", 0.4, "x", 3)], "cand long, kind string, statement string, confidence double, category string, ord long")
    known = spark.createDataFrame([("new thing",)], "statement string")
    assert [r.fingerprint for r in L.gate(c, led, known, "2026-05-10").collect()] == ["likes tea"]


def test_dismissals(spark):
    r = spark.createDataFrame([("fact", "a", "2026-01-01", "user_changed"), ("fact", "b", "soon", "user_changed"), ("fact", "c", "2026-01-01", "odd"), ("fact", "d", None, None)], "kind string, fingerprint string, dismissed_at string, reason string")
    assert {x.fingerprint: (x.ttl, x.expired) for x in L.dismissed(r, "2026-03-01").collect()} == {"a": (30, True), "b": (30, False), "c": (90, False), "d": (90, False)}
    new = spark.createDataFrame([("fact", "a", "2026-02-02", "other", 1), ("fact", "z", "2026-02-02", "one_time", 2), ("fact", "z", "2026-02-03", "other", 3)], "kind string, fingerprint string, dismissed_at string, reason string, ord long")
    assert {(x.fingerprint, x.reason) for x in L.dismiss(r, new).collect()} == {("a", "user_changed"), ("b", "user_changed"), ("c", "odd"), ("d", None), ("z", "one_time")}


def test_lint_page_and_relation_codes(spark):
    p = spark.createDataFrame([("Concepts/a.md", "concept", "a", "A", "nope"), ("Concepts/sub/b.md", "concept", "b", "B", "active"), ("Logs/2026/05/x.md", "log", "c", "C", "active"), ("z.md", None, None, None, None)], "path string, type string, slug string, title string, status string")
    got = sorted((r.code, r.path) for r in lint.page_rules(p).collect())
    assert got == sorted([("invalid_enum", "Concepts/a.md"), ("type_folder_mismatch", "Concepts/sub/b.md"), ("slug_filename_mismatch", "Logs/2026/05/x.md"), ("invalid_type", "z.md"), *[("missing_required", "z.md")] * 4])
    e = spark.createDataFrame([("project", "p", "1", "broader", 0, "a"), ("concept", "a", "1", "uses", 0, "log:c"), ("concept", "a", "1", "uses", 1, "concept:c"), ("concept", "a", "1", "uses", 2, "gone")], EDGE)
    assert sorted((r.relation, r.code) for r in lint.relation_rules(e, p).collect()) == [("broader", "relation_domain"), ("uses", "relation_range"), ("uses", "relation_target_missing"), ("uses", "relation_target_missing")]
    assert lint.index_stale(spark.createDataFrame([(99,)], "total long"), p).first().found == 4


def test_cleanup_marks_and_protection(spark):
    f = spark.createDataFrame([("in/a", "in", "inbox", 45, 1, None, None), ("in/b", "in", "inbox", 5, 1, None, None), ("in/c", "in", "inbox", 45, 1, True, None), ("in/d", "in", "inbox", 45, 1, None, "Skip"), ("Profile/x", "in", "report", 100, 1, True, None)], "path string, folder string, kind string, age_days int, size_bytes long, pinned boolean, cleanup string")
    got = lint.cleanup_status(lint.stale(f), dry_run=False)
    assert {r.path: r.status for r in got.collect()} == {"in/a": "moved", "Profile/x": "protected"}


def ops(spark, *rows):
    none = []
    cols = "type string, slug string, title string, status string, created string, updated string, observed_at string, " + ", ".join(f"{a} array<string>" for a in merge.ARRAYS) + ", attrs map<string,string>, op_ord long, op string"
    return spark.createDataFrame([("log", s, t, "active", c, "", "", src, *[none] * (len(merge.ARRAYS) - 1), at, i, op) for i, (op, s, t, c, src, at) in enumerate(rows)], cols)


def test_ops_fold_in_order(spark):
    stored = ops(spark, ("x", "kept", "K", "2026-01-01", ["s0"], {"a": "1"}), ("x", "other", "O", "2026-01-01", [], {})).drop("op_ord", "op")
    o = ops(spark, ("update", "kept", "K2", "2026-05-05", ["s1", "s0"], {"a": "2", "b": "3"}), ("update", "fresh", "F", "", ["s2"], {}), ("create", "kept", "K3", "", ["s3"], {}), ("update", "kept", "K4", "", ["s4"], {"z": "9"}))
    got = {r.slug: (r.title, r.created, r.sources, r.attrs) for r in merge.apply_ops(stored, o, "2026-07-07").collect()}
    assert got == {"other": ("O", "2026-01-01", [], {}), "fresh": ("F", "2026-07-07", ["s2"], {}), "kept": ("K4", "2026-07-07", ["s3", "s4"], {"z": "9"})}
    first = merge.apply_ops(stored, o.where("op_ord = 0"), "2026-07-07").where("slug = 'kept'").first()
    assert (first.created, first.sources, first.attrs) == ("2026-01-01", ["s0", "s1"], {"a": "2", "b": "3"})


def test_parse_ops_skips_and_warns(spark):
    text = '[{"op":"create","type":"project","slug":"a","title":"A","related":["x"]},{"op":"drop","type":"log","slug":"b","title":"B"},{"op":"update","type":"log","slug":"","title":"C"}]'
    r = merge.parse_ops(spark.createDataFrame([(text,)], "payload string")).collect()
    assert [(x.slug, x.related, x.warning) for x in r] == [("a", [], "related dropped")]


def test_failures_and_dead_letters(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "ref string, n long")
    one = lambda *r: spark.createDataFrame([(x,) for x in r], "ref string")
    assert {r.ref: (r.n, r.dead) for r in merge.count_failures(old, one("a", "c"), one("b")).collect()} == {"a": (2, True), "c": (1, False)}


def test_timeline_sources(spark):
    c = spark.createDataFrame([("a", "card_project", "2026-04", None, None, "active"), ("b", "other", None, "2026-05-01T00:00:00Z", None, "active"), ("c", "card_company", "2026-04", "2026-01-02", None, ""), ("d", None, None, "2026-03-03T00:00", None, None)], "card_id string, source_kind string, period_end string, created string, last_reviewed string, status string")
    got = {r.card_id: (r.sort_ts_source, str(r.sort_ts)) for r in T.sort_time(c, "2026-05-12").collect()}
    assert got == {"a": ("period_end", "2026-04-30"), "b": ("today_fallback", "2026-05-12"), "c": ("created", "2026-01-02"), "d": ("no_time_meta", "None")}
    q = T.quarters(T.sort_time(c, "2026-05-12")).orderBy(F.desc("sort_ts")).collect()
    assert [(x.label, x.members) for x in q] == [("2026 Q2", ["b", "a"]), ("2026 Q1", ["c"])]


def test_vocabulary_covers_schema():
    assert {f.name for f in V.ENTITY} >= set(V.RELATIONS) and V.CONTINUANTS == ("project", "company", "concept", "profile")


def test_sums_of_costs_carry_no_noise_of_their_order(spark):
    from tessera.operators import cost

    e = spark.range(1000).select(F.lit("2024-01-24").cast("timestamp_ntz").alias("ts"), F.lit("ask").alias("command"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), (F.lit(1e7) + 0.1).alias("usd"), F.lit(0.1).alias("elapsed_s"))
    lines = [r.line for r in cost.summarize(e, "2024-01-25 12:00:00").where("group = 'TOTAL'").select(cost.table_line().alias("line")).collect()]
    assert [x.split()[-2:] for x in lines] == [["10000000100.00000000", "100.0000"]]
    odd = e.limit(2).withColumn("usd", F.lit(float("inf")))
    assert {r.usd for r in cost.summarize(odd, "2024-01-25 12:00:00").collect()} == {float("inf")}


def test_suffix_rounds_halves_up_that_a_sum_just_missed(spark):
    rows = spark.createDataFrame([("2024-01-01", "2024-01-03", 3, [0.96, 0.57, 0.075])], "first_seen string, last_seen string, seen_count long, confidence_history array<double>")
    assert 0.96 + 0.57 + 0.075 < 0.535 * 3
    assert [r.s for r in rows.select(L.suffix().alias("s")).collect()] == ["2 days, seen 3, peak 0.96, mean 0.54"]
    none = rows.withColumn("confidence_history", F.array().cast("array<double>"))
    assert [r.s for r in none.select(L.suffix().alias("s")).collect()] == ["2 days, seen 3, peak 0.00, mean 0.00"]


def test_ids_that_many_queries_name_are_no_tasks_burden(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 25)
    said = [(i % 40, ["gone", f"own-{i % 9}", f"own-{i % 9}", "hub", None, f"own-{i % 5}"]) for i in range(50)]
    q = spark.createDataFrame(said, "query long, selected array<string>")
    p = spark.createDataFrame([(s,) for s in ("hub", "hub", *(f"own-{i}" for i in range(8)))], "slug string")
    want, there = {}, {"hub", *(f"own-{i}" for i in range(8))}
    for k in range(40):
        first = {}
        for key, ids in said:
            for pos, s in enumerate(ids):
                if key == k and s in there:
                    first[s] = min(pos, first.get(s, pos))
        want |= {(k, s): n for n, (s, _) in enumerate(sorted(first.items(), key=lambda x: x[1])[:2], 1)} if len(set(first.values())) == len(first) else {}
    got = retrieval.selected(q, p, 2, hot=20)
    rows = {(r["query"], r["slug"]): r["rank"] for r in got.collect()}
    assert want and want.items() <= rows.items() and set(rows.values()) == {1, 2} and {k for k, _ in rows} == set(range(40))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [query" in plan and "strategy=broadcast" in plan
    assert got.rdd.getNumPartitions() == 12  # 300 ids named


def test_lines_are_dealt_out_by_their_order(spark, sf, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    assert star.edges(spark, sf, "uses").rdd.getNumPartitions() == -(-star.table(spark, sf, "lineitem").count() // 500)


def test_neighbors_are_made_in_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    e = links(spark, *[(f"s{i % 17}", r, f"t{i % 7}") for i in range(40) for r in ("uses", "supersedes")])
    typed, every = G.typed_neighbors(e), G.neighbor_links(e, rows=100)
    assert typed.rdd.getNumPartitions() == 8 and every.rdd.getNumPartitions() == 10
    want = {(f"s{s}", r): [f"t{t}" for t in dict.fromkeys(i % 7 for i in range(40) if i % 17 == s)] for s in range(17) for r in ("uses", "supersedes")}
    assert {(r.src_slug, r.relation): r.targets for r in typed.collect()} == want
    assert {(r.src_slug, r.ord): r.target for r in every.collect()} == {(s, n): t for (s, r), ts in want.items() if r == "uses" for n, t in enumerate(ts, 1)}

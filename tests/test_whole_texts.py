"""Queries over whole texts against brute force."""

from tessera.plans import catalogue

HEAD = "the same opening words stand at the head of all these texts here"  # over 60 characters


def tables(spark, at, documents, benchmark):
    spark.createDataFrame([(i, t, "de", "s", len(t)) for i, t in documents], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def run(spark, name, d, *cols):
    return {tuple(r[c] for c in cols[:-1]) if len(cols) > 2 else r[cols[0]]: r[cols[-1]] for r in catalogue.queries()[name](spark, d).collect()}


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return round(len(a & b) / len(a | b), 9)


TAILS = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
DOCS = [(1, f"{HEAD} {TAILS[0]}"), (2, f"{HEAD} {TAILS[1]}"), (3, f"{HEAD} {TAILS[1]}"), (4, f"{HEAD} {TAILS[2]} z"), (5, "")]
KNOWN = [(1, "other words"), (2, f"{HEAD} {TAILS[2]}")]


def test_texts_that_differ_after_their_opening(spark, tmp_path):
    d = tables(spark, tmp_path, DOCS, KNOWN)
    best = {i: max((jaccard(t, k) for _, k in KNOWN if t), default=0) for i, t in DOCS}
    assert run(spark, "jaccard_dedupe", d, "doc_id", "best") == {i: s if s >= 0.75 else None for i, s in best.items()}
    assert run(spark, "exact_dedupe", d, "doc_id", "kept") == {1: True, 2: True, 3: False, 4: False, 5: False}
    scores = run(spark, "token_jaccard", d, "doc_id", "item_id", "score")
    known = dict(KNOWN)
    assert set(scores) == {(i, i % 2) for i, _ in DOCS if i % 2 in known} and all(scores[i, i % 2] == jaccard(t, known[i % 2]) for i, t in DOCS if t and i % 2 in known)


def test_matches_and_names_are_of_whole_texts(spark, tmp_path):
    docs = [*DOCS, (6, "." * 130 + "name"), (7, " " * 130 + "name")]
    d = tables(spark, tmp_path, docs, KNOWN)
    assert run(spark, "ledger_best_match", d, "cand", "score") == {4: jaccard(DOCS[3][1], KNOWN[1][1])}
    slugs = run(spark, "slugs", d, "doc_id", "page_slug")
    assert slugs[1] == DOCS[0][1].replace(" ", "-") and slugs[7] == "name"
    names = run(spark, "identifiers", d, "doc_id", "name")
    assert names[6] == names[7] == "name"


def test_offsets_are_in_bytes_for_every_document(spark, tmp_path):
    texts = ["é한\nrest", "plain\nrest", "é\n\nx", "한글", "", "\né", "ü\nx"]
    d = tables(spark, tmp_path, [*enumerate(texts)], KNOWN)
    want = {i: t.encode().find(b"\n") + 1 if i % 2 == 0 else 0 for i, t in enumerate(texts)}
    assert run(spark, "trusted_offsets", d, "doc_id", "off") == want


def test_a_text_is_gone_through_once_for_each_kind_of_slug(spark, tmp_path):
    d = tables(spark, tmp_path, [(1, " -Ä_b \t c--한글 !"), (2, "!-")], KNOWN)
    made = catalogue.queries()["slugs"](spark, d)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2
    assert sorted(tuple(r) for r in made.collect()) == [(1, "b-c-한글", "_b-c-한글", "2026-05-12-_b-c-한글"), (2, "untitled", "untitled", "2026-05-12-untitled")]

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X


def ask(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


@pytest.mark.parametrize(
    ("expr", "cases"),
    [
        (lambda: X.normalize("t"), {"  Swift 6  Concurrency !!。 ": "swift 6 concurrency", "... ": "", None: "", "a.b": "a.b"}),
        (lambda: X.slugify("t"), {" Rust & 러스트 Book_1 ": "rust-러스트-book-1", "!!!": "untitled", None: "untitled"}),
        (lambda: X.slugify_card("t"), {"Book_1 x": "book_1-x"}),
        (lambda: X.estimate_tokens("t"), {"": 0, "abcd": 2, "한글한": 3, None: 0}),
        (lambda: X.source_date("t"), {"codex:sessions/2026/06/16/r.jsonl": "2026-06-16", "x/2026/13/40": None, "none": None, None: None}),
        (lambda: X.iso_or_month("t").cast("string"), {"2026-04": "2026-04-30", "2026-02-29": None, "2026-05-12": "2026-05-12", "2026": None, "2026-05-12T00:00:00": None}),
        (lambda: X.link_target("t"), {"[[a|b]]": "a", " [[x]] ": "x", "type:slug": "type:slug", None: ""}),
        (lambda: F.array_join(X.wikilinks("t"), ","), {"[[b]] [[a|x]] [[b]]": "b,a", "none": "", None: ""}),
        (lambda: X.redact("t"), {"api_key=abc, x": "api_key=<redacted>, x", 'token: "t"': 'token: "<redacted>"', "authorization: Bearer q w": "authorization: <redacted> w"}),
        (lambda: X.one_line("t", 10), {"a  b\nc": "a b c", "0123456789x": "012345678…"}),
        (lambda: X.strip_fence("t"), {'```json\n{"a": 1}\n```': '{"a": 1}', " x ": "x"}),
        (lambda: X.first_json_value("t"), {'x {"a": "}"} y': '{"a": "}"}', "[1, [2]] z": "[1, [2]]", "{": None, None: None, 'say "{" [3]': "[3]"}),
        (lambda: X.strip_preamble("t"), {"Note: x\n\nInsight: y\nbody": "body", "body\nNote: z": "body\nNote: z"}),
        (lambda: X.safe_filename("t"), {"a/b\\c": "a-b-c", "..": "untitled", None: "untitled", "x" * 90: "x" * 80}),
        (lambda: X.clip_utf8("t", 10), {"short": "short", "가나다라마": "가나\n…", "0123456789a": "012345\n…"}),
        (lambda: X.error_summary("t"), {'HTTP status 429: {"error": {"type": "rate_limit", "message": "slow"}}': '{"category":"rate_limit","message":"slow","status":429}', "boom token=abc": "Error: boom token=<redacted>"}),
        (lambda: X.replace_block("t", F.lit("new"), "<!--s-->", "<!--e-->"), {"a\n<!--s-->\nold\n<!--e-->\nz": "a\n<!--s-->\nnew\n<!--e-->\nz", "": "<!--s-->\nnew\n<!--e-->\n"}),
    ],
)
def test_scalars(spark, expr, cases):
    assert ask(spark, expr(), *cases) == list(cases.values())


def test_similarity_is_symmetric_and_bounded(spark):
    df = spark.createDataFrame([("a b c", "c b d"), ("", "a"), ("x", "x!")], "a string, b string")
    ab, ba = X.jaccard(X.tokens("a"), X.tokens("b")), X.jaccard(X.tokens("b"), X.tokens("a"))
    assert [tuple(r) for r in df.select(ab, ba).collect()] == [(0.5, 0.5), (0.0, 0.0), (1.0, 1.0)]


def test_counters_weights_sizes(spark):
    df = spark.createDataFrame([("a=1 b+=2 a=3", "reject", None), ("", "weight", 2.0), (None, "accept", None)], "t string, act string, w double")
    got = df.select(X.counters("t"), X.feedback_weight(F.col("act"), F.col("w"))).collect()
    assert [(r[0], r[1]) for r in got] == [({"b": 2, "a": 3}, -0.3), ({}, None), ({}, 0.2)]


def test_a_text_is_normalised_by_one_regular_expression(spark):
    df = spark.createDataFrame([(" \t A  b C . !\n",), (" .。 ",), ("\n",)], "t string").select(X.normalize("t").alias("n"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert [r[0] for r in df.collect()] == ["a b c", "", ""]

"""Staging and publishing of pages, with attempts that fail; names found by automaton and by runs."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.sources import page_sink, pages


def files(base):
    return {os.path.relpath(os.path.join(d, f), base): open(os.path.join(d, f)).read() for d, _, names in os.walk(base) for f in names if not os.path.relpath(d, base).startswith("_")}


def test_pages_are_there_once(spark, tmp_path):
    base = str(tmp_path / "vault")
    df = spark.createDataFrame([(f"a/p{i}.md", f"text {i}") for i in range(40)] + [("é/ü.md", None)], "path string, text string").repartition(4)
    job = page_sink.stage(df, base)
    assert files(base) == {}
    done = page_sink.publish(spark, base, job)
    assert {r.status for r in done.collect()} == {"created"} and done.count() == 41
    assert files(base) == {f"a/p{i}.md": f"text {i}" for i in range(40)} | {"é/ü.md": ""}
    assert {r.status for r in page_sink.publish(spark, base, job).collect()} == {"done"}
    again = page_sink.stage(spark.createDataFrame([("a/p1.md", "other"), ("a/new.md", "x"), ("a/new.md", "y")], df.schema).coalesce(1), base)
    assert sorted((r.path, r.status) for r in page_sink.publish(spark, base, again).collect()) == [("a/new.md", "conflict"), ("a/new.md", "created"), ("a/p1.md", "conflict")]
    assert files(base)["a/p1.md"] == "text 1" and files(base)["a/new.md"] == "x"
    over = page_sink.stage(spark.createDataFrame([("a/p1.md", "other")], df.schema), base)
    assert [r.status for r in page_sink.publish(spark, base, over, replace=True).collect()] == ["replaced"]
    assert files(base)["a/p1.md"] == "other"
    none = page_sink.stage(df.where("false"), base)
    assert page_sink.publish(spark, base, none).count() == 0


def test_failed_attempts_leave_nothing(spark, tmp_path):
    base = str(tmp_path)
    rows = [{"path": f"p{i}.md", "text": str(i)} for i in range(5)]

    def broken():
        yield from rows[:3]
        raise OSError("lost")

    w = page_sink._Writer(base, "job")
    with pytest.raises(OSError):
        w.write(broken())
    first, second = w.write(iter(rows)), w.write(iter(rows))  # a task that ran twice: one counts
    assert first.folder != second.folder
    w.commit([second, None])
    assert {r.status for r in page_sink.publish(spark, base, "job").collect()} == {"created"}
    assert files(base) == {f"p{i}.md": str(i) for i in range(5)}
    with pytest.raises(ValueError):
        w.write(iter([{"path": "../x", "text": ""}]))
    lost = page_sink._Writer(base, "lost")
    kept = lost.write(iter(rows))
    lost.abort([kept])
    assert not os.listdir(os.path.join(base, "_staged", "lost"))


def test_names_by_automaton_and_by_runs(spark):
    pages = spark.createDataFrame([("Alpha Beta", "alpha", "1"), ("beta", "b", "2"), ("", "gamma-delta-x", "3"), ("É", "e1", "4"), ("alpha", "zz", "0"), (None, "alpha", "9")], "title string, slug string, load_ord string")
    texts = spark.createDataFrame([(1, "ALPHA BETA gamma-delta-x"), (2, None), (3, ""), (4, "é alph"), (5, "zz top b")], "query long, text string")
    want = {(q, s, o) for q, t in ((1, "alpha beta gamma-delta-x"), (4, "é alph"), (5, "zz top b")) for s, o, names in (("alpha", "1", ("alpha beta", "alpha")), ("b", "2", ("beta", "b")), ("gamma-delta-x", "3", ("gamma-delta-x",)), ("e1", "4", ("é", "e1")), ("zz", "0", ("alpha", "zz"))) if any(n in t for n in names)}
    for most in (10**6, 1):
        assert {tuple(r) for r in retrieval.name_seeds(texts, pages, most).select("query", "slug", "load_ord").collect()} == want
    assert retrieval.name_seeds(texts, pages.where("false")).count() == 0


def test_pages_are_listed_and_read_in_tasks_as_by_sparks_reader(spark, tmp_path, monkeypatch):
    """Nested, hidden, empty and odd files; few tasks for many pages, where the reader made one for every 32."""
    monkeypatch.setattr(pages, "LISTED", 7)
    base = tmp_path / "vault"
    odd = {f"p{i}.md": f"text {i}".encode() for i in range(300)} | {
        "a/b/c/deep.md": b"---\nx: 1\n---\n", "a/é ü%20#1?.md": "ä\r\nö".encode(), "a/empty.md": b"", "a/bad.md": b"\xff\xfe ok", "_h/x.md": b"no", ".h/x.md": b"no", "a/_x.md": b"no", "_k=1/x.md": b"yes", "a/x.txt": b"no", "a/x.MD": b"no", "a/x.md.gz": b"no"}
    for name, data in odd.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(data)
    (base / "none").mkdir()
    by_spark = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(str(base), wholetext=True).select("_metadata.file_path", F.col("value").cast("binary"))
    want = {(p, bytes(x)) for p, x in by_spark.collect()} | {(f"file:{base}/a/empty.md", b"")}
    for path in (str(base), f"file://{base}"):
        got = pages.read_pages(spark, path)
        rows = [(r.path, bytes(r.text)) for r in got.select("path", F.col("text").cast("binary").alias("text")).collect()]
        assert set(rows) ^ want == set() and len(rows) == len(want) == 305
    assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert pages.read_pages(spark, str(base / "none")).count() == 0
    assert [r.text for r in pages.read_pages(spark, str(base / "p1.md")).collect()] == ["text 1"]

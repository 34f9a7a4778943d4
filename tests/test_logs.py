"""The log source: ranges, numbers, tails, streams."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import logs, raw


def made(seed, n):
    r = random.Random(seed)
    lines = [r.choice([b"", b"x", b"\xff\xfe", b'{"a":1}\r', "é".encode() * r.randint(0, 60), b"y" * r.randint(0, 400)]) for _ in range(n)]
    return b"\n".join(lines) + r.choice([b"", b"\n"])


@pytest.mark.parametrize("split", [1, 7, 100, 10**6])
def test_ranges_meet_at_line_ends(tmp_path, monkeypatch, split):
    monkeypatch.setattr(logs, "CHUNK", 13)
    for seed in range(6):
        data = made(seed, 40)
        (tmp_path / "a").write_bytes(data)
        uri = str(tmp_path / "a")
        got = [x for p in logs.ranges(uri, "a", 0, len(data), split) for x in logs.lines_of(p)]
        want = data.split(b"\n")
        want = want[:-1] if want[-1] == b"" else want
        assert [line for _, line in got] == want
        assert all(data[at : at + len(line)] == line and (at == 0 or data[at - 1 : at] == b"\n") for at, line in got)
        assert logs.whole_lines(uri, len(data)) == data.rfind(b"\n") + 1


def folder(tmp_path):
    texts = {"history.jsonl": 5, "projects/a/s.jsonl": 70, "projects/a/deep/t.jsonl": 3, "projects/u.jsonl": 2, "sessions/2026/05/r.jsonl": 4, "sessions/q.jsonl": 1, "session_index.jsonl": 9, "notes.md": 1}
    for i, (name, n) in enumerate(texts.items()):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text("".join(json.dumps({"message": {"content": f"{name} {k}"}}) + "\n" for k in range(n)))
        os.utime(tmp_path / name, ns=(10**18 + i * 10**9,) * 2)
    return texts


def test_layouts_numbers_and_texts(spark, tmp_path):
    texts = folder(tmp_path)
    refs = lambda layout, **o: {r.ref for r in logs.read(spark, str(tmp_path), layout, **o).select("ref").distinct().collect()}
    assert refs("claude-code") == {"history.jsonl", "projects/a/s.jsonl"}
    assert refs("codex") == {"history.jsonl", "sessions/2026/05/r.jsonl", "sessions/q.jsonl"}
    assert refs("all") == {t for t in texts if t.endswith("jsonl")}
    assert refs("all", since=10**15, until=10**15 + 2 * 10**6) == {"projects/a/s.jsonl", "projects/a/deep/t.jsonl"}
    lines = logs.numbered(logs.read(spark, str(tmp_path), split=300))
    assert lines.select("ref", "part").distinct().count() > len(texts)
    assert sorted((r.ref, r.line, r.raw) for r in lines.collect()) == sorted((n, i, x.encode()) for n in texts if n.endswith("jsonl") for i, x in enumerate((tmp_path / n).read_text().split("\n")[:-1]))
    docs = {r.ref: r.text for r in raw.documents(lines).collect()}
    assert docs["projects/a/deep/t.jsonl"] == "\n\n".join(f"projects/a/deep/t.jsonl {i}" for i in range(3))
    assert logs.read(spark, str(tmp_path / "none")).count() == 0


def test_tails_read_only_what_is_new(spark, tmp_path, monkeypatch):
    a, b, c = (tmp_path / x for x in ("a.jsonl", "b.jsonl", "c.jsonl"))
    a.write_bytes(b"one\ntwo\nthr")
    b.write_bytes(b"x\n")
    c.write_bytes(b"")
    files = lambda: spark.createDataFrame([(str(p), p.name, p.stat().st_size) for p in (a, b, c)], "uri string, ref string, size long")
    off = spark.createDataFrame([("a.jsonl", 0), ("a.jsonl", 4), ("b.jsonl", 50)], "ref string, offset long")
    rows, new = logs.tails(files(), off, split=2)
    assert sorted((r.ref, r.byte, r.raw) for r in rows.collect()) == [("a.jsonl", 4, b"two"), ("b.jsonl", 0, b"x")]
    assert sorted(map(tuple, new.collect())) == [("a.jsonl", 4, 8), ("b.jsonl", 0, 2)]
    done = new.select("ref", F.col("upto").alias("offset"))
    a.write_bytes(b"one\ntwo\nthree\n\nfour\n")
    rows, new = logs.tails(files(), done)
    assert sorted((r.byte, r.raw) for r in rows.collect()) == [(8, b"three"), (14, b""), (15, b"four")]
    # an offset within a line isn't trusted
    rows, _ = logs.tails(files(), spark.createDataFrame([("a.jsonl", 2), ("b.jsonl", 2)], off.schema))
    assert rows.count() == 5
    # no byte before the offset but the one line end is read
    seen = []
    plain = logs.opened
    monkeypatch.setattr(logs, "opened", lambda uri: seen.append(uri) or plain(uri))
    big = tmp_path / "big.jsonl"
    big.write_bytes(b"z" * 999 + b"\n" + b"new\n")
    assert logs.trusted(str(big), 1000, 1004) == 1000 and list(logs.lines_of(logs.ByteRange(str(big), "big", 1000, 1004, 1004))) == [(1000, b"new")]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()

    def go():
        q = logs.stream(spark, str(src), split=5).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.ref, r.raw) for r in spark.read.parquet(out).select("ref", "raw").collect())

    (src / "a.jsonl").write_bytes(b"one\ntwo\nhal")
    assert go() == [("a.jsonl", b"one"), ("a.jsonl", b"two")]
    (src / "a.jsonl").write_bytes(b"one\ntwo\nhalf\n")
    (src / "b.jsonl").write_bytes(b"late\n")
    first = go()
    assert first == [("a.jsonl", b"half"), ("a.jsonl", b"one"), ("a.jsonl", b"two"), ("b.jsonl", b"late")]
    (src / "a.jsonl").write_bytes(b"new\n")  # shrunk: read anew
    assert go() == sorted([*first, ("a.jsonl", b"new")])


def test_cycles_over_tails(spark, tmp_path):
    """Limits, failures, dead letters and offsets from cycle to cycle; contents stay with the tasks."""
    from tessera.streaming import ingest

    for i, n in enumerate("abcd"):
        (tmp_path / n).write_bytes(f"{n}1\n{n}2\n{n}".encode())
        os.utime(tmp_path / n, ns=(10**18 + i * 10**9,) * 2)
    state = {"offsets": spark.createDataFrame([("a", 3)], "ref string, offset long"), "failures": spark.createDataFrame([("z", 5)], "ref string, n long")}
    got = []

    def step():
        files = spark.createDataFrame([(str(tmp_path / n), n, os.stat(tmp_path / n).st_mtime_ns // 1000, os.stat(tmp_path / n).st_size) for n in "abcd"], "uri string, ref string, mtime_us long, size long")

        def apply(ref, lines):
            if ref == "b":
                raise ValueError
            got.append((ref, sorted(r.raw for r in lines.collect())))

        state["offsets"], state["failures"], done = ingest.run_tails(files, state["offsets"], state["failures"], apply, limit=2)
        return done

    assert ingest.backfill(step) == [[("a", "ok"), ("b", "failed")], [("b", "dead"), ("c", "ok")], [("d", "ok")]]
    assert got == [("a", [b"a2"]), ("c", [b"c1", b"c2"]), ("d", [b"d1", b"d2"])]
    assert {r.ref: r.offset for r in state["offsets"].collect()} == {"a": 6, "c": 6, "d": 6}
    assert {r.ref: r.n for r in state["failures"].collect()} == {"b": 2, "z": 5}
    turns = iter([[("x", "failed")], [("x", "dead")]])
    assert ingest.backfill(lambda: next(turns)) == [[("x", "failed")]]

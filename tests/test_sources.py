import json

from pyspark.sql import functions as F

from tessera.operators import cost
from tessera.sources import pages, raw
from tessera.streaming import ingest


def lines(spark, *rows):
    return spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "ref string, line int, raw string")


def test_chat_and_codex_texts(spark):
    rows = [json.dumps({"message": {"content": "one"}}), "garbage", json.dumps({"message": {"content": [{"type": "text", "text": "two"}, {"type": "tool", "text": "no"}, "three"]}}), "", "[1]", json.dumps({"message": "x"})]
    assert raw.documents(lines(spark, *rows)).first().text == "one\n\ntwo\nthree"
    rows = [json.dumps({"type": "event_msg", "payload": {"type": "user_message", "message": "hi"}}), json.dumps({"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "yo"}]}}), json.dumps({"type": "response_item", "payload": {"type": "message", "role": "developer", "content": "no"}}), json.dumps({"type": "x", "payload": 3})]
    assert raw.documents(lines(spark, *rows), "codex").first().text == "User: hi\n\nAssistant: yo"
    assert raw.documents(lines(spark, "nothing")).count() == 0


def test_compaction_round_trip(spark):
    rows = [json.dumps({"cwd": "/x"}), json.dumps({"message": {"content": "a"}}), "bad", json.dumps({"cwd": "/x"}), json.dumps({"message": {"content": "b"}}), "  "]
    kept, gone = raw.compacted(lines(spark, *rows), "claude-code")
    assert sorted(r.line for r in kept.collect()) == [0, 1, 4]
    from pyspark.sql import Window

    k = kept.select("ref", (F.row_number().over(Window.partitionBy("ref").orderBy("line")) - 1).alias("pos"), "raw")
    assert {r.line: r.raw for r in raw.rehydrated(k, gone).collect()} == dict(enumerate(rows))


def test_offsets_and_pending(spark):
    df = spark.createDataFrame([(bytearray(b"ab\ncd"), o) for o in (0, 2, 3, 9, None)], "content binary, offset long")
    assert [r[0] for r in df.select(raw.trusted_offset()).collect()] == [0, 0, 3, 0, 0]
    f = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9), ("d", 1)], "ref string, mtime_us long")
    assert [r.ref for r in raw.pending(f, 1, 10, 2).collect()] == ["a", "b"]


def test_session_tail(spark):
    said = lambda t, role="user": json.dumps({"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": t}]}})
    df = spark.createDataFrame([("new", 0, said("# AGENTS.md x")), ("new", 1, said("b")), ("old", 0, said("a")), ("new", 2, said("no", "assistant"))], "ref string, line int, raw string")
    files = spark.createDataFrame([("new", 9), ("old", 1)], "ref string, mtime_us long")
    assert [r.text for r in raw.session_tail(df, files, 5).orderBy("rank").collect()] == ["[codex-session] b", "[codex-session] a"]


def test_front_matter_reading(spark):
    df = spark.createDataFrame([("a", "---\ntype: log\ntags: [x, y]\n---\nbody"), ("b", "no front"), ("c", "x\n---\ntype: log\n---\nrest")], "path string, text string")
    got = {r.path: (r.meta, r.body) for r in pages.front_matter_json(pages.split_front_matter(df)).collect()}
    assert json.loads(got["a"][0]) == {"type": "log", "tags": ["x", "y"]} and got["a"][1] == "body"
    assert got["b"] == (None, "no front") and got["c"][0] is None
    assert pages.split_front_matter(df, anywhere=True).where("path = 'c'").first().body == "rest"


def test_event_log_stops_at_the_first_bad_line(spark):
    df = spark.createDataFrame([("f", 0, '{"id": "a"}'), ("f", 1, ""), ("f", 2, '{"id": '), ("f", 3, '{"id": "b"}'), ("g", 0, '{"id": "c"}')], "file string, line int, value string")
    good, tail = cost.good_prefix(df, "id string")
    assert sorted(r.id for r in good.collect()) == ["a", "c"] and sorted(r.line for r in tail.collect()) == [2, 3]


def test_stream_reads_each_file_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    put = lambda n, *t: (src / f"{n}.jsonl").write_text("".join(json.dumps({"message": {"content": x}}) + "\n" for x in t))
    put("a", "one", "two")
    go = lambda: ingest.run_once(ingest.text_stream(ingest.line_stream(spark, str(src), 1)), str(out), str(ck))
    go()
    put("b", "three")
    go()
    go()
    assert sorted(r.text for r in spark.read.parquet(str(out)).collect()) == ["one", "three", "two"]


def test_dead_letters_keep_the_stream_going(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text(json.dumps({"message": {"content": "x"}}) + "\n")

    def fail(_):
        raise RuntimeError("no")

    ingest.dead_letters(spark, ingest.text_stream(ingest.line_stream(spark, str(src))), fail, str(tmp_path / "dead"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "dead")).first().error == "no"


def test_sessions_as_a_stream(spark, tmp_path):
    spark.sql("SELECT 1L AS user_id, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 1, timestamp'2024-01-01 00:10:00' UNION ALL SELECT 1, timestamp'2024-01-01 02:00:00'").write.parquet(str(tmp_path / "in"))
    df = ingest.settled_sessions(spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in")), late="1 hour")
    q = df.writeStream.outputMode("append").format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.events for r in spark.table("settled").collect()] == [2]


def test_stage_runner():
    def bad():
        raise ValueError

    ok = lambda: None
    stages = [("a", (), ok), ("b", ("a",), bad), ("c", ("b",), ok), ("d", ("a",), ok)]
    assert ingest.run_stages(stages) == [("a", "ok"), ("b", "failed"), ("c", "blocked"), ("d", "ok")]
    assert ingest.run_stages(stages, resume_from="d") == [("a", "resumed"), ("b", "resumed"), ("c", "resumed"), ("d", "ok")]
    assert dict(ingest.run_stages(stages, skip=("a",)))["d"] == "blocked"


def test_json_front_matter_is_read_without_yaml_where_both_agree(spark, monkeypatch):
    import json

    import yaml

    from tessera.sources import pages as P

    texts = [
        '{"slug":"a-1","n":12,"x":-1.50,"l":["p",null,true,{"k":""}],"q":"a: \\"b\\" # c\\n"}', '{"x":1e5}', '{"x":1.0E+5}', '{"x":NaN}', '{"a":1,"a":2}', '{"u":"\\u00e9 é"}',
        '{"a":"\\/"}', '{"a":"x\u2028y"}', '{"a":"x\x85y"}', '{"%s":1}' % ("k" * 2000), '{"a" : "2024-01-01", "b": 0.1}', '{"a":1} # c', '[1]', '{}', '{"<<":{"b":1}}', '{a: 1}', '{\t"a":1}', '{"a":"\x7f"}', '{"a":"😀"}', '{"a": -0}', '{"a": 0012}', '{"a": "y", "b": "1_000"}',
    ]

    def slow(t):
        try:
            return yaml.safe_load(t)
        except yaml.YAMLError:
            return None

    read = {t: P.as_json(t) for t in texts}
    assert all(json.dumps(g, default=str) == json.dumps(slow(t), default=str) for t, g in read.items() if g is not None)
    assert [t for t in texts[:1] + texts[4:5] + texts[10:11] if not read[t]] == []
    rows = spark.createDataFrame([(str(i), t, "") for i, t in enumerate(texts)], "path string, yaml string, body string")
    want = [json.dumps(g, ensure_ascii=False, default=str) if isinstance(g := slow(t), dict) else None for t in texts]
    assert [x.meta for x in P.front_matter_json(rows).orderBy(F.col("path").cast("int")).collect()] == want

import pytest

from tessera.operators import cards as K


def test_recipes(spark):
    shape = "name string, description string, system_prompt string, rag_top_k int, timeout int"
    b = spark.createDataFrame([("ask", "built in", "p", None, None), ("Bad", "x", "", None, None), ("slow", "x", "", 8, 601)], shape)
    u = spark.createDataFrame([("ask", "mine", "q", 3, 10), ("big", "x", "x" * 33_000, None, None)], shape)
    good, bad = K.recipe_scan(b, u)
    assert [(r.name, r.description) for r in good.collect()] == [("ask", "mine")]
    assert {r.name: r.refused for r in bad.collect()} == {"Bad": "name", "slow": "timeout", "big": "system_prompt"}
    assert K.nearest_names("resme", ["resume", "decide", "recall"]) == ["resume"]
    assert K.kinds_of("card_project") == ("project",) and K.kinds_of(None) == K.CARD_KINDS
    assert K.render_prompt("{a} {b}.", {"a": "x"}) == "x ."
    with pytest.raises(ValueError):
        K.render_prompt("{a}", {"a": "x" * 40_000})


def test_json_schema_follows_the_vocabulary():
    s = K.json_schema("company")["properties"]
    assert s["size"]["enum"][0] == "startup" and s["positions"]["items"]["required"] == ["title"] and s["confidence"] == {"type": "number"}


def test_recommendations(spark):
    shape = "doctor_ok boolean, vault_path string, inbox long, drafts long, empty_companies long, last_daily_state string, cleanup long"
    rows = [(True, "/v", 0, 0, 0, "done", 0), (False, None, 5, 1, 1, None, 1), (True, "/v", 1, 0, 0, None, 2)]
    assert [r.actions for r in K.recommendations(spark.createDataFrame(rows, shape)).collect()] == [["none"], ["fix", "vault"], ["review", "daily", "cleanup"]]


def test_write_back(spark):
    r = K.write_back(spark.createDataFrame([("Why Rust?", "Note: x\nbody", ["a"])], "question string, answer string, sources array<string>"), "2026-05-12").first()
    assert (r.slug, r.related, r.body) == ("2026-05-12-why-rust", ["[[a]]"], "body")

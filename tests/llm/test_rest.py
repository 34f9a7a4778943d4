import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, mixing, pieces, quality, sharding
from tests.compare import connect, same

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# -- sharding


def plain_lpt(sizes, shards):
    """One group after the other: largest first, to the least-loaded shard, of equal loads the first."""
    loads, out = [0] * shards, []
    for size in sorted(sizes, reverse=True):
        at = min(range(shards), key=lambda i: (loads[i], i))
        loads[at] += size
        out.append((size, at))
    return out


def places(schedule):
    return {size: lambda r, s=segments: (lambda seg: seg[1][(r - seg[0]) % len(seg[1])])([x for x in s if x[0] <= r][-1]) for size, segments in schedule.items()}


def test_schedule_is_lpt():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 90)), max_size=12, unique_by=lambda t: t[0]), st.integers(1, 7))
    def check(classes, shards):
        got = places(sharding.schedule(classes, shards))
        mine = [(size, got[size](r)) for size, n in sorted(classes, reverse=True) for r in range(n)]
        assert mine == plain_lpt([size for size, n in classes for _ in range(n)], shards)

    check()
    assert plain_lpt([7, 6, 5, 4, 3, 2], 3) == [(7, 0), (6, 1), (5, 2), (4, 2), (3, 1), (2, 0)]


def test_turns_of_very_many_groups():
    loads = [10**12, 5, 0, 123_456]
    segments = sharding.turns(loads, 8, 10**10)
    assert sum(loads) == 10**12 + 5 + 123_456 + 8 * 10**10 and loads[0] == 10**12 and max(loads[1:]) - min(loads[1:]) <= 8 and len(segments) <= 4


@pytest.mark.parametrize("rows", [4096, 7])
def test_shards_are_those_of_plain_lpt(spark, sf, monkeypatch, rows):
    """rows 7: groups of a size, and slots, lie in many buckets."""
    monkeypatch.setattr(sharding, "SLOT_ROWS", rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    many = spark.range(0, 300).selectExpr("10000 + id as doc_id", "concat('t', 100 + id % 150) as text")
    docs = docs.unionByName(docs).unionByName(many).unionByName(spark.createDataFrame([(1, None), (None, ""), (None, None), (5, "é" * 500_000)], docs.schema)).withColumn("bytes", F.lit(1))
    given = docs.collect()
    got = sharding.shard_documents(docs, 5).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r.doc_id), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in given)
    by, slots, sizes = {}, defaultdict(list), Counter()
    for r in got:
        assert by.setdefault(bytes(r.digest), r.shard) == r.shard
        slots[r.shard].append(r.slot)
        sizes[bytes(r.digest)] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(sizes, key=lambda d: (-sizes[d], d))
    assert [(sizes[d], by[d]) for d in order] == plain_lpt(sizes.values(), 5)
    assert sharding.shard_documents(docs.where("false"), 5).count() == 0


# -- mixing


def test_mixing_matches_sql(spark, sf):
    from tessera.llm import queries as q

    same(q.op5_mixing(spark, sf), connect(sf), q.oracle_sql()["op5_mixing"])


def corpus(spark):
    rows = [(i, "w " * 10, "big") for i in range(200)] + [(1000 + i, "w " * 10, "mid") for i in range(50)] + [(2000 + i, "w " * 10, None) for i in range(10)] + [(3000, "", "none"), (3001, None, "none")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit(9))


def test_repeats_and_weights(spark):
    docs = corpus(spark)
    out = mixing.mix(docs, max_repeats=2.0)
    assert out.columns[:4] == docs.columns
    n = Counter(r.source for r in out.collect())
    assert n["big"] == 200 and 18 <= n[None] <= 20 and 50 < n["mid"] < 100 and n["none"] == 2
    w = {r.source: r for r in mixing.plan(docs, max_repeats=2.0).collect()}
    assert math.isclose(sum(r.weight for r in w.values()), 1.0, abs_tol=1e-9)
    assert math.isclose((1 - w["big"].alpha) * math.log(20), math.log(2), abs_tol=1e-5)


def test_entropy_target_and_budget(spark):
    docs = corpus(spark)
    rows = [r for r in mixing.plan(docs, max_repeats=None, entropy=0.9, budget=1000).collect() if r.weight > 0]
    assert abs(-sum(r.weight * math.log(r.weight) for r in rows) - 0.9) < 1e-4
    out = Counter(r.source for r in mixing.mix(docs, max_repeats=None, entropy=0.9, budget=1000).collect())
    for r in rows:
        assert abs(out[r.source] * 10 - r.quota) <= 10, r
    assert mixing.mix(docs.where("false")).count() == 0


def test_many_sources(spark):
    """Work in proportion to the sources: twenty thousand of them."""
    n = 20_000
    sources = spark.range(n).select(F.concat(F.lit("s"), "id").alias("source"), (F.col("id") % 997 + 1).alias("tokens"))
    t = np.array([i % 997 + 1 for i in range(n)], dtype=float)
    for kw in ({"entropy": 9.8}, {"max_repeats": 3.0}):
        rows = mixing.temperature(sources, **kw).collect()
        w = (t / t.sum()) ** rows[0].alpha
        assert len(rows) == n and np.allclose(sorted(r.weight for r in rows), np.sort(w / w.sum()))
        if "entropy" in kw:
            assert abs(-sum(r.weight * math.log(r.weight) for r in rows) - 9.8) < 1e-4
        else:
            assert abs((1 - rows[0].alpha) * math.log(997) - math.log(3)) < 1e-4


def test_every_reading_has_its_own_permutation_and_names_do_not_clash(spark):
    docs = corpus(spark)
    keys = defaultdict(dict)
    for r in mixing.mix(docs.where("source = 'mid' OR source = 'big'"), max_repeats=2.0).collect():
        keys[r.mix_epoch][r.doc_id] = r.mix_key
    both = sorted(set(keys[0]) & set(keys[1]))
    assert len(both) > 20 and sorted(both, key=keys[0].get) != sorted(both, key=keys[1].get)
    odd = docs.withColumn("mix_key", F.lit("x")).withColumn("_mix_last", F.lit("y"))
    out = mixing.mix(odd, max_repeats=2.0)
    assert out.columns == [*odd.columns, "__mix_epoch", "__mix_key", "__mix_alpha", "__mix_weight"]
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in mixing.mix(docs, max_repeats=2.0).collect())


def test_null_ids_repeated_rows_and_long_texts_are_mixed(spark):
    rows = [(None, "a b", "s"), (None, "a b", "s"), (1, None, "s"), (2, "c", "s"), (2, "c", "s"), (3, "w " * 2_000_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, max_repeats=2.0)
    n = Counter((r.doc_id, r.source) for r in out.select("doc_id", "source").collect())
    assert set(n) == {(None, "s"), (1, "s"), (2, "s"), (3, "long")} and n[None, "s"] % 2 == 0 and n[3, "long"] == 1 and n[1, "s"] <= 2 * n[3, "long"] + 1


def test_partial_reading_is_a_prefix_of_the_permutation(spark):
    """Blocks of a few rows give the same cut as one running sum."""
    docs = corpus(spark)
    counted = docs.select("source", mixing.key_of("doc_id", 17, F.lit(0)).alias("key"), mixing.token_count().alias("tokens"))
    shares = spark.createDataFrame([("big", 555), ("mid", 0), (None, 99), ("none", 0)], "source string, rest long")
    keys = defaultdict(list)
    for r in counted.collect():
        keys[r.source].append((r.key, r.tokens))
    for block in (1, 8, 4096):
        last = {r.cs: r.last_key for r in mixing.cutoffs(counted, shares, block).collect()}
        for s, rest in (("big", 555), (None, 99), ("mid", 0)):
            run, want = 0, set()
            for k, t in sorted(keys[s]):
                run += t
                if run <= rest:
                    want.add(k)
            assert {k for k, _ in keys[s] if k <= last[s]} == want, (block, s)


# -- pieces


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return pieces.PieceModel(f.read())


def numbers(raw):
    return np.frombuffer(raw, np.int32).tolist()


def encoded(model, texts, check="words"):
    return [numbers(raw) for raw in model.encode(texts, check)]


def test_agendas_equal_the_library(model):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    alphabet = st.one_of(st.sampled_from(" \n\t▁etaoinshr.ſé한字😀\x00"), st.characters(exclude_categories=["Cs"]))

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet, max_size=120))
    def check(text):
        theirs = model.library.encode(text)
        assert encoded(model, [text]) == encoded(model, [text], "documents") == [[*theirs, 2]]
        whole = ("▁" + text.replace(" ", "▁")) if text else ""
        assert list(model.agenda(whole)) == theirs

    check()
    words = ["▁tionthe", "▁" * 30, "aaaaaaaaaaaa", "é", "▁the"]
    assert [tuple(numbers(raw)) for raw in model.agendas(words)] == [model.agenda(w) for w in words]


def test_kept_words_may_run_out(model, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 3)
    texts = [f"the quick{i} brown fox jumps{i % 3} over the lazy dog" for i in range(20)]
    for i in range(0, 20, 4):
        assert encoded(model, texts[i : i + 4], "documents") == [[*x, 2] for x in model.library.encode(texts[i : i + 4])]


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, None), (7000, ""), (7000, ""), (7001, "x" * 100_000)], docs.schema)).withColumn("ids", F.lit("clash"))
    got = pieces.encode_documents(docs, MODEL, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded == (texts[r.doc_id] or "") for r in got)
    back = pieces.decode_documents(spark.createDataFrame([(1, got[0].ids), (2, None)], "doc_id long, ids array<int>"), MODEL)
    assert {r.doc_id: r.decoded for r in back.collect()} == {1: got[0].decoded, 2: ""}


# -- nearest neighbours


def test_recall_and_exact_scores(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = v.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got = defaultdict(list)
    for r in ann.search(v, v.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in np.nonzero(ids % 20 == 0)[0]:
        s = x @ x[q]
        s[q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]].tolist()
        mine = got[ids[q]]
        assert len(mine) == 20 and all(abs(s[ids == i][0] - sc) < 1e-9 for i, sc in mine) and mine == sorted(mine, key=lambda t: (-t[1], t[0]))
        hit += len(set(want) & {i for i, _ in mine})
    assert hit / (20 * len(got)) >= 0.9


def test_vectors_that_take_no_part_copies_and_norms(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(c) for c in r.normal(size=4) * (1 + i % 7)]) for i in range(40)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(30)]
    bad = [(200, None), (201, [0.0] * 4), (202, [float("nan"), 1.0, 1.0, 1.0]), (203, [None, 1.0, 1.0, 1.0]), (204, [1.0]), (None, [1.0] * 4), (205, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([*rows, *bad, (100, [1.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    got = defaultdict(list)
    for x in ann.search(df, df, 5).orderBy("query_id", "rank").collect():
        got[x.query_id].append(x.vec_id)
    f32 = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    ids = np.array([i for i, _ in rows])
    assert set(got) == set(ids.tolist())
    for k, i in enumerate(ids):
        s = f32 @ f32[k]
        s[k] = -np.inf
        assert got[i] == ids[np.lexsort((ids, -s))[:5]].tolist()
    assert ann.search(df.where("false"), df, 5).count() == 0
    assert [x.vec_id for x in ann.search(df.where("vec_id < 2"), df.where("vec_id = 0"), 5).collect()] == [1]


def test_an_id_with_several_vectors_counts_with_its_best(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>")
    got = [tuple(x) for x in ann.search(df, df.where("vec_id = 2"), 5).collect()]
    assert got == [(2, 1, 1, 1.0), (2, 2, 3, 0.2)]
    # a query with two vectors
    got = [tuple(x) for x in ann.search(df, df.where("vec_id = 1"), 5).collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 1.0)]


def test_norms_far_apart_cost_no_recall(spark):
    """One vector a million times longer than the rest, one at the edge of what doubles hold, some very short ones."""
    r = np.random.default_rng(3)
    x = r.normal(size=(1200, 16))
    x[7] *= 1e6
    x[1100:] *= 1e-9
    huge = [1e200] + [0.0] * 15
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000, huge)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for row in ann.search(df, df.where("vec_id % 20 = 0"), 20).collect():
        got[row.query_id].add(row.vec_id)
    ids, every = np.array([*range(1200), 5000]), np.vstack([x, huge])
    hit = 0
    for q in range(0, 1200, 20):
        s = every @ every[q]
        s[q] = -np.inf
        hit += len(got[q] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
    assert hit / (20 * 60) >= 0.95


def test_walk_goes_on_until_no_near_node_is_open(spark):
    """A chain of nodes, each nearer to the query than the one before: 12 steps lead to the nearest."""
    n = 12
    vec = lambda i: np.array([i / n, 1.0], dtype=np.float16).tobytes()
    nodes = spark.createDataFrame([(i, bytearray(vec(i))) for i in range(n)], "node long, v binary")
    graph = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "node long, near long")
    asked = spark.createDataFrame([(100, bytearray(vec(n)))], "query long, q binary")
    starts = spark.createDataFrame([(100, 0)], "query long, node long")
    assert n - 1 in {r.node for r in ann.walk(graph, nodes, starts, asked, 1, 4).collect()}
    with pytest.raises(RuntimeError):
        ann.walk(graph, nodes, starts, asked, 1, 4, rounds=3)


# -- quality


def test_gradients_are_derivatives():
    r = np.random.default_rng(1)
    net = quality.ByteNet()
    texts = [bytes(r.integers(97, 105, n).astype(np.uint8)) for n in (40, 300, 900)]
    parts, y = [quality.chunks(t) for t in texts], np.array([1, 0, 1], np.float32)
    echo = np.concatenate([quality.echoes(x) for x in parts])
    g = net.gradients(parts, echo, y)

    def loss():
        p = np.clip(net._scored(parts), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name in net.p:
        p = net.p[name]
        at = np.unravel_index(np.argsort(-np.abs(g[name]).ravel())[:3], p.shape)
        for i in zip(*at, strict=True):
            old = p[i]
            p[i] = old + 1e-3
            up = loss()
            p[i] = old - 1e-3
            assert abs((up - loss()) / 2e-3 - g[name][i]) < 2e-2 * max(1, abs(g[name][i])), name
            p[i] = old


def test_chunks_cover_the_text():
    for n in (0, 1, 256, 257, 448, 449, 5000):
        c = quality.chunks(bytes(range(1, 251)) * (n // 250 + 1))[:1] if n == 0 else quality.chunks((bytes(range(1, 251)) * (n // 250 + 1))[:n])
        assert c.shape[1] == 256 and (n < 257 or bytes(c[-1]) == (bytes(range(1, 251)) * (n // 250 + 1))[:n][-256:])


def test_held_out_accuracy_and_cases(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model, ("doc_id",)).join(labels, "doc_id").where(quality.held_out()).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    good, junk = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([s >= 0.7 for s in good]) > 0.95 and np.mean([s < 0.7 for s in junk]) > 0.6
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 100_000), (3, "\x00")], "doc_id long, text string").withColumn("label", F.lit(1))
    got = quality.score(odd, model, tuple(odd.columns)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 1}) == 1
    assert quality.score(odd, quality.train(docs, labels.where("false")), ("doc_id",)).first().score == 0.5
    assert quality.score(odd.where("false"), model, ("doc_id",)).count() == 0


# -- pipeline


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, sizes = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == names
        if i == 1:
            norm = [" ".join(r.text.split()) for r in docs.collect()]
            assert len(norm) == len(set(norm))
        if i == 2:
            kept = {r.doc_id for r in docs.collect()}
        if i == 3:
            n = Counter(r.doc_id for r in docs.collect())
            assert set(n) == kept and max(n.values()) <= 2
    assert sizes[0] >= sizes[1] >= sizes[2] and sizes[3] == sizes[4]
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == sizes[4]


def test_op6_holds_whole_documents_against_the_library(spark, sf, monkeypatch):
    from tessera.llm import queries as q

    asked = []
    monkeypatch.setattr(pieces, "encode_documents", lambda *a, check="words", **k: asked.append(check))
    q.op6_sentencepiece(spark, sf)
    assert asked == ["documents"]
    with open(MODEL, "rb") as f:
        model = pieces.PieceModel(f.read())
    split = model.split
    monkeypatch.setattr(model, "split", lambda t: split(t)[:-1])  # a document's last word is lost
    model.encode(["one two three"], "words")
    with pytest.raises(AssertionError):
        model.encode(["one two three"], "documents")


def test_pipeline_stages_keep_what_brute_force_keeps(spark, sf):
    from tests.llm.test_dedup import near_by_brute_force

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(corpus_pipeline.keep_good(spark, docs, sf)) == sorted(i for i, t in texts.items() if model.score([t])[0] >= quality.THRESHOLD)
    first = {}
    for i in sorted(texts):
        first.setdefault(" ".join(texts[i].split()), i)
    assert ids(corpus_pipeline.drop_exact(spark, docs, sf)) == sorted(first.values())
    order = sorted(texts)
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i])) for i in order]
    parts = near_by_brute_force(words)
    assert ids(corpus_pipeline.drop_near(spark, docs, sf)) == [i for k, i in enumerate(order) if parts.get(k, k) == k]
    assert set(ids(corpus_pipeline.mix_sources(spark, docs, sf))) == set(order)
    with open(MODEL, "rb") as f:
        library = pieces.PieceModel(f.read()).library
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.to_ids(spark, docs, sf).select("doc_id", "ids").collect()}
    assert got == dict(zip(order, library.encode([texts[i] for i in order], add_eos=True), strict=True))


def test_pipeline_without_labels_keeps_all(spark, sf, tmp_path):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labels.where("false").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.keep_good(spark, docs, str(tmp_path)).count() == docs.count()


def test_every_operator_has_a_query():
    from tessera.llm import queries as q

    assert [n.split("_")[0] for n in q.queries()] == [f"op{i}" for i in range(1, 11)] and set(q.oracle_sql()) <= set(q.queries())


def test_a_round_of_the_search_is_one_plan(spark, monkeypatch):
    """The driver holds plans and jobs, not rows, so a round writes its state alone, with what is expanded next marked in it."""
    made, cut = [], ann.cut
    monkeypatch.setattr(ann, "cut", lambda df: made.append(cut(df)) or made[-1])
    monkeypatch.setattr(ann, "PIVOTS", 32)
    x = np.random.default_rng(4).normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=5, beam=20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [j for j in np.argsort(-(x @ x[q]), kind="stable").tolist() if j != q][:5] for q in range(0, 300, 20)}
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    assert any("now" in df.columns for df in made) and ["query", "node"] not in [df.columns for df in made]

"""SimHash and exact dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, simhash
from tessera.llm.components import components
from tests.compare import connect, same


def fingerprint(text, size=3):
    """Bit by bit."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def union(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprints_and_components(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in rows] + [(9001, None), (9002, ""), (9003, " \t"), (9004, "One two"), (9005, "one TWO"), (9005, "one TWO"), (None, "one two"), (9006, "É x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    got = simhash.fingerprint_components(docs).collect()
    f = [fingerprint(t) for _, t in rows]
    assert sorted((str(r.doc_id), r.fingerprint % (1 << 64)) for r in got) == sorted((str(i), x) for (i, _), x in zip(rows, f, strict=True))
    roots = union(len(rows), [(a, b) for a in range(len(f)) for b in range(a) if bin(f[a] ^ f[b]).count("1") <= 3])
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(x for x in (i, least.get(r)) if x is not None) if i is not None or r in least else None
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(i), str(least[r])) for (i, _), r in zip(rows, roots, strict=True))


def test_dense_fingerprints_lose_no_link(spark, monkeypatch):
    """Thousands of neighbours of one value, with runs that outgrow the bound and go on in blocks."""
    monkeypatch.setattr(simhash, "RUN", 64)
    r = random.Random(1)
    base = r.getrandbits(64)
    values = {base} | {base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for _ in range(500)} | {r.getrandbits(64) for _ in range(300)}
    v = np.array(sorted(values), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fingerprint long")
    got = {r.node: r.component for r in components(simhash.fingerprint_links(df)).collect()}
    pairs = [(a, b) for a in range(len(v)) for b in np.nonzero(np.bitwise_count(v[:a] ^ v[a]) <= 3)[0].tolist()]
    roots = union(len(v), pairs)
    want = {}
    for i, x in enumerate(v.view(np.int64).tolist()):
        want.setdefault(roots[i], []).append(x)
    assert {k: min(g) for g in want.values() if len(g) > 1 for k in g} == got


def test_components_of_chains_and_hubs(spark, monkeypatch):
    from tessera.llm import components as c

    monkeypatch.setattr(c, "CHUNK", 50)
    links = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 150)] + [(5000, 5000), (None, 3)]
    df = spark.createDataFrame(links, "u long, v long").repartition(7)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(150)}
    assert components(df.where("false")).count() == 0


def test_near_duplicates_are_found_and_others_left(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    common = [word() for _ in range(30)]
    make = lambda n: [r.choice(common) if r.random() < 0.4 else word() for _ in range(n)]
    texts = []
    for _ in range(60):
        w = make(r.choice([40, 120, 400]))
        texts.append(w)
        for _ in range(r.randint(0, 3)):
            x = list(w)
            for _ in range(max(1, int(len(w) * r.choice([0.005, 0.01, 0.05])))):
                x[r.randrange(len(x))] = word()
            texts.append(x)
    texts += [[], []]
    docs = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(texts)] + [(None, " ".join(texts[0]), "x"), (900, None, "x")], "doc_id long, text string, node string")
    sets = [frozenset(tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))) if t else frozenset() for t in texts] + [frozenset()]
    ids = [*range(len(texts)), 900]
    j = lambda a, b: 1.0 if a == b else len(a & b) / len(a | b)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if j(sets[a], sets[b]) >= 0.8]
    roots = union(len(sets), pairs)
    want = {ids[i]: ids[r_] for i, r_ in enumerate(roots) if roots.count(r_) > 1}
    got = {x.node: x.component for x in simhash.near_duplicates(docs).collect()}
    assert got == want
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert left.where("doc_id IS NULL").count() == 1 and left.count() == len(texts) + 2 - sum(k != v for k, v in got.items())
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def near_by_brute_force(texts):
    """Lists of words to index: least index of the component, for those that have a near duplicate."""
    sets = [frozenset(tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))) if t else frozenset() for t in texts]
    roots = union(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    return {i: x for i, x in enumerate(roots) if roots.count(x) > 1}


def test_varied_copies_of_one_text_lose_no_link(spark):
    """Links at the threshold within one crowded bucket: a forest on fingerprints alone passes some of them over."""
    r = random.Random(4)
    texts = []
    for rate in (0.012, 0.014, 0.016):
        base = [f"w{r.randrange(10**6)}" for _ in range(400)]
        for _ in range(100):
            x = list(base)
            for i in r.sample(range(400), round(400 * rate * r.uniform(0.9, 1.3))):
                x[i] = f"n{r.randrange(10**6)}"
            texts.append(x)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {x.node: x.component for x in simhash.near_duplicates(docs).collect()} == near_by_brute_force(texts)


def test_blocks_of_new_words_lose_no_link(spark):
    """New words in one block, appended or in place of others, at similarities from 0.8: word fingerprints differ by more than 15 bits."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**7)}"
    texts = []
    for n in (100, 300):
        for j in (0.8, 0.85, 0.9, 0.95):
            for _ in range(6):
                base = [word() for _ in range(n)]
                more = int((n - 4) * (1 / j - 1))
                texts += [base, base + [word() for _ in range(more)]]
                base = [word() for _ in range(n)]
                gone = int((n - 4) * (1 - j) / (1 + j))
                texts += [base, base[: n // 2] + [word() for _ in range(max(1, gone - 4))] + base[n // 2 + max(1, gone - 4) :]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = near_by_brute_force(texts)
    assert len(want) >= 0.9 * len(texts)
    assert {x.node: x.component for x in simhash.near_duplicates(docs).collect()} == want


def test_exact_dedup_matches_sql(spark, sf):
    from tessera.llm import queries as q

    same(q.op2_exact_dedup(spark, sf), connect(sf), q.oracle_sql()["op2_exact_dedup"])


ROWS = [(5, "a  b"), (3, "a\tb"), (7, " a b"), (4, None), (2, ""), (None, "a b"), (3, "a b"), (8, "c"), (None, "d"), (None, "d"), (9, "x" * 200_000), (10, "x" * 200_000)]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0)])
def test_exact_dedup_cases_and_collisions(spark, digest):
    """The second digest puts all texts in one group, which byte verification has to part."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("digest", F.lit(1))
    got = exact_dedup.decisions(docs, digest=digest).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == sorted([
        ("5", "3", 4, False), ("3", "3", 4, True), ("3", "3", 4, False), ("None", "3", 4, False), ("7", "7", 1, True), ("4", "2", 2, False), ("2", "2", 2, True),
        ("8", "8", 1, True), ("None", "None", 2, True), ("None", "None", 2, False), ("9", "9", 2, True), ("10", "9", 2, False)])


def test_keep_first_keeps_whole_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n", F.lit(1))
    out = exact_dedup.keep_first(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["3", "7", "2", "8", "None", "9"])
    assert exact_dedup.keep_first(docs.where("false")).count() == 0


def test_a_batch_opens_only_runs_whose_filter_hits_and_runs_are_compacted_by_tiers(spark):
    index = exact_dedup.DigestIndex(spark)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    batch = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    out = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.decisions(batch([(9, "a"), (4, "b"), (5, "b")]), index=index).collect()}
    assert out == {9: (9, 1, True), 4: (4, 2, True), 5: (4, 2, False)} and index.opened == []
    first = index.levels[0][0]
    out = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.decisions(batch([(2, "a"), (7, "c"), (8, "b")]), index=index).collect()}
    assert out == {2: (2, 2, True), 7: (7, 1, True), 8: (4, 3, False)} and index.opened == [first]
    second = index.levels[0][1]
    exact_dedup.decisions(batch([(20, "new"), (21, "texts")]), index=index).collect()
    assert index.opened == []  # neither run was read
    exact_dedup.decisions(batch([(1, "c")]), index=index).collect()
    assert index.opened == [second]
    assert [len(level) for level in index.levels] == [0, 1]  # four runs have become one of the next level
    got = {r.digest.hex(): (r["first"].id, r.n) for r in index.state().collect()}
    assert got == {sha("a"): (2, 2), sha("b"): (4, 3), sha("c"): (1, 2), sha("new"): (20, 1), sha("texts"): (21, 1)}
    assert exact_dedup.decisions(batch([]), index=index).count() == 0 and exact_dedup.DigestIndex(spark).state() is None



@pytest.mark.parametrize("hot", [1 << 17, 16])
def test_frequent_shingles_meet_in_blocks(spark, monkeypatch, hot):
    """Without any component known, the prefix filter alone gives every near pair, also where a shingle's rows outgrow the bound."""
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(6)
    texts = []
    for _ in range(2):
        base = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for _ in range(60):
            x = list(base)
            for i in r.sample(range(120), r.randint(1, 4)):
                x[i] = f"n{r.randrange(10**6)}"
            texts.append(x)
    texts += [["short", "text"], [], texts[0][:100], texts[0] + ["more"] * 9]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = simhash.cut(simhash.sketches(docs, 5, 0.8, "doc_id", "text", simhash.rarity(docs, 5, "text")))
    none = spark.createDataFrame([], "node long, same long"), spark.createDataFrame([], "node long, component long")
    pairs = {(x.u, x.v) for x in simhash.verified(simhash.rare_pairs(found, *none, 0.8), docs, 5, 0.8, "doc_id", "text").collect()}
    sets = [frozenset(tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))) if t else frozenset() for t in texts]
    assert pairs == {(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def near_misses(r, docs, words, edits):
    """Copies of one text with so many words replaced."""
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(docs):
        x = list(base)
        for i in r.sample(range(words), r.choice(edits)):
            x[i] = f"n{r.randrange(10**6)}"
        out.append(x)
    return out


@pytest.mark.parametrize(("family", "hot"), [(2048, 1 << 17), (16, 1 << 17), (16, 16)])
def test_near_misses_make_no_pairs(spark, monkeypatch, family, hot):
    """400 copies just below the similarity, of which some pairs reach it: no step may write rows by the square of their number.

    Fingerprints give no links here, so every pair is left to the prefix filter.
    """
    monkeypatch.setattr(simhash, "equal_variant_links", lambda *_, **__: spark.createDataFrame([], "u long, v long"))
    monkeypatch.setattr(simhash, "FAMILY", family)
    monkeypatch.setattr(simhash, "HOT", hot)
    made, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: made.append(cut(df)) or made[-1])
    r = random.Random(8)
    texts = [*near_misses(r, 400, 120, (2, 3)), *near_misses(r, 30, 60, (1, 2)), ["short", "text"], []]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = near_by_brute_force(texts)
    assert 2 < len(want) < 400 and len(set(want.values())) > 2
    assert {x.node: x.component for x in simhash.near_duplicates(docs).collect()} == want
    assert max(df.count() for df in made) <= (12 if family > 16 else 2 * 400 // 16) * len(texts)


def test_links_of_a_family_are_fewer_than_its_documents_and_join_all_pairs():
    r = random.Random(9)
    texts = [*near_misses(r, 150, 100, (1, 2)), *near_misses(r, 40, 100, (1, 2, 3))]
    sets = [np.unique(simhash.shingle_hashes([w.encode() for w in t], 5)) for t in texts]
    n, ids = len(sets), np.arange(len(sets))
    pairs = [(a, b) for a in range(n) for b in range(a) if len(x := np.intersect1d(sets[a], sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(x))]
    links = simhash._across_parts(ids, ids, np.ones(n, dtype=bool), sets, 0.8)
    assert len(links) < n < len(pairs) and union(n, links) == union(n, pairs) and {(max(p), min(p)) for p in links} <= set(pairs)


def test_rarity_counts_every_document(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 300)
    docs = spark.range(1200).select(F.concat(F.lit("one two three four five "), F.when(F.col("id") < 700, "").otherwise(F.col("id").cast("string"))).alias("text"))
    a, c = simhash._slots(simhash.shingle_hashes(b"one two three four five".split(), 5))
    seen = simhash.rarity(docs, 5, "text").value
    assert min(seen[0][a[0]], seen[1][c[0]]) == 300
    monkeypatch.undo()
    seen = simhash.rarity(docs, 5, "text").value
    assert min(seen[0][a[0]], seen[1][c[0]]) == 1200
    assert seen[0].sum() == seen[1].sum() == 1200 + 500


def test_only_shingles_that_may_be_shared_travel_and_lose_no_pair(spark):
    """300 texts, some of which share a passage with the next, and near copies; bitmaps part what is held together in one family."""
    r = random.Random(10)
    texts = [[f"u{r.randrange(10**9)}" for _ in range(80)] for _ in range(300)]
    for a, b in zip(range(0, 60), range(1, 61), strict=True):
        texts[b][5 * (b % 3) : 5 * (b % 3) + 5] = texts[a][40 + 5 * (b % 3) : 45 + 5 * (b % 3)]
    texts += near_misses(r, 20, 80, (1, 2))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = simhash.cut(simhash.sketches(docs, 5, 0.8, "doc_id", "text", simhash.rarity(docs, 5, "text")))
    none = spark.createDataFrame([], "node long, same long"), spark.createDataFrame([], "node long, component long")
    left, many = simhash._prefixes(found, none[0])
    flags = simhash.repeated(left, many)
    rows, _ = simhash._prefix_rows(left.withColumn("part", F.col("node")), many, flags)
    got = {(x.key, x.node): x.rest for x in rows.collect()}
    every = [(x.node, x.n, np.frombuffer(x.prefix, np.int64).tolist()) for x in left.collect()]
    often = {}
    for node, _, keys in every:
        for k in keys:
            often.setdefault(k, []).append(node)
    assert {(k, node) for k, nodes in often.items() if len(nodes) > 1 for node in nodes} <= set(got) and len(got) < many / 5
    assert all(got.get((k, node), n - i) == n - i for node, n, keys in every for i, k in enumerate(keys))
    met = simhash.reaching(left, many, flags, 0.8)
    want = near_by_brute_force(texts)
    assert len(want) > 2 and {x.node for x in met.collect()} >= set(want)
    of = simhash.families(left.join(met, "node", "left_semi"), many, flags, none[1], 0.8)
    assert {x.node for x in of.collect()} >= set(want)
    one = found.select("node", F.lit(0).cast("long").alias("component"))
    assert set(want) <= {x.node for x in simhash.closer_families(one, found, none[1], 0.8).collect()} <= set(range(300, 320))
    assert {x.node: x.component for x in simhash.near_duplicates(docs).collect()} == want


def test_bitmaps_bound_the_similarity_from_above():
    r = np.random.default_rng(5)
    sets = []
    for n in (3, 100, 127, 128, 140, 250, 1000, 5000):
        base = r.integers(0, 1 << 63, n, dtype=np.uint64)
        for cut in (0, n // 10, n // 5):
            sets.append(np.unique(np.concatenate([base[cut:], r.integers(0, 1 << 63, r.integers(0, n // 8 + 1), dtype=np.uint64)])))
    raw, n, ids = [simhash.parity(x) for x in sets], np.array([len(x) for x in sets]), np.arange(len(sets))
    links = simhash._near_bitmaps(ids, ids, np.ones(len(sets), dtype=bool), n, raw, 0.8)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(x := np.intersect1d(sets[a], sets[b])) >= 0.8 * (n[a] + n[b] - len(x))]
    up = union(len(sets), links)
    assert pairs and len(links) < len(sets) and all(up[a] == up[b] for a, b in pairs) and len(set(up)) >= 8
    assert simhash.parity(np.empty(0, np.uint64)) == b""
    for a in (np.array([0, 5, 1 << 30]), np.array([0]), np.arange(70_000)):
        assert (simhash._unpacked(simhash._packed(a)) == a).all()

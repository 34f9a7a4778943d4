"""Substring dedup against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, repeats


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def held_against_brute_force(spark, texts, window, bits=16, parts=5):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string").repartition(parts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(docs, window, bits=bits).collect()}
    assert got == dict(enumerate(brute(texts, window)))


@pytest.mark.parametrize(("window", "seed"), [(1, 1), (2, 2), (3, 3), (5, 4), (8, 5), (35, 6)])
def test_random_texts_with_few_words(spark, window, seed):
    """Few different words: most windows repeat, many in the same text, with overlaps and periods."""
    r = random.Random(seed)
    texts = [None, "", " \t\r\n", "a", "a " * 200, "a b " * 100, "é ü " * 50]
    texts += [" ".join(r.choice("abcd") for _ in range(r.randint(0, 6 * window))) for _ in range(60)]
    long = [" ".join(r.choice(["x", "yy", "zzz"]) + str(r.randint(0, 40)) for _ in range(400)) for _ in range(6)]
    for t in long:
        w = t.split()
        texts += [t, "\n".join(w[30:200]), "\t ".join(w[:90] + ["new"] + w[91:]), " ".join(w[100 : 100 + window]), " ".join(w[200 : 199 + window])]
    held_against_brute_force(spark, texts, window)


def test_long_texts_in_small_blocks(spark, monkeypatch):
    """Blocks that end within texts and words longer than a block."""
    r = random.Random(9)
    giant = "g" * 5000
    base = " ".join(r.choice(["u", "vv", "w" * 90, giant]) + str(r.randint(0, 9)) for _ in range(300))
    texts = [base, "first " + base, base[7000:20000], giant, giant + " " + giant, " " * 3000 + "end", "", base]
    data = [t.encode() for t in texts]
    import pyarrow as pa

    whole = list(repeats.hashed_blocks(pa.array(data, pa.binary()), 4))
    monkeypatch.setattr(repeats, "BLOCK", 200)
    monkeypatch.setattr(repeats, "LONG", 64)
    small = list(repeats.hashed_blocks(pa.array(data, pa.binary()), 4))
    assert len(whole) == 1 and len(small) > 50

    def words(blocks):
        return {(int(d), int(p)) for _, ds, ps in blocks for d, p in zip(ds, ps, strict=True)}

    assert words(whole) == words(small) == {(i, j) for i, t in enumerate(data) for j in range(len(t.split()))}
    # equal words have equal hashes, whatever block they fall into
    by_word = {}
    for h, ds, ps in small:
        for x, d, p in zip(h.tolist(), ds, ps, strict=True):
            by_word.setdefault(data[d].split()[p], set()).add(x)
    assert all(len(v) == 1 for v in by_word.values()) and len({x for v in by_word.values() for x in v}) == len(by_word)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """All cells hit: every window is estimated repeated, and the exact grouping decides."""
    monkeypatch.setattr(repeats, "HELD", 50)
    monkeypatch.setattr(repeats, "BLOCK_BITS", 4)
    r = random.Random(3)
    texts = [" ".join(str(r.randint(0, 10**6)) for _ in range(300)) for _ in range(30)]
    texts += [" ".join(texts[3].split()[50:120] + texts[4].split()[10:60])]
    held_against_brute_force(spark, texts, 12, bits=6)


def test_query_and_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: (n, k, hashlib.sha256(t.encode()).hexdigest()) for r, (n, k, t) in zip(rows, brute([r.text for r in rows], 35), strict=True)}
    got = queries.op11_repeats(spark, sf)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want and any(k for _, k, _ in want.values())
    assert repeats.remove_repeats(docs.where("false")).count() == 0
    twice = docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.n_words - r.n_removed for r in repeats.remove_repeats(twice).where("n_words >= 35").collect()].count(0) == 2 * sum(n >= 35 for n, _, _ in want.values())

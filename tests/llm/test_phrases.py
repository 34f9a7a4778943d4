"""Collocations against brute force and SQL."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import pyarrow as pa
import pytest

from tessera.llm import phrases, queries
from tests.compare import connect, same


def brute(rows, least, depth=4, top=2000, inside=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, depth + 1) for i in range(len(w) - k + 1))
    best, held = {}, {}
    for (lang, *w), a in f.items():
        if a < least or len(w) < 2:
            continue
        cuts = [(floor(Fraction(2000000 * a, f[(lang, *w[:k])] + f[(lang, *w[k:])])), k) for k in range(1, len(w))]
        score, k = min(cuts)
        best[(lang, *w)] = (lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score)
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                x = (lang, *w[i : i + m])
                held[x] = max(held.get(x, 0), a)
    kept = [v for x, v in best.items() if 100 * held.get(x, 0) < inside * v[2]]
    out = []
    for lang in {v[0] for v in kept}:
        own = sorted((v for v in kept if v[0] == lang), key=lambda v: (-v[6], -v[2], v[1].encode()))
        out += [(lang, i + 1, *v[1:]) for i, v in enumerate(own[:top])]
    return sorted(out)


def made(seed, n=400):
    r = random.Random(seed)
    words = ["The", "of", "é", "x\x01", "x", "x\x00y", "日本", "data"] + [f"w{i}" for i in range(12)]
    fixed = ["new york city", "of the data", "New  York\tCity hall", "x x x x x x", "x\x01 x of"]
    rows = []
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.4 else r.choice(words) for _ in range(r.randint(0, 40))]
        rows.append((r.choice(["en", "fr", None, "und", "a\tb\n"]), "".join(p + r.choice([" ", " ", " ", "\t", ". ", "\n", ",", "\x0b"]) for p in parts)))
    return rows + [("en", None), ("xx", ""), (None, " .,\n")]


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 30, 2000), (2, 5, 7), (3, 300, 2000)])
def test_random_texts(spark, monkeypatch, seed, least, top):
    monkeypatch.setattr(phrases, "HELD", 3000)
    monkeypatch.setattr(phrases, "NODES", 100)
    rows = made(seed)
    docs = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], "lang string, text string, words string, a int").repartition(6)
    got = phrases.collocations(docs, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top=top)


def test_small_blocks_lose_no_phrase(monkeypatch):
    """Phrases over the ends of blocks, words longer than a block, long blanks."""
    texts = [t for _, t in made(4, 60)] + ["g" * 3000 + " a b " + "g" * 3000 + " a b", " " * 2500 + "a b c" + " " * 900 + "d e"]
    data = [(t or "").encode() for t in texts]

    def counted(depth):
        c = Counter()
        for w, _ in phrases.word_blocks(pa.array(data, pa.binary()), pa.array(["en"] * len(data)), depth):
            for i in range(len(w.starts)):
                for n in range(1, depth + 1):
                    if i + n <= len(w.starts) and all(w.linked[i : i + n - 1]) and i + n - 1 >= w.fresh:
                        c[w.phrase(i, n)] += 1
        return c

    whole = counted(4)
    from tessera.llm import repeats

    monkeypatch.setattr(phrases, "BLOCK", 150)
    monkeypatch.setattr(repeats, "BLOCK", 150)
    monkeypatch.setattr(repeats, "LONG", 64)
    assert counted(4) == whole and len(whole) > 500


def test_query_same_as_sql(spark, sf):
    same(queries.op12_phrases(spark, sf), connect(sf), queries.oracle_sql()["op12_phrases"])


def test_empty_table_and_huge_counts(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).count() == 0
    one = spark.createDataFrame([("en", "a b " * 5000)], "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(one).collect())) == brute([("en", "a b " * 5000)], 30)

"""Phrase collocation mining with depth-limited count tries.

Each task (shard) counts its words and phrases in tries of limited depth, serialises them sorted, a block for each prefix range, and the
blocks of a range are merged k ways. It goes by depth, as deeper nodes are worth counting only below frequent ones:

1. For each depth from two on counts over hashes (``hashed``), of phrases whose both ends may be frequent by the depth before: merged, capped at the least
   count, they leave a bitmap of what may be frequent. Hashes that meet add up, so it never misses one. A bitmap is bounded by 2^MOST_BITS cells (64 MB).
2. Tries of full depth (``shard_tries``) of what the bitmaps hold, as sorted arrays of nodes with their links. A merge of the
   sorted blocks (``merged_tries``) gives exact counts; walking up a merged trie gives each phrase the counts of its left parts.

Suffix links (a phrase without its first words, again a node, mostly of another range) are equality joins and give the right parts; parents and
suffix links also carry a phrase's count to the phrases inside it. All counts are exact longs; products are decimals of 38 digits. Nodes are told
apart by 64-bit hashes of language and words (two of 10^9 nodes clash with a chance of 3 %).

Defined cases: a null text is empty, a null language ``und``; texts without words or languages without frequent phrases give no row; repeated rows count
each; texts and words of any length are read in blocks; phrases don't reach over pieces or documents; ties as stated in ``collocations``; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, small_batches, text_or_empty
from tessera.llm.repeats import mixed, word_hashes

LEAST = 30
DEPTH = 4
TOP = 2000
#: Parts per hundred of a phrase's count in a longer one from which the shorter is dropped.
INSIDE = 80
NO_LANG = "und"
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Prefix ranges hold some 2^ENTRY_BITS entries of hashed tries; the bitmap has some 2^bits cells.
ENTRY_BITS, MOST_RANGE_BITS, MOST_BITS = 18, 24, 29
#: Prefix ranges of full tries: one for each 2^RANGE_BYTES bytes of text.
LEAST_RANGES, RANGE_BYTES = 64, 22
#: Occurrences, or nodes, that a task holds before it gives its trie away; bytes hashed at a time.
HELD, NODES = 2_000_000, 1_000_000
BLOCK = 1 << 20

_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[ord("A") : ord("Z") + 1] += 32
_PLAIN[_BREAK] = 0x20
_PLAIN[0x09] = 0x20
_DEEPER = _U(0xE7037ED1A0B428DB)


class Words(NamedTuple):
    """Words of a block: lower-cased bytes, hashes (with the language), first bytes, texts, whether the next word is of the same piece, words that are new."""

    plain: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    linked: np.ndarray
    fresh: int

    def phrase(self, i: int, n: int) -> tuple[bytes, ...]:
        end = self.starts[i + n] if i + n < len(self.starts) else len(self.plain)
        return tuple(self.plain[self.starts[i] : end].tobytes().split())


def word_blocks(texts: pa.Array, langs: pa.Array, depth: int) -> Iterator[tuple[Words, list[str]]]:
    """Blocks of words; each begins some words early, so that phrases of depth words are whole in one, and counts those that end in new words."""
    texts = pc.cast(texts, pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    names = langs.to_pylist()
    salts = np.array([xxhash.xxh3_64_intdigest(x) for x in names], _U)
    at, early = 0, 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(_PLAIN[data[at:end]] == 0x20)
            back = max(int(offsets[np.searchsorted(offsets, end, "right") - 1]), at + int(gaps[-1]) + 1 if len(gaps) else 0)
            if back > at:
                end = back
            else:  # one long word
                stop = int(offsets[np.searchsorted(offsets, end, "right")])
                for step in range(end, stop, BLOCK):
                    if len(gaps := np.flatnonzero(_PLAIN[data[step : min(step + BLOCK, stop)]] == 0x20)):
                        stop = step + int(gaps[0])
                        break
                end = stop
        own = data[early:end]
        inside = np.union1d(offsets[(offsets >= early) & (offsets < end)] - early, [0])
        plain = _PLAIN[own]
        h, s = word_hashes(plain, inside)
        doc = np.searchsorted(offsets, s + early, "right") - 1
        piece = np.cumsum(_BREAK[own], dtype=np.int64)[s]
        linked = np.zeros(len(s), bool)
        linked[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        fresh = int(np.searchsorted(s, at - early))
        if len(s) > fresh:
            yield Words(plain, mixed(h ^ salts[doc]), s, doc, linked, fresh), names
        at, early = end, early + int(s[-min(depth - 1, len(s))]) if len(s) and depth > 1 else end


def paths(w: Words, bitmaps: list[np.ndarray], depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each depth hashes of the phrases that begin at each word, and which of them count: those whose ends do, and that their bitmap holds.

    The first bitmap is of words and pairs, each further one of phrases with a word more; deeper ones may be missing.
    """

    def known(cells: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = h >> _U(65 - (8 * len(cells)).bit_length())
        return (cells[at >> _U(3)] >> (_U(7) - (at & _U(7))).astype(np.uint8) & 1).astype(bool)

    keys, ok = w.hashes, known(bitmaps[0], w.hashes) if bitmaps else np.ones(len(w.hashes), bool)
    yield 1, keys, ok
    for n in range(2, depth + 1):
        if (size := len(w.hashes) - n + 1) <= 0:
            return
        keys = mixed(keys[:size] * _DEEPER + w.hashes[n - 1 :])
        ok = w.linked[:size] if n == 2 else ok[:size] & ok[1 : size + 1]
        if n - 2 < len(bitmaps):
            ok = ok & known(bitmaps[n - 2], keys)
        yield n, keys, ok


def hashed(texts: DataFrame, n: int, sent: list, range_bits: int, least: int) -> DataFrame:
    """range, keys, counts: sorted hashes of a task's phrases of n words (for two, of words too), with counts up to least."""

    def serialised(held: list[np.ndarray]) -> pa.RecordBatch:
        key, times = np.unique(np.concatenate(held) >> _U(32 - range_bits), return_counts=True)
        which = (key >> _U(32)).astype(np.int64)
        at = np.flatnonzero(np.diff(which, prepend=-1))
        low, times = key.astype(np.uint32), np.minimum(times, least).astype(np.uint8)
        spans = list(zip(at, np.append(at[1:], len(key)), strict=True))
        cols = [pa.array(which[at], pa.int64()), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (low, times))]
        return pa.RecordBatch.from_arrays(cols, names=["range", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, bitmaps = [], 0, [b.value for b in sent]
        for b in batches:
            for w, _ in word_blocks(b.column(0), b.column(1), n):
                for m, keys, ok in paths(w, bitmaps, n):
                    if m == n or n == 2:
                        at = np.flatnonzero(ok)
                        held.append(keys[at[at + m - 1 >= w.fresh]])
                        many += len(held[-1])
                if many >= HELD:
                    yield serialised(held)
                    held, many = [], 0
        if many:
            yield serialised(held)

    return texts.mapInArrow(run, "range long, keys binary, counts binary")


def added(keys: list[np.ndarray], counts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs merged, counts of equal keys added up, capped at least."""
    k, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.minimum(np.add.reduceat(n, at), least).astype(np.uint8)


def frequent_cells(texts: DataFrame, n: int, sent: list, bits: int, range_bits: int, least: int) -> np.ndarray:
    """The bitmap of phrases of n words (for two, of words too) that may come least times: a bit for each of 2^bits prefixes of hashes."""
    wide = bits - range_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = None, [], []

        def done() -> pa.RecordBatch:
            key, n = added(keys, counts, least)
            cells = np.zeros(1 << wide, bool)
            cells[key[n >= least] >> np.uint32(32 - wide)] = True
            keys.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(cells).tobytes()], pa.binary())], names=["range", "cells"])

        for b in batches:
            for which, key, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if which != now:
                    if keys:
                        yield done()
                    now = which
                keys.append(np.frombuffer(key.as_buffer(), np.uint32))
                counts.append(np.frombuffer(n.as_buffer(), np.uint8))
                if len(keys) > 256 and sum(map(len, keys[1:])) > 4 * len(keys[0]):
                    key, n = added(keys, counts, least)
                    keys[:], counts[:] = [key], [n]
        if keys:
            yield done()

    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros((1 << range_bits, max(1, (1 << wide) // 8)), np.uint8)
    for r in hashed(texts, n, sent, range_bits, least).repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(run, "range long, cells binary").toLocalIterator():
        out[r["range"]] = np.frombuffer(r["cells"], np.uint8)
    return out.reshape(-1)


#: A node of a trie: hashes of its path, of the path without its last and without its first word, of its last word; depth; count; prefix range.
NODE = np.dtype([("id", "u8"), ("parent", "u8"), ("end", "u8"), ("word", "u8"), ("n", "u8"), ("range", "u4"), ("depth", "u1")])
ROOTS = -1


def summed(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted runs of nodes merged by id, counts of equal nodes added up."""
    nodes = np.concatenate(parts)
    nodes = nodes[np.argsort(nodes["id"], kind="stable")]
    at = np.flatnonzero(np.concatenate([[True], nodes["id"][1:] != nodes["id"][:-1]])) if len(nodes) else np.zeros(0, int)
    out = nodes[at]
    if len(out):
        out["n"] = np.add.reduceat(nodes["n"], at, dtype=np.uint64)
    return out


def block_nodes(w: Words, bitmaps: list[np.ndarray], depth: int, ranges: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of a block for each depth, with a place of each."""
    h, before = w.hashes, w.hashes
    for n, keys, ok in paths(w, bitmaps, depth):
        at = np.flatnonzero(ok)
        at = at[at + n - 1 >= w.fresh]
        if len(at):
            ids, where, count = np.unique(keys[at], return_index=True, return_counts=True)
            i = at[where]
            nodes = np.zeros(len(ids), NODE)
            nodes["id"], nodes["range"], nodes["word"], nodes["depth"], nodes["n"] = ids, h[i] % _U(ranges), h[i + n - 1], n, count
            if n > 1:
                nodes["parent"], nodes["end"] = before[i], before[i + 1]
            yield nodes, i
        before = keys


def shard_tries(texts: DataFrame, sent: list, depth: int, ranges: int) -> DataFrame:
    """range, nodes, words: a task's trie of what may be frequent, serialised sorted by range and id. words: language (in hex) and word of the nodes of depth one.

    Range ROOTS holds the languages and how many words they have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps, held, texts_, roots, n = [b.value for b in sent], [], {}, {}, 0

        def serialised(nodes: np.ndarray) -> pa.RecordBatch:
            which = nodes["range"].astype(np.int64)
            order = np.argsort(which, kind="stable")
            nodes, which = nodes[order], which[order]
            at = np.flatnonzero(np.diff(which, prepend=-1))
            parts = [nodes[a:b] for a, b in zip(at, np.append(at[1:], len(nodes)), strict=True)]
            rows = [(int(which[a]), p.tobytes(), b"\n".join(texts_[x] for x in p["id"][p["depth"] == 1].tolist())) for a, p in zip(at, parts, strict=True)]
            if roots:
                rows.append((ROOTS, np.array(list(roots.values()), np.int64).tobytes(), b"\n".join(x.encode().hex().encode() for x in roots)))
            texts_.clear()
            roots.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["range", "nodes", "words"])

        for b in batches:
            for w, names in word_blocks(b.column(0), b.column(1), depth):
                for d, c in zip(*np.unique(w.docs[w.fresh :], return_counts=True), strict=True):
                    roots[names[d]] = roots.get(names[d], 0) + int(c)
                for nodes, i in block_nodes(w, bitmaps, depth, ranges):
                    held.append(nodes)
                    n += len(nodes)
                    if nodes["depth"][0] == 1:
                        for x, k in zip(nodes["id"].tolist(), i.tolist(), strict=True):
                            if x not in texts_:
                                texts_[x] = names[w.docs[k]].encode().hex().encode() + b"\t" + w.phrase(k, 1)[0]
                if n > NODES:
                    held = [summed(held)]
                    if (n := len(held[0])) > NODES * 4 // 5:
                        yield serialised(held[0])
                        held, n = [], 0
        if n or roots:
            yield serialised(summed(held or [np.zeros(0, NODE)]))

    return texts.mapInArrow(run, "range long, nodes binary, words binary")


def merged_tries(tries: DataFrame, least: int) -> DataFrame:
    """lang, text (of words and roots), id, parent, end, depth, a, left, words: nodes that come least times, and roots (depth 0).

    left[k-1] is the count of the first k words, found by walking up the trie; end is the node without the first word; words are hashes.
    """
    kinds = (pa.string(), pa.string(), *[pa.int64()] * 5, *[pa.list_(pa.int64())] * 2)
    names = ["lang", "text", "id", "parent", "end", "depth", "a", "left", "words"]

    def ragged(columns: np.ndarray, n: np.ndarray) -> pa.Array:
        """The first n of each row."""
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(columns[np.arange(columns.shape[1]) < n[:, None]].view(np.int64), pa.int64()))

    def walked(nodes: np.ndarray, blocks: list[tuple[np.ndarray, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        nodes = nodes[nodes["n"] >= least]
        if not len(nodes):
            return
        depth = nodes["depth"].astype(np.int64)
        counts, words = np.zeros((len(nodes), DEPTH), np.int64), np.zeros((len(nodes), DEPTH), np.uint64)
        at = np.arange(len(nodes))
        for up in range(DEPTH):  # own word and count last, then the parents'
            live = depth > up
            counts[live, depth[live] - 1 - up] = nodes["n"][at[live]]
            words[live, depth[live] - 1 - up] = nodes["word"][at[live]]
            more = depth > up + 1
            at[more] = np.searchsorted(nodes["id"], nodes["parent"][at[more]])
        text: list = [None] * len(nodes)
        lang: list = [None] * len(nodes)
        for ids, said in blocks:
            where = np.minimum(np.searchsorted(nodes["id"], ids), len(nodes) - 1)
            for k in np.flatnonzero((nodes["id"][where] == ids) & (depth[where] == 1)).tolist():
                if text[where[k]] is None:
                    a, b = said[k].split(b"\t")
                    lang[where[k]], text[where[k]] = bytes.fromhex(a.decode()).decode(), b.decode()
        longs = [np.ascontiguousarray(nodes[c]).view(np.int64) for c in ("id", "parent", "end")] + [depth, nodes["n"].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(text, pa.string()), *(pa.array(c) for c in longs), ragged(counts, depth - 1), ragged(words, depth)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, blocks, roots = None, [], [], {}
        for b in batches:
            for which, nodes, words in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if which == ROOTS:
                    for x, n in zip(words.split(b"\n"), np.frombuffer(nodes.as_buffer(), np.int64).tolist(), strict=True):
                        roots[x] = roots.get(x, 0) + n
                    continue
                if which != now and parts:
                    yield from walked(summed(parts), blocks)
                    parts, blocks = [], []
                now = which
                parts.append(np.frombuffer(nodes.as_buffer(), NODE))
                blocks.append((parts[-1]["id"][parts[-1]["depth"] == 1], words.split(b"\n")))
                if len(parts) > 64:
                    parts = [summed(parts)]
        if parts:
            yield from walked(summed(parts), blocks)
        if roots:
            none: list = [None] * len(roots)
            cols = [[bytes.fromhex(x.decode()).decode() for x in roots], none, none, none, none, [0] * len(roots), list(roots.values()), none, none]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    tasks = int(tries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "lang string, text string, id long, parent long, end long, depth long, a long, left array<long>, words array<long>"
    return tries.repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(run, schema)


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP, inside: int = INSIDE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``depth`` words (DEPTH at most) by score, count, phrase.

    The score of a cut into two parts is floor(2000000 a / (l + r)); the lowest counts, of equal ones the first.
    Phrases are dropped if a longer frequent one that holds them has at least ``inside`` hundredths of their count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(text_or_empty(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    entries = max(1, size // 4)
    range_bits = min(MOST_RANGE_BITS, max(2, ceil(log2(entries)) - ENTRY_BITS))
    bits = min(MOST_BITS, max(range_bits + 10, ceil(log2(entries))))
    depth, sent = min(depth, DEPTH), []
    for n in range(2, depth + 1):
        # far fewer phrases of three words and more are in question
        sent.append(spark.sparkContext.broadcast(frequent_cells(texts, n, sent, bits if n == 2 else bits - 2, range_bits, min(least, 255))))
    trie = cut(merged_tries(shard_tries(texts, sent, depth, max(LEAST_RANGES, size >> RANGE_BYTES)), least))
    roots = trie.where("depth = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    phrases = trie.where("depth > 1")
    whole = "decimal(28,0)"
    # suffix links, followed k times: the node without the first k words
    node = trie.where("depth > 0").select(F.col("id").alias("end"), F.col("a").alias("r"), F.col("end").alias("next"))
    at, scored = phrases.select("id", "a", "depth", "left", "end"), None
    for k in range(1, DEPTH):
        at = at.where(F.col("depth") > k).join(node, "end")
        cuts = at.select("id", "a", F.lit(k).alias("k"), F.col("left")[k - 1].alias("l"), "r")
        scored = cuts if scored is None else scored.unionByName(cuts)
        at = at.select("id", "a", "depth", "left", F.col("next").alias("end"))
    scored = scored.withColumn("score", F.expr(f"(cast(a as {whole}) * 2000000) div (cast(l as {whole}) + cast(r as {whole}))"))
    best = scored.groupBy("id", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    # of all phrases that hold a phrase, those with one word more have the highest counts: they are its children, and nodes whose first link it is
    longer = trie.where("depth > 2").select(F.explode(F.array("parent", "end")).alias("id"), F.col("a").alias("longer"))
    held = longer.groupBy("id").agg(F.max("longer").alias("longer"))
    kept = best.join(held, "id", "left").where(f"longer is null or cast(longer as {whole}) * 100 < cast(a as {whole}) * {int(inside)}").drop("longer")
    # words of what is kept
    said = phrases.select("id", F.posexplode("words").alias("i", "word")).join(kept.select("id"), "id", "left_semi").join(trie.where("depth = 1").select(F.col("id").alias("word"), "lang", "text"), "word")
    named = said.groupBy("id").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("m.score"), F.desc("a"), "phrase")
    ranked = kept.join(named, "id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(roots, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", F.col("m.score").cast("long").alias("score"))

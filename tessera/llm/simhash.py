"""SimHash near-dedup by deletion-variant signatures.

A fingerprint is cut into segments, few enough that of two that may be linked one segment differs by at most
one bit. Of every segment the variants with one wildcard bit are indexed; equal variants meet and
are verified. Where they meet a group is never expanded into pairs: the sorted rows of an index key are one run,
and a run gives a spanning forest of its verified links (no more links than members, and the same
components). A run longer than ``RUN`` goes on in blocks, one task for every pair of blocks, which is exact too.

``fingerprint_links``: 64 bits in 2 segments of 32, links at 3 or fewer differing bits; exact, because of
3 differing bits at most one lies in one of two segments. ``near_duplicates``: documents whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more; exact. At that similarity fingerprints of shingles differ by
up to 14 of 64 bits, which no few segments can hold, so first candidates come from the steadier
fingerprint of distinct words (128 bits in 4 segments of 32), and each link is verified on the whole shingle sets.
These links make most components at little cost but miss pairs (more than 7 differing bits, new words in a block, pairs
off a run's forest). So every pair that may reach 0.8 and isn't in one component by then meets on its rarest shingles (a prefix filter with
places). Pairs aren't made there: rows that meet are linked to one of them, and the components of these links (``families``) hold all such pairs.
Families chain, so their documents' bitmaps are held against one another first, which bounds the similarity from above (``closer_families``). Each
family's whole sets then go to one task (in blocks beyond a bound), which tells its documents apart and gives no more links than documents (``family_links``).
Only shingles that may occur in another document travel (``repeated``), and only documents that meet another in reach are indexed at all (``reaching``).
``rare_pairs`` lists the candidates as pairs for callers who want them all.

Words are runs of ``[^\\x20\\x09-\\x0D]`` after A-Z are lower-cased; hashes are XXH64, seed 42.

Defined cases: a null text is empty; a text without words has fingerprint zero and no shingles (two of those
are near duplicates of one another); fewer words than a shingle: the whole sequence; null ids take part in fingerprint
components and never name one; in ``near_duplicates`` rows with a null id stay as they are, and rows that share
an id stay or go together; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checked_broadcast, cut, small_batches, text_or_empty
from tessera.llm.components import components

SEED = 42
RUN = 4096
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# -- fingerprints


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() without an argument splits at exactly [\\x20\\x09-\\x0D]."""
    return (text or "").encode().translate(LOWER).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash for each shingle, repeats included."""
    h = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([h(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    first, last = [0, *ends[:-size].tolist()], (ends[size - 1 :] - 1).tolist()
    return np.array([h(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    set_ = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        set_ += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3, text_col: str = "text") -> DataFrame:
    """docs' other columns and fingerprint (the 64 bits as a signed long)."""
    keep = [c for c in docs.columns if c != text_col]
    src = docs.select(*keep, text_or_empty(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array([majority(shingle_hashes(words_of(t), size)) for t in b.column(len(keep)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(out)], names=[*keep, "fingerprint"])

    small_batches(docs.sparkSession)
    kinds = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "fingerprint long"]))


# -- links between equal variants


def variants(prints: DataFrame, words: list[str]) -> DataFrame:
    """key, node, check: for each 32-bit half of each word, and each wildcard bit in it, the rest of the half."""
    halves = [(i, F.col(w) if s == 0 else F.shiftrightunsigned(F.col(w), 32)) for i, (w, s) in enumerate((w, s) for w in words for s in (0, 1))]
    keys = F.array(*[
        h.bitwiseAND(F.lit(0xFFFFFFFF ^ 1 << bit)).bitwiseOR(F.lit((i * 32 + bit) << 32)) for i, h in halves for bit in range(32)
    ])
    return prints.select(F.explode(keys).alias("key"), "node", "check")


def forest(node: np.ndarray, check: np.ndarray, most: int, nearest: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links (differing bits of check at most ``most``); nearest: a least one.

    Prim's rounds over numpy rows: no matrix of all pairs is held.
    """
    n = len(node)
    best, by, free, out = np.full(n, 127, dtype=np.int16), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool), []
    for _ in range(n):
        open_ = np.nonzero(free)[0]
        at = open_[best[open_].argmin()]
        if best[at] <= most:
            out.append((int(node[by[at]]), int(node[at])))
        free[at] = False
        open_ = open_[open_ != at]
        d = np.bitwise_count(check[open_] ^ check[at]).astype(np.int16)
        less = d < best[open_] if nearest else (d <= most) & (best[open_] > most)
        best[open_[less]], by[open_[less]] = d[less], at
    return out


def _links(keys: np.ndarray, node: np.ndarray, check: np.ndarray, most: int, nearest: bool) -> list[tuple[int, int]]:
    """keys are sorted."""
    edge = np.nonzero(np.diff(keys))[0] + 1
    start, size = np.r_[0, edge], np.diff(np.r_[0, edge, len(keys)])
    two = start[size == 2]
    ok = two[(np.bitwise_count(check[two] ^ check[two + 1]) <= most) & (node[two] != node[two + 1])]
    out = list(zip(node[ok].tolist(), node[ok + 1].tolist(), strict=True))
    for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        out += forest(node[s : s + n], check[s : s + n], most, nearest)
    return out


def equal_variant_links(index: DataFrame, most: int, nearest: bool = False) -> DataFrame:
    """index (key, node, check) to u, v: links between rows of a key whose checks differ by at most ``most`` bits."""
    spark = index.sparkSession
    shape = "kind int, u long, v long, key long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, dtype=np.int64)] * 3
        hot = None  # the key of a run that has outgrown RUN: its rows go on as they are

        def rows(kind: int, u, v, key) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, dtype=np.int32)), pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(key, pa.int64())], names=["kind", "u", "v", "key"])

        def linked(k, n, c) -> pa.RecordBatch:
            pairs = np.array(sorted({(min(p), max(p)) for p in _links(k, n, c.view(np.uint64), most, nearest) if p[0] != p[1]}), dtype=np.int64).reshape(-1, 2)
            return rows(0, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), dtype=np.int64))

        for b in batches:
            k, n, c = (np.concatenate([r, b.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest))
            if hot is not None and len(k):
                more = np.searchsorted(k, hot, side="right")
                if more:
                    yield rows(1, n[:more], c[:more], k[:more])
                    k, n, c = k[more:], n[more:], c[more:]
                hot = hot if not len(k) else None
            last = np.searchsorted(k, k[-1]) if len(k) else 0
            if last:
                yield linked(k[:last], n[:last], c[:last])
            rest = [k[last:], n[last:], c[last:]]
            if len(rest[0]) > RUN:
                hot = int(rest[0][0])
                yield rows(1, rest[1], rest[2], rest[0])
                rest = [np.empty(0, dtype=np.int64)] * 3
        if len(rest[0]):
            yield linked(*rest)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = cut(index.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(run, shape))
    links, over = met.where("kind = 0").select("u", "v"), met.where("kind = 1").select("key", F.col("u").alias("node"), F.col("v").alias("check"))
    if over.isEmpty():
        return links.distinct()
    # every pair of blocks of a long run is a group of its own
    blocks = over.groupBy("key").count().select("key", F.ceil(F.col("count") / (RUN // 4)).cast("int").alias("blocks"))
    placed = over.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "node", "check"
    )

    def block_pair(rows: pd.DataFrame) -> pd.DataFrame:
        got = forest(rows.node.to_numpy(), rows.check.to_numpy().view(np.uint64), most, nearest)
        return pd.DataFrame([(min(p), max(p)) for p in got if p[0] != p[1]], columns=["u", "v"], dtype="int64")

    return links.unionByName(pairs.groupBy("key", "a", "b").applyInPandas(block_pair, "u long, v long")).distinct()


def fingerprint_links(prints: DataFrame, most: int = 3) -> DataFrame:
    """u, v between fingerprints (distinct longs in column fingerprint) of at most 3 differing bits."""
    if most > 3:
        raise ValueError("two segments hold up to 3 differing bits")
    nodes = prints.select(F.col("fingerprint").alias("node"), F.col("fingerprint").alias("check")).distinct()
    return equal_variant_links(variants(nodes, ["node"]), most)


def fingerprint_components(docs: DataFrame, size: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, fingerprint (long), component_id (the smallest id of its component)."""
    prints = cut(fingerprints(docs.select(id_col, F.col(text_col).alias("__in")), size, "__in"))
    # rows of a fingerprint first meet in a partial minimum, so copies cost nothing further on
    least = prints.groupBy("fingerprint").agg(F.min(id_col).alias("least"))
    parts = components(fingerprint_links(prints, most))
    named = (
        least.join(parts, least["fingerprint"] == parts["node"], "left")
        .select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    )
    named = cut(named)
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = named.join(names, "component").select("fingerprint", "component_id")
    # only fingerprints of several rows, or linked ones, need a look-up; the shuffle is of three narrow columns
    return prints.join(label, "fingerprint").select(id_col, "fingerprint", "component_id")


# -- near duplicates by shingle similarity

WORDS = 2
#: Counters of the order of rarity, and how far they count. Any common order is exact; a better one is faster.
SLOTS, COUNTED = 1 << 20, (1 << 32) - 1
SLOT_BLOCK = 1 << 16
#: Rows of shingles in one task of the meeting: a pair shares many, and is counted once for each task in which it meets.
MEET_ROWS = 2_000_000
#: Pairs that a task holds before they go on.
HELD = 1 << 20
#: Rows of one shingle that a task holds; those of a more frequent one meet in blocks.
HOT = 1 << 17
#: Documents and shingles of a family that meet in one task at a time; a larger family goes on in blocks.
FAMILY, FAMILY_SHINGLES = 2048, 500_000


#: Bitmaps of a family that meet in one task at a time, as a multiple of FAMILY and FAMILY_SHINGLES: they hold a sixteenth to a thirty-second of the sets' bytes.
BITMAPS = 8
#: Bits of a document's bitmap at least and at most, and of the bitmap of shingles that may occur twice.
LEAST_BITS, MOST_BITS = 1 << 8, 1 << 16
LEAST_FLAGS, MOST_FLAGS = 20, 28
#: Buckets of 32 bits of a shingle's hash, by which it is told which occur twice.
BUCKETS = 10


def parity(shingles: np.ndarray) -> bytes:
    """Bit i is 1 if an odd number of shingles falls on it; two to four bits for a shingle. Two sets' bitmaps differ in no more bits than the sets in shingles."""
    if not len(shingles):
        return b""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(shingles) - 1).bit_length()))
    return np.packbits(np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers without a sign in as few bytes as the largest needs, the bytes of one place together, compressed."""
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zlib.compress(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(memoryview(b)[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view("<u8").ravel()


def set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def sketches(docs: DataFrame, size: int, least: float, id_col: str, text_col: str, seen: Broadcast) -> DataFrame:
    """A row for each document, from one pass over the texts: node (the id), w0, w1: the bits of its distinct words, check and same:
    fingerprint and hash of its set of shingles, n: their number, prefix: the hashes of its rarest shingles in a common order, bits: its bitmap as of ``parity``.

    Two sets with similarity t share one of the first n - ceil(t * n) + 1 of each in any common order. seen: as of ``rarity``.
    """
    src = docs.select(F.col(id_col).cast("long").alias("node"), text_or_empty(text_col).alias("text")).where("node IS NOT NULL")
    seeds = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) | 1 for i in range(WORDS)], dtype=np.uint64)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = seen.value
        for b in batches:
            cols: list[list[int]] = [[] for _ in range(WORDS + 2)]
            sizes, prefixes, bits = [], [], []
            for t in b.column(1).to_pylist():
                w = words_of(t)
                one = shingle_hashes(sorted(set(w)), 1) if len(w) > 1 else shingle_hashes(w, 1)
                for i, s in enumerate(seeds):
                    x = one * s  # a further 64 bits of each word's hash
                    x ^= x >> np.uint64(29)
                    x *= np.uint64(0xBF58476D1CE4E5B9)
                    cols[i].append(majority(x ^ (x >> np.uint64(32))))
                shingles = np.unique(shingle_hashes(w, size))
                cols[-2].append(majority(shingles))
                cols[-1].append(set_hash(shingles))
                sizes.append(len(shingles))
                bits.append(parity(shingles))
                most = len(shingles) - int(_least_common(np.array(len(shingles)), least)) + 1 if len(shingles) else 0
                # shingles are sorted, so a stable sort leaves equally rare ones in the order of their hashes
                a, c = _slots(shingles)
                prefixes.append(shingles[np.argsort(np.minimum(often[0][a], often[1][c]), kind="stable")[:most]].tobytes())
            longs = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in cols]
            yield pa.RecordBatch.from_arrays([b.column(0), *longs, pa.array(sizes, pa.int32()), pa.array(prefixes, pa.binary()), pa.array(bits, pa.binary())], names=["node", *(f"w{i}" for i in range(WORDS)), "check", "same", "n", "prefix", "bits"])

    return src.mapInArrow(run, "node long, " + ", ".join(f"w{i} long" for i in range(WORDS)) + ", check long, same long, n int, prefix binary, bits binary")


def verified(pairs: DataFrame, docs: DataFrame, size: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """Those pairs (u, v) whose documents' shingle sets have a Jaccard similarity of at least ``least``."""
    nodes = cut(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    src = docs.select(F.col(id_col).cast("long").alias("node"), text_or_empty(text_col).alias("text"))
    src = src.join(checked_broadcast(nodes, 1_000_000), "node", "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(words_of(t), size)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    sets = cut(src.mapInArrow(hashed, "node long, shingles binary"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, ok = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, k in zip(u, ok, strict=True) if k], pa.int64()), pa.array([i for i, k in zip(v, ok, strict=True) if k], pa.int64())], names=["u", "v"])

    left, right = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")


def _slots(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return shingles % np.uint64(SLOTS), (shingles >> np.uint64(32)) % np.uint64(SLOTS)


def rarity(docs: DataFrame, size: int, text_col: str) -> Broadcast:
    """How often (up to COUNTED) shingles of each slot occur in all documents, once each; two rows of slots.

    They are counted where the texts are; a task's counts travel as blocks of slots and are folded block by block.
    """
    names = ["block", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * SLOTS, np.int64)  # the second row of slots follows the first
        held: list[np.ndarray] = []

        def added() -> None:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            seen[at] += n
            held.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                for row, at in enumerate(_slots(np.unique(shingle_hashes(words_of(t), size)))):
                    held.append(at.astype(np.int64) + row * SLOTS)
            if sum(map(len, held)) > 1 << 20:
                added()
        if held:
            added()
        for k, block in enumerate(np.minimum(seen, COUNTED).astype(np.uint32).reshape(-1, SLOT_BLOCK)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([_packed(block)], pa.binary())], names=names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, np.zeros(SLOT_BLOCK, np.int64)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.minimum(seen, COUNTED).astype(np.uint32).tobytes()], pa.binary())], names=names)
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield row()
                    now, seen = block, np.zeros(SLOT_BLOCK, np.int64)
                seen += _unpacked(counts).astype(np.int64)
        if now is not None:
            yield row()

    small_batches(docs.sparkSession)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(count, "block long, counts binary").repartition(tasks, "block").sortWithinPartitions("block")
    out = np.zeros((2 * SLOTS // SLOT_BLOCK, SLOT_BLOCK), dtype=np.uint32)
    for r in dealt.mapInArrow(fold, "block long, counts binary").toLocalIterator():  # 8 MB in all
        out[r["block"]] = np.frombuffer(r["counts"], np.uint32)
    return docs.sparkSession.sparkContext.broadcast(out.reshape(2, SLOTS))


def _least_common(n: np.ndarray, least: float) -> np.ndarray:
    """The fewest shingles that a set of n shares with any other at the similarity."""
    return np.ceil(n * least - 1e-9).astype(np.int64)


def _across(node: np.ndarray, n: np.ndarray, part: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs (place, places) of one key's rows (sorted by n) that lie in different components and are near enough in size.

    Rows of the largest component are never paired with one another.
    """
    names, count = np.unique(part, return_counts=True)
    main = part == names[count.argmax()]
    for i in np.nonzero(~main)[0].tolist():
        lo, hi = np.searchsorted(n, n[i] * least - 1e-9), np.searchsorted(n, n[i] / least + 1e-9, side="right")
        j = np.arange(lo, hi)
        j = j[(part[lo:hi] != part[i]) & (main[lo:hi] | (j > i)) & (node[lo:hi] != node[i])]
        if len(j):
            yield i, j


def _rows(node: np.ndarray, n: np.ndarray, found: Iterator[tuple[int, np.ndarray]]) -> Iterator[np.ndarray]:
    """Rows u, v, larger size, smaller size of pairs."""
    for i, j in found:
        yield np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), np.maximum(n[i], n[j]), np.minimum(n[i], n[j])], axis=1)


def _counted(held: list[np.ndarray]) -> np.ndarray:
    """Distinct rows with how often each occurs."""
    if not held:
        return np.empty((0, 5), dtype=np.int64)
    rows, times = np.unique(np.concatenate(held), axis=0, return_counts=True)
    return np.hstack([rows, times[:, None]])


def _hot_pairs(over: DataFrame, least: float) -> DataFrame:
    """u, v, large, small, times out of the rows (key, node, n, part) of frequent shingles.

    All rows are dealt out to sides, and those outside the shingle's largest component to blocks besides; every block meets every
    side in a group of its own, which holds at most some HOT rows.
    """
    parts = over.groupBy("key", "part").count()
    names = parts.groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.sum("count").alias("rows"), F.max("count").alias("most"))
    size = HOT // 4
    shape = names.select("key", "main", F.ceil(F.col("rows") / size).cast("int").alias("sides"), F.greatest(F.lit(1), F.ceil((F.col("rows") - F.col("most")) / size)).cast("int").alias("blocks"))
    rows = over.join(shape, "key").withColumns({"h": F.xxhash64("node", F.lit(SEED)), "other": F.col("part") != F.col("main")})
    side, block = F.pmod("h", F.col("sides")).cast("int"), F.pmod(F.shiftright("h", 20), F.col("blocks")).cast("int")
    every = rows.select("key", "node", "n", "part", "other", F.lit(False).alias("begins"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"), side.alias("b"))
    begins = rows.where("other").select("key", "node", "n", "part", "other", F.lit(True).alias("begins"), block.alias("a"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("b"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows[~rows.begins].sort_values("n", kind="stable")
        node, n, part, other = r.node.to_numpy(), r.n.to_numpy().astype(np.int64), r.part.to_numpy(), r.other.to_numpy()
        held = []
        for x in rows[rows.begins].itertuples():
            lo, hi = np.searchsorted(n, x.n * least - 1e-9), np.searchsorted(n, x.n / least + 1e-9, side="right")
            j = np.arange(lo, hi)
            j = j[(part[lo:hi] != x.part) & (~other[lo:hi] | (node[lo:hi] > x.node))]  # two others meet twice, and count once
            held.append(np.stack([np.minimum(x.node, node[j]), np.maximum(x.node, node[j]), np.maximum(x.n, n[j]), np.minimum(x.n, n[j])], axis=1))
        return pd.DataFrame(_counted(held), columns=["u", "v", "large", "small", "times"])

    return every.unionByName(begins).groupBy("key", "a", "b").applyInPandas(meet, "u long, v long, large long, small long, times long")


def _runs(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[list[np.ndarray]]:
    """Whole runs of a key (the first column, sorted), many at a time; pieces of a run of over bound rows come by themselves, marked by a further item."""
    wait: list[list[np.ndarray]] = []
    many, hot = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        if hot is not None:
            more = int(np.searchsorted(cols[0], hot, side="right"))
            if more:
                yield [*(c[:more] for c in cols), hot]
            cols = [c[more:] for c in cols]
            if not len(cols[0]):
                continue
            hot = None
        wait.append(cols)
        many += len(cols[0])
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last or len(wait) > 1 and wait[-2][0][-1] != cols[0][0]:
            whole = [np.concatenate(c) for c in zip(*wait, strict=True)]
            last += len(whole[0]) - len(cols[0])
            yield [c[:last] for c in whole]
            wait, many = [[c[last:] for c in whole]], len(whole[0]) - last
        if many > bound:
            hot = wait[0][0][0]
            yield [*(np.concatenate(c) for c in zip(*wait, strict=True)), hot]
            wait, many = [], 0
    if wait:
        yield [np.concatenate(c) for c in zip(*wait, strict=True)]


def _prefixes(found: DataFrame, gone: DataFrame) -> tuple[DataFrame, int]:
    """node, n, prefix of the documents that no other stands for, and the number of their prefixes' shingles."""
    docs = found.select("node", "same", "n", "prefix").join(checked_broadcast(gone, 1_000_000), ["node", "same"], "left_anti").select("node", "n", "prefix")
    return docs, (docs.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // 8


def _high(keys: np.ndarray) -> np.ndarray:
    """32 bits of each shingle's hash, mixed, as prefixes hold those of some slots rather than others."""
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)


def repeated(docs: DataFrame, many: int) -> Broadcast:
    """A bitmap, by the first bits of ``_high``, with a 1 for each shingle that occurs in several prefixes, and for some that don't.

    docs: as of ``_prefixes``. Of a task's shingles only sorted differences travel, some two bytes each; a bucket's are told apart on two bitmaps
    of a fixed size, however many they are. The bitmap has at most 2^MOST_FLAGS bits: more shingles make it let more through, nothing is lost.
    """
    bits = min(MOST_FLAGS, max(LEAST_FLAGS, (4 * many).bit_length()))
    names, width = ["bucket", "hashes"], 32 - BUCKETS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held)).astype(np.int64)
            edge = np.searchsorted(h, np.arange(1, 1 << BUCKETS) << width)
            rows = [(k, _packed(np.diff(x, prepend=k << width))) for k, x in enumerate(np.split(h, edge)) if len(x)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=names)

        for b in batches:
            held.append(_high(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)))
            if sum(map(len, held)) > 1 << 21:
                yield out()
        if held:
            yield out()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, np.zeros(1 << width, bool), np.zeros(1 << width, bool)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([zlib.compress(np.packbits(twice.reshape(1 << (bits - BUCKETS), -1).any(axis=1), bitorder="little").tobytes(), 1)], pa.binary())], names=names)
        for b in batches:
            for bucket, hashes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now:
                    if now is not None:
                        yield row()
                    now, once[:], twice[:] = bucket, False, False
                h = np.cumsum(_unpacked(hashes).astype(np.int64))
                twice[h[1:][np.diff(h) == 0]] = True
                twice[h[once[h]]] = True
                once[h] = True
        if now is not None:
            yield row()

    spark = docs.sparkSession
    small_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("prefix").mapInArrow(gather, "bucket long, hashes binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    out = np.zeros((1 << BUCKETS, 1 << (bits - BUCKETS - 3)), dtype=np.uint8)
    for r in dealt.mapInArrow(fold, "bucket long, hashes binary").collect():  # 32 MB at most in all
        out[r["bucket"]] = np.frombuffer(zlib.decompress(r["hashes"]), np.uint8)
    return spark.sparkContext.broadcast(out.ravel())


def _prefix_rows(docs: DataFrame, many: int, flags: Broadcast) -> tuple[DataFrame, int]:
    """key, node, n, part and rest for each shingle of a prefix that may be in another, and the number of tasks for them to meet in.

    docs: node, n, part, prefix. rest: how many shingles of the document aren't rarer than this one, so the most that it shares with another if none rarer is shared.
    """
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = flags.value
        shift = np.uint64(32 - (len(often) * 8 - 1).bit_length())
        for b in batches:
            raw = b.column(3).to_pylist()
            size = np.array([len(x) // 8 for x in raw], dtype=np.int64)
            keys = np.frombuffer(b"".join(raw), np.uint64)
            at = (_high(keys) >> shift).astype(np.int64)
            ok = (often[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            of = np.repeat(np.arange(len(size)), size)[ok]
            node, n, part = (b.column(i).to_numpy(zero_copy_only=False)[of] for i in range(3))
            rest = n - (np.nonzero(ok)[0] - (np.cumsum(size) - size)[of])
            yield pa.RecordBatch.from_arrays([pa.array(keys[ok].view(np.int64)), pa.array(node), pa.array(n), pa.array(part), pa.array(rest.astype(np.int32))], names=["key", "node", "n", "part", "rest"])

    small_batches(docs.sparkSession)
    return docs.select("node", "n", "part", "prefix").mapInArrow(rows_of, "key long, node long, n int, part long, rest int"), max(4, ceil(many / MEET_ROWS))


def _with_parts(docs: DataFrame, parts: DataFrame) -> DataFrame:
    return docs.join(checked_broadcast(parts, 1_000_000), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")


def _in_reach(key: np.ndarray, n: np.ndarray, rest: np.ndarray, least: float) -> np.ndarray:
    """Which rows of runs of a key, sorted by n, have another whose size the similarity allows. Whatever partner a row has, both stay."""
    edge = np.nonzero(np.diff(key))[0] + 1
    start = np.r_[0, edge]
    of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(key)]))
    places = (of << 32) + n
    top = np.maximum(np.floor(rest * ((1 + least) / least) - n + 1e-6), -1).astype(np.int64)
    lo = np.searchsorted(places, (of << 32) + np.ceil(n * least - 1e-6).astype(np.int64))
    hi, i = np.searchsorted(places, (of << 32) + top, side="right"), np.arange(len(key))
    ok = hi - lo > ((lo <= i) & (i < hi))
    return ok & (np.add.reduceat(ok, start, dtype=np.int64)[of] > 1)


def reaching(docs: DataFrame, many: int, flags: Broadcast, least: float) -> DataFrame:
    """node of the documents that share a shingle of their prefixes with another whose size and place allow the similarity; docs: node, n, prefix."""
    rows, k = _prefix_rows(docs.withColumn("part", F.col("node")), many, flags)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], names=["node"])
        for key, n, rest, node, *hot in _runs(batches, HOT):
            held.append(np.unique(node if hot else node[_in_reach(key, n.astype(np.int64), rest.astype(np.int64), least)]))
            size += len(held[-1])
            if size > HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    met = rows.select("key", "n", "rest", "node").repartition(k, "key").sortWithinPartitions("key", "n").mapInArrow(meet, "node long")
    return cut(met.distinct())


def rare_pairs(found: DataFrame, gone: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """u, v: every pair of documents in different components that may have the similarity, and others.

    They meet on their prefixes; as these hold the rarest shingles, those that many documents hold hardly ever meet. A pair must share
    enough of them: what it shares beyond both prefixes is at most ceil(t * n) - 1 for the larger n, and t / (1 + t) of both sizes is needed.
    found: rows of ``sketches``; gone (node, same): sets that another document stands for; parts: node, component.
    """
    docs, many = _prefixes(found, gone)
    rows, k = _prefix_rows(_with_parts(docs, parts), many, repeated(docs, many))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["u", "v", "large", "small", "times"]

        def out(rows: np.ndarray) -> pa.RecordBatch:
            """Pairs, or (times 0) a frequent shingle's rows: u is the node, v its component, large its size, small the key."""
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=names)

        held, many = [], 0
        for key, node, n, part, *hot in _runs(batches, HOT):
            n = n.astype(np.int64)
            if hot:
                yield out(np.stack([node, part, n, key, np.zeros_like(n)], axis=1))
                continue
            start = np.r_[0, np.nonzero(np.diff(key))[0] + 1]
            stop = np.r_[start[1:], len(key)]
            mixed = np.minimum.reduceat(part, start) != np.maximum.reduceat(part, start)
            for s, e in zip(start[mixed].tolist(), stop[mixed].tolist(), strict=True):
                for p in _rows(node[s:e], n[s:e], _across(node[s:e], n[s:e], part[s:e], least)):
                    held.append(p)
                    many += len(p)
                    if many > HELD:
                        yield out(_counted(held))
                        held, many = [], 0
        yield out(_counted(held))

    met = cut(rows.drop("rest").repartition(k, "key").sortWithinPartitions("key", "n").mapInArrow(meet, "u long, v long, large long, small long, times long"))
    pairs, over = met.where("times > 0"), met.where("times = 0").select(F.col("small").alias("key"), F.col("u").alias("node"), F.col("large").cast("int").alias("n"), F.col("v").alias("part"))
    pairs = pairs if over.isEmpty() else pairs.unionByName(_hot_pairs(over, least))
    shared = pairs.groupBy("u", "v").agg(F.sum("times").alias("times"), F.max("large").alias("large"), F.min("small").alias("small"))
    need = F.ceil((F.col("large") + F.col("small")) * (least / (1 + least)) - 1e-9) - F.ceil(F.col("large") * least - 1e-9) + 1
    return shared.where(F.col("times") >= need).select("u", "v")


def _stars(key: np.ndarray, node: np.ndarray, n: np.ndarray, part: np.ndarray, rest: np.ndarray, least: float) -> np.ndarray:
    """Links (least node, node) within runs of a key sorted by n, such that two rows of different components whose sizes and rests allow the
    similarity are linked. A pair shares its rarest common shingle with rests of at least t / (1 + t) of both sizes, and one of these keys is that shingle.
    """
    edge = np.nonzero(np.diff(key))[0] + 1
    start, stop = np.r_[0, edge], np.r_[edge, len(key)]
    mixed = np.minimum.reduceat(part, start) != np.maximum.reduceat(part, start)
    top = rest * ((1 + least) / least) - n + 1e-6  # the largest size of a partner
    out = []
    for s, e in zip(start[mixed].tolist(), stop[mixed].tolist(), strict=True):
        sizes, tops = n[s:e], top[s:e]
        lo, hi, i = np.searchsorted(sizes, sizes * least - 1e-6), np.searchsorted(sizes, tops, side="right"), np.arange(e - s)
        at = np.nonzero(hi - lo > ((lo <= i) & (i < hi)))[0]
        if len(at) < 2:
            continue
        # no row beyond a gap is within the reach of one before it
        first = np.r_[0, np.nonzero(sizes[at[1:]] > np.maximum.accumulate(tops[at])[:-1])[0] + 1]
        many = np.diff(np.r_[first, len(at)])
        who, of = node[s:e][at], part[s:e][at]
        head = np.repeat(np.minimum.reduceat(who, first), many)
        own = np.repeat(np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first), many) & (head != who)
        out.append(np.stack([head[own], who[own]], axis=1))
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)


def families(docs: DataFrame, many: int, flags: Broadcast, parts: DataFrame, least: float) -> DataFrame:
    """node, component of documents such that each pair in different parts that may have the similarity is in one component here.

    No pair is made: of a shingle's rows each is linked to one other at most, so there are no more links than rows. docs, many and flags: as of
    ``_prefixes`` and ``repeated``; parts: node, component.
    """
    rows, k = _prefix_rows(_with_parts(docs, parts), many, flags)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: list[np.ndarray]) -> pa.RecordBatch:
            got = np.unique(np.concatenate(links), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in got.T], names=["u", "v"])

        held, many, now, head = [], 0, None, 0
        for key, node, n, part, rest, *hot in _runs(batches, HOT):
            if hot:  # pieces of a very long run: all are linked
                if hot[0] != now:
                    now, head = hot[0], node[0]
                held.append(np.stack([np.full(len(node), head), node], axis=1))
            else:
                held.append(_stars(key, node, n.astype(np.int64), part, rest.astype(np.int64), least))
            many += len(held[-1])
            if many > HELD:
                yield out(held)
                held, many = [], 0
        if held:
            yield out(held)

    return components(cut(rows.repartition(k, "key").sortWithinPartitions("key", "n").mapInArrow(meet, "u long, v long")))


def _across_parts(node: np.ndarray, part: np.ndarray, begins: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (u, v) of documents whose sets have the similarity, from each that begins to one of each other part that it reaches.

    Parts that a link has joined are one from there on, so there are fewer links than documents. Every pair is told apart by its whole sets.
    """
    n = np.array([len(x) for x in sets], dtype=np.int64)
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[ids] > 1  # what one document alone has is in no pair
    start = np.r_[0, np.cumsum(np.add.reduceat(shared, np.r_[0, np.cumsum(n)[:-1]], dtype=np.int64))]
    ids, size = ids[shared], np.diff(start)
    part, mark, out = part.copy(), np.zeros(len(often), dtype=bool), []
    for i in np.nonzero(begins)[0].tolist():
        need = np.ceil((n + n[i]) * (least / (1 + least)) - 1e-6)
        j = np.nonzero((part != part[i]) & (node != node[i]) & (np.minimum(size, size[i]) >= need))[0]
        if not len(j):
            continue
        mark[mine := ids[start[i] : start[i + 1]]] = True
        many = size[j]
        at = np.arange(many.sum()) + np.repeat(start[j] - (np.cumsum(many) - many), many)
        both = np.add.reduceat(mark[ids[at]], np.cumsum(many) - many, dtype=np.int64)
        mark[mine] = False
        j = j[both >= least * (n[j] + n[i] - both)]
        if len(j):
            names, first = np.unique(part[j], return_index=True)
            out += [(int(node[i]), int(node[x])) for x in j[first].tolist()]
            part[np.isin(part, names)] = part[i]
    return out


def _grouped(near: DataFrame, docs: int, n: int) -> DataFrame:
    """near (node, n, family, part, and others) with other (not of the family's largest part) and in how many sides and blocks its family goes on.

    A family of over docs documents or n shingles goes on in groups of a block and a side, as do frequent shingles in ``_hot_pairs``: documents
    outside the family's largest part, by blocks, meet all, by sides.
    """
    by_part = near.groupBy("family", "part").agg(F.count("*").alias("docs"), F.sum(F.col("n").cast("long")).alias("n"))
    shape = by_part.groupBy("family").agg(
        F.max_by("part", F.struct("docs", "part")).alias("main"), F.max(F.struct("docs", "part", "n")).alias("most"), F.sum("docs").alias("docs"), F.sum("n").alias("n")
    )
    groups = lambda a, b: F.greatest(F.lit(1), F.ceil(a / docs), F.ceil(b / n)).cast("int")
    shape = shape.select("family", "main", groups(F.col("docs"), F.col("n")).alias("sides"), groups(F.col("docs") - F.col("most.docs"), F.col("n") - F.col("most.n")).alias("blocks"))
    # a small family is one group, and none of its rows comes twice
    shape = shape.withColumn("blocks", F.when(F.col("sides") > 1, F.col("blocks")).otherwise(1))
    return near.join(shape, "family").withColumn("other", F.col("part") != F.col("main")).drop("main")


def _told_apart(rows: DataFrame, all_rows: int, n: int, raw_col: str, tell) -> DataFrame:
    """u, v: what tell (begins, node, part, n, raw values of a group) gives for each group of a family (rows as of ``_grouped``)."""
    h = F.xxhash64("node", F.lit(SEED))
    side, block = F.pmod(h, F.col("sides")).cast("int"), F.pmod(F.shiftright(h, 20), F.col("blocks")).cast("int")
    wide = F.col("sides") > 1
    group = lambda a, b, begins: F.struct(a.alias("a"), b.alias("b"), begins.alias("begins"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda a: group(a, side, ~wide & F.col("other")))
    begins = F.when(wide & F.col("other"), F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda b: group(block, b, F.lit(True)))).otherwise(F.array())
    cols = ["node", "part", "n", raw_col]
    dealt = rows.select("family", *cols, F.explode(F.concat(every, begins)).alias("g")).select("family", "g.a", "g.b", "g.begins", *cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            got = []
            if len(rows) > 1:
                starts, node, part, n, raw = zip(*rows, strict=True)
                got = tell(np.array(node), np.array(part), np.array(starts), np.array(n, dtype=np.int64), raw)
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in got], pa.int64()), pa.array([v for _, v in got], pa.int64())], names=["u", "v"])

        now, held = None, []
        for b in batches:
            for *group, starts, node, part, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not raw:
                    continue
                if group != now:
                    yield out(held)
                    now, held = group, []
                held.append((starts, node, part, n, raw))
        yield out(held)

    small_batches(rows.sparkSession)
    keys = ("family", "a", "b")
    k = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(all_rows / n))
    return dealt.repartition(k, *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def _travelling(near: DataFrame) -> int:
    """How many shingles travel in all, with repeats."""
    return int(near.agg(F.sum(F.col("n") * (F.col("blocks") + F.when(F.col("other") & (F.col("sides") > 1), F.col("sides")).otherwise(0)))).first()[0] or 0)


def _near_bitmaps(node: np.ndarray, part: np.ndarray, begins: np.ndarray, n: np.ndarray, raw: tuple[bytes, ...], least: float) -> list[tuple[int, int]]:
    """Links (u, v) such that two documents of different parts, one of which begins, are linked or reach one another if their bitmaps allow the similarity.

    Two sets of n and m shingles at similarity t differ in at most (1 - t) / (1 + t) of n + m shingles, and their bitmaps in no more bits.
    """
    size = np.array([len(x) for x in raw])
    tables = {s: (at := np.nonzero(size == s)[0], np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(len(at), -1)) for s in np.unique(size).tolist()}
    halved = {s: t.reshape(len(at), 2, -1) for s, (at, t) in tables.items() if s > LEAST_BITS // 8}
    halved = {s: t[:, 0] ^ t[:, 1] for s, t in halved.items()}
    set_, out = np.arange(len(node)), []
    for i in np.nonzero(begins)[0].tolist():
        mine, s = np.frombuffer(raw[i], np.uint64), int(size[i])
        for other in (s // 2, s, 2 * s):  # sizes of more than twice one another are out of reach
            if other not in tables:
                continue
            at, table = tables[other]
            own = mine if other >= s else mine.reshape(2, -1)[0] ^ mine.reshape(2, -1)[1]
            table = halved[other] if other > s else table
            ok = (n[at] >= n[i] * least - 1e-6) & (n[at] * least <= n[i] + 1e-6) & (part[at] != part[i]) & (set_[at] != set_[i]) & (node[at] != node[i])
            at, table = at[ok], table[ok]
            at = at[np.bitwise_count(table ^ own).sum(axis=1, dtype=np.int64) <= (n[at] + n[i]) * ((1 - least) / (1 + least)) + 1e-6]
            if len(at):
                names, first = np.unique(set_[at], return_index=True)
                out += [(int(node[i]), int(node[x])) for x in at[first].tolist()]
                set_[np.isin(set_, names)] = set_[i]
    return out


def closer_families(of: DataFrame, found: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """of (node, component), of which only those pairs of different parts are held together whose bitmaps allow the similarity.

    One shingle in common makes a family, and families chain; whole sets need travel only among documents that may be alike by all their shingles.
    """
    near = _with_parts(of.withColumnRenamed("component", "family"), parts).join(found.select("node", F.col("n").alias("n"), "bits"), "node")
    near = cut(_grouped(near, BITMAPS * FAMILY, BITMAPS * FAMILY_SHINGLES))
    return components(cut(_told_apart(near, _travelling(near), BITMAPS * FAMILY_SHINGLES, "bits", lambda *group: _near_bitmaps(*group, least))))


def family_links(of: DataFrame, found: DataFrame, parts: DataFrame, docs: DataFrame, size: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """u, v: links at the similarity that, with those within parts, make the components of all pairs of one family (of: node, component).

    A document's whole set travels once, to the task of its family, unless the family is larger than FAMILY documents or FAMILY_SHINGLES shingles.
    """
    near = _with_parts(of.withColumnRenamed("component", "family"), parts)
    near = cut(_grouped(near.join(found.groupBy("node").agg(F.sum("n").cast("long").alias("n")), "node"), FAMILY, FAMILY_SHINGLES))
    src = docs.select(F.col(id_col).cast("long").alias("node"), text_or_empty(text_col).alias("text")).join(checked_broadcast(near, 1_000_000), "node")
    kept = ["node", "family", "part", "n", "other", "sides", "blocks"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(words_of(x), size)).tobytes() for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(sets, pa.binary())], names=[*kept, "shingles"])

    small_batches(docs.sparkSession)
    sets = src.select(*kept, "text").mapInArrow(hashed, "node long, family long, part long, n long, other boolean, sides int, blocks int, shingles binary")
    tell = lambda node, part, starts, _, raw: _across_parts(node, part, starts, [np.frombuffer(x, np.uint64) for x in raw], least)
    return _told_apart(sets, _travelling(near), FAMILY_SHINGLES, "shingles", tell)


def near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", check_bits: int = 20) -> DataFrame:
    """node, component of the documents that have a near duplicate; component is the smallest id."""
    found = cut(sketches(docs, size, least, id_col, text_col, rarity(docs, size, text_col)))
    words = [f"w{i}" for i in range(WORDS)]
    # documents of one set are linked to the least of them, so a hot one is indexed once
    alike = [*words, "check", "same"]
    known = found.drop("n", "prefix", "bits")
    heads = known.groupBy(*alike).agg(F.min("node").alias("node"))
    copies = cut(known.withColumnRenamed("node", "v").join(heads.withColumnRenamed("node", "u"), alike).select("u", "v", "same").where("u <> v"))
    gone = copies.select(F.col("v").alias("node"), "same").distinct()
    docs_left, many = _prefixes(found, gone)
    flags = repeated(docs_left, many)
    met = checked_broadcast(reaching(docs_left, many, flags, least), 1_000_000)
    near = equal_variant_links(variants(heads.join(met, "node", "left_semi"), words), check_bits, nearest=True)
    pairs = cut(near.unionByName(copies.select("u", "v")).distinct())
    links = cut(verified(pairs, docs, size, least, id_col, text_col))
    parts = components(links)
    of = families(docs_left.join(met, "node", "left_semi"), many, flags, parts, least)
    of = closer_families(of, found, parts, least)
    flags.unpersist()
    more = cut(family_links(of, found, parts, docs, size, least, id_col, text_col))
    if more.isEmpty():
        return parts
    return components(cut(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)))


def drop_near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of near duplicates other than the smallest id of each component."""
    gone = cut(near_duplicates(docs, size, least, id_col, text_col).where("node <> component").select(F.col("node").alias("__node")))
    return docs.join(checked_broadcast(gone, 1_000_000), docs[id_col] == F.col("__node"), "left_anti").select(docs.columns)

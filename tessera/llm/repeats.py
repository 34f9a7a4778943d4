"""Substring dedup by a count-min prefilter: words covered by a window of words that also starts elsewhere are removed.

A window is ``window`` consecutive words of one document. First pass: each window is counted under its representative, the
least hash among the runs of words of about half its length that it contains. Equal windows have equal representatives, neighbours
mostly share one, so a tenth of the updates fill the sketch. The count-min sketches of partitions (sparse blocks) are merged
block by block into a bitmap of cells that were hit more than once. Counts are only ever overestimated, so no repeated window is lost.

Second pass: only windows estimated repeated leave their task, a row for each run of neighbours with one representative. Runs
are grouped exactly: a run found twice has only repeated windows. Runs that share their representative but not their ends (where passages
begin and end) are compared window by window. Groups are counted before they shuffle, and no group is gathered.

Hashes of words and windows have 64 bits; two windows are held equal if 64-bit hashes of their contents and of their representatives both agree.
The bitmap is sized by the bytes of the texts up to ``MOST_BITS`` (2^29 cells a row, 128 MB in all); beyond that size more windows reach the exact grouping, nothing else changes.

Defined cases: a null or empty text has no words; texts with fewer words than a window keep all; repeated rows (equal ids and
texts) count as separate places, so their windows repeat; windows don't reach over documents; overlapping equal windows count as two;
texts of any length are hashed in blocks of ``BLOCK`` bytes; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, small_batches, text_or_empty

WINDOW = 35
#: Rows of the sketch; each has 2^bits cells.
DEPTH = 2
LEAST_BITS, MOST_BITS = 16, 29
#: Cells of a row for each representative that is expected (one in some 60 bytes of text).
ROOM = 8
BYTES_EACH = 60
#: Cells of a block, in which sketches travel.
BLOCK_BITS = 16
#: Updates that a task holds before it gives its sketch away.
HELD = 4_000_000
#: Bytes hashed at a time; words over LONG bytes are hashed alone.
BLOCK = 4 << 20
LONG = 1 << 16

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SALTS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_VALUES[_BLANK] = 0
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n - 1, base, _U)]))
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of bytes in which texts begin at ``starts``: a hash for each word, and the place of its first byte."""
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts], edge[-1] = True, True
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1] | edge[1:-1]
    last[:-1] &= blank[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(data) > 2 * BLOCK and len(s) > 0:  # a word that is longer than a block, and few others
        one = lambda w: xxhash.xxh3_64_intdigest(w.tobytes()) if len(w) > LONG else word_hashes(w, np.zeros(1, int))[0][0]
        return np.array([one(data[a:b]) for a, b in zip(s, e, strict=True)], _U), s
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_VALUES[data] * _power(_BASE, len(data)), out=sums[1:])
    h = mixed((sums[e] - sums[s]) * _power(pow(_BASE, -1, 1 << 64), len(data))[s])
    for i in np.flatnonzero(e - s > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[s[i] : e[i]].tobytes())
    return h, s


def hashed_blocks(texts: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of words, their text's index and their place in it, some bytes at a time; a block repeats the last words of the one before, so that each window is whole in one."""
    texts = pc.cast(texts, pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    at, kept = 0, None
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):  # only between words or texts
            near = offsets[np.searchsorted(offsets, end, "right") - 1]
            gaps = np.flatnonzero(_BLANK[data[at:end]])
            back = max(near, at + gaps[-1] + 1 if len(gaps) else 0)
            if back > at:
                end = int(back)
            else:
                end = int(offsets[np.searchsorted(offsets, end, "right")])
                for step in range(at + BLOCK, end, BLOCK):
                    if len(gaps := np.flatnonzero(_BLANK[data[step : min(step + BLOCK, end)]])):
                        end = step + int(gaps[0])
                        break
        inside = offsets[(offsets >= at) & (offsets < end)] - at
        h, s = word_hashes(data[at:end], inside)
        doc = np.searchsorted(offsets, s + at, "right") - 1
        new = np.flatnonzero(np.diff(doc, prepend=-1))
        place = np.arange(len(h)) - np.repeat(new, np.diff(np.append(new, len(h))))
        if kept is not None and len(h):
            same = doc == kept[1][-1]
            place[same] += kept[2][-1] + 1
            h, doc, place = (np.concatenate(x) for x in zip(kept, (h, doc, place), strict=True))
        elif kept is not None:
            h, doc, place = kept
        yield h, doc, place
        n = min(window - 1, len(h)) if len(h) else 0
        kept = (h[-n:], doc[-n:], place[-n:]) if n else None
        at = end


def joined_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words."""
    size, g = 1, h
    while size * 2 <= n:
        g, size = mixed(g[:-size] * _U(_SALTS[0]) + g[size:]), size * 2
    return g if size == n else mixed(g[: len(g) - (n - size)] * _U(_SALTS[1]) + g[n - size :])


def runs(h: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Representatives of runs, each run's first window among all, the windows' first words, the windows' hashes."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none.astype(_U), none, none, none.astype(_U)
    size = 1 << max(0, int(log2(window)) - 1)
    g = joined_hashes(h, size)
    low = _U((1 << 24) - 1)
    least, width = (g & ~low) | np.arange(len(g), dtype=_U), 1
    while width < (span := window - size + 1):  # least of so many neighbours, the first of equal ones
        step = min(width, span - width)
        least, width = np.minimum(least[: len(least) - step], least[step:]), width + step
    whole = np.flatnonzero(doc[: len(h) - window + 1] == doc[window - 1 :])
    at = (least & low).astype(np.int64)[whole]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return g[at[first]], first, whole, joined_hashes(h, window)[whole]


def cells(rep: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mixed(rep * _U(_SALTS[row]) + _U(row)) >> _U(64 - bits)


def partition_sketches(texts: DataFrame, window: int, bits: int) -> DataFrame:
    """row, block, once, twice: the cells of a block that a task hit, and those that it hit more than once."""

    def sketch(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rep = np.concatenate(held)
        for row in range(DEPTH):
            cell, n = np.unique(cells(rep, row, bits), return_counts=True)
            block = (cell >> _U(BLOCK_BITS)).astype(np.int64)
            at = np.flatnonzero(np.diff(block, prepend=-1))
            low = (cell & _U((1 << BLOCK_BITS) - 1)).astype(np.uint16)
            for a, b in zip(at, np.append(at[1:], len(cell)), strict=True):
                out.append((row, int(block[a]), low[a:b].tobytes(), low[a:b][n[a:b] > 1].tobytes()))
                if len(out) == 4096:
                    yield batch()
        if out:
            yield batch()

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["row", "block", "once", "twice"])
        out.clear()
        return made

    out: list[tuple] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for h, doc, _ in hashed_blocks(b.column(0), window):
                held.append(runs(h, doc, window)[0])
                n += len(held[-1])
                if n >= HELD:
                    yield from sketch(held)
                    held, n = [], 0
        if held:
            yield from sketch(held)

    return texts.select("text").mapInArrow(run, "row int, block long, once binary, twice binary")


def merged(sketches: DataFrame) -> DataFrame:
    """row, block, bits: a bitmap of the cells that all partitions together hit more than once. Rows of a block are folded one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, np.zeros(1 << BLOCK_BITS, np.uint8)

        def done() -> pa.RecordBatch:
            made = [pa.array([x], t) for x, t in zip((*now, np.packbits(n > 1).tobytes()), (pa.int32(), pa.int64(), pa.binary()), strict=True)]
            n[:] = 0
            return pa.RecordBatch.from_arrays(made, names=["row", "block", "bits"])

        for b in batches:
            for key, once, twice in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2), b.column(3), strict=True):
                if key != now:
                    if now is not None:
                        yield done()
                    now = key
                at = np.frombuffer(once.as_buffer(), np.uint16)
                n[at] = np.minimum(n[at] + 1, 2)
                n[np.frombuffer(twice.as_buffer(), np.uint16)] = 2
        if now is not None:
            yield done()

    tasks = sketches.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return sketches.repartition(int(tasks), "row", "block").sortWithinPartitions("row", "block").mapInArrow(run, "row int, block long, bits binary")


def repeated_cells(texts: DataFrame, window: int, bits: int) -> np.ndarray:
    """The merged bitmap: DEPTH rows of 2^bits bits."""
    out = np.zeros((DEPTH, 1 << max(0, bits - BLOCK_BITS), (1 << BLOCK_BITS) // 8), np.uint8)
    for r in merged(partition_sketches(texts, window, bits)).toLocalIterator():
        out[r["row"], r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(DEPTH, -1)


def estimated_runs(texts: DataFrame, window: int, bits: int, bitmap, hashes: bool) -> DataFrame:
    """text (k1, k2), start, n, rep, a, b and, if asked for, all windows' hashes: the runs whose representative may be repeated."""
    fields = [("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("rep", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bitmap.value
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)]
            for h, doc, place in hashed_blocks(batch.column(0), window):
                rep, first, whole, w = runs(h, doc, window)
                if not len(rep):
                    continue
                may = np.ones(len(rep), bool)
                for row in range(DEPTH):
                    at = cells(rep, row, bits)
                    may &= (seen[row][at >> _U(3)] >> (_U(7) - (at & _U(7))).astype(np.uint8) & 1).astype(bool)
                ends = np.append(first[1:], len(whole))[may]
                first = first[may]
                if not len(first):
                    continue
                n, word = ends - first, whole[first]
                signed = w.view(np.int64)
                cols = [k[doc[word]] for k in keys] + [place[word].astype(np.int32), n.astype(np.int32), rep[may].view(np.int64), signed[first], signed[ends - 1]]
                cols = [pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)]
                names = [name for name, _ in fields]
                if hashes:
                    offsets = np.concatenate([[0], np.cumsum(n)])
                    flat = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, n)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed[flat], pa.int64())))
                    names.append("windows")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "k1 long, k2 long, start int, n int, rep long, a long, b long"
    return texts.mapInArrow(run, schema + ", windows array<long>" * hashes)


def repeated_places(texts: DataFrame, window: int, bits: int) -> DataFrame:
    """k1, k2, start, n: n neighbouring windows of that text, from word ``start`` on, also start elsewhere. A place may come more than once."""
    spark = texts.sparkSession
    bitmap = spark.sparkContext.broadcast(repeated_cells(texts, window, bits))
    run = ["rep", "a", "b"]
    found = estimated_runs(texts, window, bits, bitmap, hashes=True)
    kinds = cut(found.groupBy(*run).agg(F.count("*").alias("times"), *(F.any_value(c).alias(c) for c in ("k1", "k2", "start", "windows"))))
    # a run found twice: all its windows are repeated
    twice = kinds.where("times > 1").select(*run)
    whole = estimated_runs(texts, window, bits, bitmap, hashes=False).join(twice, run).select("k1", "k2", "start", "n")
    # runs that share a representative only: window by window
    shared = kinds.groupBy("rep").agg(F.count("*").alias("kinds")).where("kinds > 1").select("rep")
    single = kinds.join(shared, "rep").select("rep", "times", "k1", "k2", "start", F.posexplode("windows").alias("i", "w"))
    again = single.groupBy("rep", "w").agg(F.sum("times").alias("all")).where("all > 1").select("rep", "w")
    part = single.where("times = 1").join(again, ["rep", "w"]).select("k1", "k2", (F.col("start") + F.col("i")).alias("start"), F.lit(1).alias("n"))
    return whole.unionByName(part)


def pieces_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        end = min(at + BLOCK, len(text))
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        yield text[at:end].split()
        at = end


def without(text: bytes, places: list[tuple[int, int]], window: int) -> tuple[int, int, bytes]:
    """Number of words, of those removed, and the kept ones joined by one space. places: (start, n)."""
    spans: list[list[int]] = []
    for start, n in sorted(places):
        end = start + n + window - 1
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    at, k, kept = 0, 0, []
    for words in pieces_of(text):
        own, last, end = [], at, at + len(words)
        while k < len(spans) and spans[k][0] < end:
            own += words[last - at : max(last, spans[k][0]) - at]
            last = max(last, min(spans[k][1], end))
            if spans[k][1] > end:
                break
            k += 1
        own += words[last - at :]
        if own:
            kept.append(b" ".join(own))
        at = end
    return at, sum(b - a for a, b in spans), b" ".join(kept)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, texts_out: bool = True) -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256 and, if asked for, kept (the kept words joined by one space), one row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    text = text_or_empty(text_col)
    own = docs.select(text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(window), text).alias("k2"), F.col(id_col).alias("id"))
    if bits is None:
        size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, ceil(log2(max(1, size * ROOM / BYTES_EACH)))))
    places = repeated_places(own.select("text", "k1", "k2"), window, bits)
    once = places.groupBy("k1", "k2", "start").agg(F.max("n").alias("n"))
    marks = once.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, p in zip(pc.cast(b.column(0), pa.large_binary()), b.column(1), strict=True):
                at = [] if not p.is_valid else list(zip(*(p.values.field(i).to_pylist() for i in (0, 1)), strict=True))
                n, gone, kept = without(t.as_py(), at, window)
                rows.append((n, gone, hashlib.sha256(kept).hexdigest(), kept))
            n, gone, digest, kept = zip(*rows, strict=True) if rows else ((),) * 4
            cols = [b.column(2), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if texts_out:
                cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    joined = own.join(marks, ["k1", "k2"], "left").select("text", "places", "id")
    schema = f"id {kind.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts_out
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)

"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Adjacent symbol pairs stand in an agenda ordered by the score of the piece they make, then by place; the
head is merged until no pair makes a piece. ``agenda`` is the heap for one sequence of any length;
``agendas`` runs the agendas of many short words side by side in numpy. A text is cut into words where the
vocabulary proves that merges can't cross (no piece holds the two characters side by side), so a word is encoded once and
its ids are kept as bytes (two generations of at most ``KEPT`` words).

Checks against the sentencepiece library, in every Arrow batch: with check="documents" (what the queries use) the library encodes
each whole text; with check="words" only the words that were encoded in the batch, joined by line ends. A difference is an
error. A model whose vocabulary doesn't keep line ends apart is always checked by documents. Decoding is the library's.

Defined cases: a null or empty text gives the end id alone and decodes to an empty text; null ids and repeated
rows pass through; an empty table gives an empty result; further columns are ignored unless asked for. A vocabulary may have up to
2^21 symbols. Refused with an error: models of another type than BPE, with a normalisation table, with user-defined or unused pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, text_or_empty

SPACE = "▁"
KEPT = 200_000
LONG = 48
SYMBOL_BITS = 21
GROUP = 16_384
PAD = -(1 << 21)


class Words(dict):
    """Ids of words, as bytes. A word that isn't there gets a bytearray, to be filled in place before the batch ends."""

    def __init__(self, old: dict):
        super().__init__()
        self.old, self.new = old, {}

    def __missing__(self, word: str) -> bytes | bytearray:
        ids = self.old.get(word)
        if ids is None:
            return self.new.setdefault(word, bytearray())
        self[word] = ids
        return ids

    def settle(self) -> None:
        """What is new is filled by now."""
        self.update((w, bytes(ids)) for w, ids in self.new.items())
        self.new = {}


class PairTable:
    """Pairs of symbols to rank << bits | symbol made, by open addressing; looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, made: np.ndarray, none: np.integer):
        self.bits, self.none = max(4, int(len(keys) * 4).bit_length()), none
        self.keys, self.made = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, none, dtype=none.dtype)
        for k, m, at in zip(keys.tolist(), made.tolist(), self.place(keys).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.made[at] = k, m

    def place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << SYMBOL_BITS) | b
        keys[(a < 0) | (b < 0)] = 1 << 2 * SYMBOL_BITS + 1  # symbols outside the vocabulary make no pair
        at = self.place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.made[at], self.none)
        left = np.nonzero((found != keys) & (found >= 0))[0]
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.made[at[left[hit]]]
            left = left[(found >= 0) & ~hit]
        return out


class PieceModel:
    """Tables of a model file: symbols (pieces, and the characters of pieces), pairs with what they make."""

    def __init__(self, data: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with identity normalisation is expected")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.prefix, self.eos = norm.add_dummy_prefix, self.library.eos_id()
        normal = {p.piece: (p.score, i) for i, p in enumerate(proto.pieces) if p.type == 1}
        names = list(dict.fromkeys([*normal, *(c for p in normal for c in p)]))
        self.sid = {p: i for i, p in enumerate(names)}
        fallback = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if trainer.byte_fallback else None
        self.fallback, self.unk = fallback, self.library.unk_id()
        self.out = [(normal[p][1],) if p in normal else self._bytes(p) for p in names]
        rank = {s: r for r, s in enumerate(sorted({s for s, _ in normal.values()}, reverse=True))}
        pairs = {(self.sid[p[:k]], self.sid[p[k:]]): (rank[s], self.sid[p]) for p, (s, _) in normal.items() for k in range(1, len(p)) if p[:k] in self.sid and p[k:] in self.sid}
        self.pairs = pairs
        if len(names) >= 1 << SYMBOL_BITS:
            raise ValueError(f"at most {1 << SYMBOL_BITS} symbols are supported")
        self.bits = len(names).bit_length()  # of the symbol in a rank << bits | symbol
        self.none = np.int32((1 << 31) - 1) if len(rank) << self.bits < (1 << 31) - 1 else np.int64((1 << 62) - 1)
        self.table = PairTable(np.array([a << SYMBOL_BITS | b for a, b in pairs], dtype=np.int64), np.array([r << self.bits | s for r, s in pairs.values()], dtype=np.int64), self.none)
        # merges can't cross between characters that no piece holds side by side: words end before a space mark that follows
        # another character, around newlines, and where letters and other marks meet, as far as the vocabulary bears it out
        beside = {(a, b) for p in normal for a, b in zip(p, p[1:])}  # noqa: B905
        self.apart = all(a == SPACE or b != SPACE for a, b in beside)
        line = "\n" * all("\n" not in ab for ab in beside)
        marks = {c for p in normal for c in p if not c.isalnum() and c not in (SPACE, "\n")}
        if any((a in marks) != (b in marks) and a != SPACE for a, b in beside):
            marks = set()
        m, other = "".join(re.escape(c) for c in sorted(marks)), f"{SPACE}{line}"
        self.words = re.compile("|".join([*([line] if line else []), f"{SPACE}*[^{other}{m}]+", *([f"{SPACE}*[{m}]+"] if m else []), f"{SPACE}+"]))
        self.one = np.array([i[0] if len(i) == 1 else -1 for i in self.out], dtype=np.int32)
        self.codes = -1 - np.arange(0x110000, dtype=np.int32)
        for name, i in self.sid.items():
            if len(name) == 1:
                self.codes[ord(name)] = i
        self.number = [str(i) for i in range(len(proto.pieces))]
        self.kept = Words({})
        self.end = np.int32(self.eos).tobytes()
        self.line, self.line_ids = line, self.agenda("\n") if line else ()

    def _bytes(self, char: str) -> tuple[int, ...]:
        return tuple(self.fallback[b] for b in char.encode()) if self.fallback else (self.unk,)

    def symbols(self, word: str) -> list[int]:
        """A character outside the table is -1 - its code point: no pair holds it."""
        return [self.sid.get(c, -1 - ord(c)) for c in word]

    def ids(self, symbols) -> tuple[int, ...]:
        return tuple(chain.from_iterable(self.out[s] if s >= 0 else self._bytes(chr(-1 - s)) for s in symbols))

    def agenda(self, word: str) -> tuple[int, ...]:
        """One sequence: a heap of (rank, place), symbols as a linked list."""
        s = self.symbols(word)
        n = len(s)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def propose(a: int, b: int) -> None:
            if a >= 0 and b < n and (m := self.pairs.get((s[a], s[b]))):
                heapq.heappush(heap, (m[0], a, b, s[a], s[b], m[1]))

        for i in range(n - 1):
            propose(i, i + 1)
        while heap:
            _, a, b, x, y, made = heapq.heappop(heap)
            if s[a] != x or s[b] != y or after[a] != b:
                continue  # one of the two has been merged since
            s[a], s[b] = made, None
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            propose(before[a], a)
            propose(a, after[a])
        return self.ids(x for x in s if x is not None)

    def agendas(self, words: list[str]) -> list[bytes]:
        """Many words of at most LONG characters, their ids as bytes: in each round every word merges the head of its agenda.

        pair[i, j] is what symbol j makes with the one after it; symbols that were merged into the one before are PAD.
        """
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        size = int(sizes.max())
        s = np.full((len(words), size + 2), PAD, dtype=np.int32)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        s[:, :size][np.arange(size) < sizes[:, None]] = self.codes[codes]
        pair = np.full((len(words), size + 1), self.none, dtype=self.none.dtype)
        real = s[:, 1:size] != PAD
        at = np.nonzero(real)
        pair[at] = self.table.get(s[at], s[at[0], at[1] + 1])
        after = np.broadcast_to(np.arange(1, size + 3, dtype=np.int32), s.shape).copy()
        before = np.broadcast_to(np.arange(-1, size + 1, dtype=np.int32), s.shape).copy()
        live = np.arange(len(words))
        while len(live):
            rows = pair[live]
            head = rows.argmin(axis=1)  # the smallest rank; of equal ranks (which make one symbol) the first place
            best = rows[np.arange(len(live)), head]
            open_ = best < self.none
            live, head, best = live[open_], head[open_], best[open_]
            nxt = after[live, head]
            far = after[live, nxt]
            made = (best & ((1 << self.bits) - 1)).astype(np.int32)
            s[live, head], s[live, nxt] = made, PAD
            after[live, head], before[live, far] = far, head
            pair[live, nxt] = self.none
            pair[live, head] = self.table.get(made, s[live, far])
            back = before[live, head]
            some = back >= 0
            pair[live[some], back[some]] = self.table.get(s[live[some], back[some]], made[some])
        real = s != PAD
        ends = np.cumsum(real.sum(axis=1)).tolist()
        flat = s[real]
        ids = np.where(flat >= 0, self.one[np.maximum(flat, 0)], -1)  # -1: the character takes several ids
        several = np.zeros(len(s), dtype=bool)
        several[np.nonzero(real)[0][ids < 0]] = True
        raw, flat = ids.astype(np.int32).tobytes(), flat.tolist()
        return [np.array(self.ids(flat[b:e]), np.int32).tobytes() if more else raw[4 * b : 4 * e] for b, e, more in zip([0, *ends], ends, several.tolist())]  # noqa: B905

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        text = SPACE + text if self.prefix else text
        return self.words.findall(text) if self.apart else [text]

    def learn(self, new: dict[str, bytearray]) -> None:
        """Fill in the ids of new words."""
        short = sorted((w for w in new if len(w) <= LONG), key=len)
        for w in new:
            if len(w) > LONG:
                new[w] += np.array(self.agenda(w), np.int32).tobytes()
        for i in range(0, len(short), GROUP):
            part = short[i : i + GROUP]
            for w, ids in zip(part, self.agendas(part), strict=True):
                new[w] += ids

    def agree(self, new: dict[str, bytearray]) -> None:
        """The library must encode the words alike; line ends keep them apart."""
        words = list(new)
        line, first = np.array(self.line_ids, np.int32).tobytes(), np.array(self.agenda(SPACE) if self.prefix else (), np.int32).tobytes()
        for i in range(0, len(words), 256):
            part = words[i : i + 256]
            theirs = array("i", self.library.encode("\n" + "\n".join(part).replace(SPACE, " "), num_threads=1)).tobytes()
            if first + b"".join(line + new[w] for w in part) != theirs:
                bad = next((w for w in part if array("i", self.library.encode("\n" + w.replace(SPACE, " "))).tobytes() != first + line + new[w]), "a word")
                raise AssertionError(f"the library encodes {bad[:200]!r} otherwise")

    def encode(self, texts: list[str], check: str = "words") -> list[bytes]:
        """Per text its ids with the end id, as bytes of 32-bit numbers."""
        rows = [list(map(self.kept.__getitem__, self.split(t))) for t in texts]
        whole = check == "documents" or not (self.apart and self.line)
        if self.kept.new:
            self.learn(self.kept.new)
            if not whole:  # whole documents hold the words too
                self.agree(self.kept.new)
            self.kept.settle()
        out = [b"".join([*r, self.end]) for r in rows]
        if len(self.kept) > KEPT:
            self.kept.old = {}  # the generation before the last
            self.kept = Words(self.kept)
        if whole:
            for t, ids, theirs in zip(texts, out, self.library.encode(texts, add_eos=True, num_threads=1), strict=True):
                if ids != array("i", theirs).tobytes():
                    raise AssertionError(f"the library encodes {t[:200]!r} otherwise")
        return out


@lru_cache(maxsize=2)
def _model(data: bytes) -> PieceModel:
    return PieceModel(data)


COLUMNS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
TYPES = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(docs: DataFrame, model_path: str, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"), keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", check: str = "words") -> DataFrame:
    """docs' columns ``keep`` and, of COLUMNS, those asked for; digests are taken where the ids are."""
    with open(model_path, "rb") as f:
        data = f.read()
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(*keep, text_or_empty(text_col).alias("__text"))
    want = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data)
        for b in batches:
            coded = model.encode(b.column(len(keep)).to_pylist(), check)
            sizes = [len(i) // 4 for i in coded]
            made: dict[str, list] = {c: [] for c in want if c not in ("n_tokens", "ids")}
            for raw in coded if made else ():
                ids = array("i", raw).tolist()
                if "ids_sha256" in made:
                    made["ids_sha256"].append(_sha(" ".join(map(model.number.__getitem__, ids))))
                if "decoded" in made or "decoded_sha256" in made:
                    back = model.library.decode(ids)
                    for c, v in (("decoded", back), ("decoded_sha256", _sha(back))):
                        if c in made:
                            made[c].append(v)
            cols = {c: pa.array(v, COLUMNS[c]) for c, v in made.items()}
            cols["n_tokens"] = pa.array(sizes, pa.int64())
            if "ids" in want:
                ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(cols[c] for c in want)], names=[*keep, *want])

    kinds = dict(src.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"{c} {TYPES[c]}" for c in want)])
    return src.mapInArrow(run, schema)


def decode_documents(rows: DataFrame, model_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The texts of rows' ids; null ids give an empty text."""
    with open(model_path, "rb") as f:
        data = f.read()
    src = rows.select(*keep, F.coalesce(ids_col, F.array().cast("array<int>")).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data)
        for b in batches:
            back = [model.library.decode(i) for i in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(back, pa.string())], names=[*keep, "decoded"])

    kinds = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "decoded string"]))

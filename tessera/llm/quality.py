"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of ``CHUNK`` bytes that cover it whole, the last one ending where the text
ends. Learned filters run over each chunk's bytes and are max-pooled there; the largest, smallest and mean of
a text's chunks are combined into one probability by a small dense layer. As no linear filter sees that
bytes repeat, a chunk has further inputs: for halves of it, the largest share of bytes equal to the byte some 2
to ``LAGS`` places before, and how often on average bytes recur so.

It is trained on the driver on a bounded sample of labelled rows: at most ``TRAIN_DOCS`` texts, those with the
smallest MD5 of their id, whole, none over ``TRAIN_LONGEST`` bytes and at most ``TRAIN_BYTES`` together. Rows with
crc32(id as text) mod 4 = 2 are held out. Only bytes of the text are inputs.

Defined cases: a null text is empty; an empty text is one chunk of padding and gets a score; null ids are never
trained on and count as not held out; null labels are left out; of repeated labels the smallest counts; repeated rows get equal scores; without
any labelled row every score is 0.5; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, text_or_empty

CHUNK, HOP, WIDTH, STRIDE = 256, 192, 16, 8
EMBED, FILTERS, HIDDEN = 8, 32, 16
SLAB = 1024
THRESHOLD = 0.7
TRAIN_DOCS, TRAIN_BYTES, TRAIN_LONGEST = 2400, 12_000_000, 1_000_000
STEPS, BATCH, RATE = 600, 32, 0.004
LAGS, ECHO = 40, 3
POOLED = FILTERS + ECHO
OFFSETS = range(0, CHUNK - WIDTH + 1, STRIDE)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def chunks(text: bytes) -> np.ndarray:
    """[n, CHUNK] bytes; zeros fill up a text shorter than a chunk."""
    raw = np.frombuffer(text, dtype=np.uint8)
    if len(raw) <= CHUNK:
        return np.pad(raw, (0, CHUNK - len(raw)))[None, :]
    starts = np.unique(np.r_[np.arange(0, len(raw) - CHUNK, HOP), len(raw) - CHUNK])
    return np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[starts]


def windows(embedded: np.ndarray) -> np.ndarray:
    """[n, CHUNK, EMBED] to [n, windows, WIDTH * EMBED]."""
    n, (a, b, c) = len(embedded), embedded.strides
    view = np.lib.stride_tricks.as_strided(embedded, (n, len(OFFSETS), WIDTH * EMBED), (a, b * STRIDE, c))
    return np.ascontiguousarray(view)


def echoes(x: np.ndarray) -> np.ndarray:
    """[n, CHUNK] bytes to [n, ECHO]."""
    half = CHUNK // 2
    best = np.zeros((2, len(x)), np.float32)
    some = np.zeros((len(x), CHUNK - LAGS), bool)
    real = x[:, LAGS:] != 0
    for lag in range(2, LAGS + 1):
        same = (x[:, LAGS:] == x[:, LAGS - lag : CHUNK - lag]) & real
        best[0] = np.maximum(best[0], same[:, :half].mean(axis=1, dtype=np.float32))
        best[1] = np.maximum(best[1], same[:, -half:].mean(axis=1, dtype=np.float32))
        three = same[:, 2:] & same[:, 1:-1] & same[:, :-2]  # three bytes in a row
        some[:, 2:] |= three
    return np.stack([best.max(0), best.min(0), some.mean(axis=1, dtype=np.float32)], axis=1) * 4


class ByteNet:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {
            "emb": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "conv": draw(WIDTH * EMBED, FILTERS), "cb": np.zeros(FILTERS, np.float32),
            "w1": draw(3 * POOLED, HIDDEN), "b1": np.zeros(HIDDEN, np.float32),
            "w2": draw(HIDDEN, 1)[:, 0], "b2": np.zeros(1, np.float32),
        }

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """[n, CHUNK] bytes to [n, POOLED]: each filter's largest response in each chunk, and its echoes."""
        out, echo = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), ECHO), np.float32)
        for i in range(0, len(x), SLAB):
            z = windows(self.p["emb"][x[i : i + SLAB]]).reshape(-1, WIDTH * EMBED) @ self.p["conv"]
            out[i : i + SLAB] = z.reshape(-1, len(OFFSETS), FILTERS).max(axis=1)
            echo[i : i + SLAB] = echoes(x[i : i + SLAB])
        return np.hstack([np.maximum(out + self.p["cb"], 0), echo])

    def head(self, doc: np.ndarray) -> np.ndarray:
        h = np.maximum(doc @ self.p["w1"] + self.p["b1"], 0)
        return 1 / (1 + np.exp(-np.clip(h @ self.p["w2"] + self.p["b2"], -30, 30)))

    def score(self, texts: list[str]) -> np.ndarray:
        """Chunks of many texts go through the filters together; a long text goes in slabs."""
        out, waiting, size = [], [], 0
        for t in texts:
            waiting.append(chunks((t or "").encode()))
            size += len(waiting[-1])
            if size >= SLAB:
                out.append(self._scored(waiting))
                waiting, size = [], 0
        if waiting:
            out.append(self._scored(waiting))
        return np.concatenate(out) if out else np.empty(0)

    def _scored(self, parts: list[np.ndarray]) -> np.ndarray:
        pool = self.pooled(np.concatenate(parts))
        n = np.array([len(p) for p in parts])
        at = np.r_[0, np.cumsum(n)[:-1]]
        doc = np.hstack([np.maximum.reduceat(pool, at), np.minimum.reduceat(pool, at), np.add.reduceat(pool, at) / n[:, None].astype(np.float32)])
        return self.head(doc).astype(float)

    def gradients(self, parts: list[np.ndarray], echo: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.array([len(x) for x in parts])
        x = np.concatenate(parts)
        win = windows(p["emb"][x])
        z = win @ p["conv"]
        best = z.argmax(axis=1)
        pre = np.take_along_axis(z, best[:, None, :], 1)[:, 0] + p["cb"]
        pool = np.hstack([np.maximum(pre, 0), echo])
        at = np.r_[0, np.cumsum(n)[:-1]]
        spans = [slice(a, a + k) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
        top, low = np.array([pool[s].argmax(0) for s in spans]) + at[:, None], np.array([pool[s].argmin(0) for s in spans]) + at[:, None]
        f = np.arange(POOLED)
        doc = np.hstack([pool[top, f], pool[low, f], np.add.reduceat(pool, at) / n[:, None].astype(np.float32)])
        h0 = doc @ p["w1"] + p["b1"]
        h = np.maximum(h0, 0)
        prob = 1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30)))
        d = ((prob - y) / len(y)).astype(np.float32)
        g = {"w2": h.T @ d, "b2": d.sum(keepdims=True)}
        dh = np.outer(d, p["w2"]) * (h0 > 0)
        g |= {"w1": doc.T @ dh, "b1": dh.sum(0)}
        dd = dh @ p["w1"].T
        dpool = np.repeat(dd[:, 2 * POOLED :] / n[:, None].astype(np.float32), n, axis=0)
        np.add.at(dpool, (top, f), dd[:, :POOLED])
        np.add.at(dpool, (low, f), dd[:, POOLED : 2 * POOLED])
        dpool = dpool[:, :FILTERS] * (pre > 0)
        g["cb"] = dpool.sum(0)
        conv, emb = np.zeros_like(p["conv"]), np.zeros_like(p["emb"])
        rows = np.arange(len(x))
        for k in range(FILTERS):  # only the window that won gets a filter's gradient
            live = dpool[:, k] != 0
            dk, wk = dpool[live, k], best[live, k]
            conv[:, k] = win[rows[live], wk].T @ dk
            where = x[rows[live, None], (wk * STRIDE)[:, None] + np.arange(WIDTH)]
            for e in range(EMBED):
                emb[:, e] += np.bincount(where.ravel(), (dk[:, None] * p["conv"][e::EMBED, k]).ravel(), 256)
        return g | {"conv": conv, "emb": emb}

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 5) -> ByteNet:
        r, m, v = np.random.default_rng(seed), {}, {}
        parts = [chunks(t) for t in texts]
        echo = [echoes(x) for x in parts]
        for step in range(1, STEPS + 1):
            at = r.choice(len(parts), min(BATCH, len(parts)), replace=False)
            g = self.gradients([parts[i] for i in at], np.concatenate([echo[i] for i in at]), labels[at].astype(np.float32))
            rate = RATE * (1 - step / (STEPS + 1))
            for k, x in g.items():
                m[k], v[k] = 0.9 * m.get(k, 0) + 0.1 * x, 0.99 * v.get(k, 0) + 0.01 * x * x
                self.p[k] -= (rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteNet | None:
    """None if no row is labelled."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y")).withColumn("h", F.md5(F.col("id").cast("string")))
    sample = F.broadcast(known.orderBy("h", "id").limit(TRAIN_DOCS))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(sample, "id").where(F.octet_length("text") <= TRAIN_LONGEST)
    texts, ys, size = [], [], 0
    for r in rows.orderBy("h", "text").toLocalIterator():  # at most TRAIN_DOCS labelled ids
        raw = r["text"].encode()
        if size + len(raw) > TRAIN_BYTES:
            break
        size += len(raw)
        texts.append(raw)
        ys.append(int(r["y"] == 1))
    return ByteNet().fit(texts, np.array(ys)) if texts else None


def score(docs: DataFrame, model: ByteNet | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs' columns ``keep`` and out_col, the probability that the label is 1."""
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias(out_col))
    src = docs.select(*keep, text_or_empty(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = model.score(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(out, pa.float64())], names=[*keep, out_col])

    small_batches(docs.sparkSession)
    kinds = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), f"`{out_col}` double"]))

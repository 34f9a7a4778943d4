"""Approximate nearest neighbours by NN-descent: a neighbour graph is built through iterative joins of neighbours
of neighbours, and queries search it greedily.

Nearness is the inner product. Vectors are scaled into the unit ball and get one more component, sqrt(1 - |x|^2), so that order
by inner product is order by distance and a neighbour graph can be walked. That holds in few digits only where norms are alike, so vectors
lie in bands, each of a factor of 2^BAND_BITS of norms: a band has its own scale and graph, is searched by itself, and
what bands give is put together by exact scores. A band of at most ``PIVOTS`` vectors has no graph; each query looks at all of them.
Graph and search work on 16-bit copies; the result is scored again on the original vectors in double precision.

Equal vectors are one node of the graph (with the smallest ids of as many copies as a result can hold), so a
vector that fills a third of the table costs no more than another. Nodes and queries have keys of their own, as an id may come with several vectors.

First neighbours come from leaves of random projections (signs of log2(n / LEAF) of them; larger leaves are
split by a hash). A round joins, at every node, a sample of its new and old neighbours and of those that have it as one;
pairs of them that are nearer than a node's worst neighbour replace it. Nodes without a new member send no vectors. Rounds end when few
change.

A search keeps the best ``beam`` nodes of each query, begins at the query's own node if it has one and at the nearest of
``PIVOTS`` fixed nodes, and expands the best unexpanded ones, all queries at a time, until none is left in its first 3 k.

Defined cases: null vectors, those with a null or non-finite component, of norm zero, or of another length than the longest
take no part, nor do null ids; a norm may be as large as doubles go; equal rows count once; an id with several vectors counts with the
best score of them, on either side; ties go to the smaller id; with fewer candidates than k
all that are found are returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, ship

DEGREE = 60
SAMPLE = 20
TREES = 4
LEAF = 192
ROUNDS = 12
SETTLED = 0.005
PIVOTS = 256
BAND_BITS = 2
EDGE = "node long, near long, sim float"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, x (array<double>): the vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(
        "id IS NOT NULL AND x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity')) AND exists(x, c -> c <> 0)"
    )
    return rows.dropDuplicates(["id", "x"])


def _floats(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def halves(column: pa.Array) -> np.ndarray:
    """A binary column of 16-bit vectors as 32-bit rows."""
    n = len(column)
    if not n:
        return np.empty((0, 1), dtype=np.float32)
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float16)
    return raw.reshape(n, -1).astype(np.float32)


def log_norm(x: str = "x") -> Column:
    """log2 of the norm, also where the norm itself is no double."""
    most = F.aggregate(x, F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c)))
    return F.log2(most) + F.log2(F.aggregate(x, F.lit(0.0), lambda a, c: a + (c / most) * (c / most))) / 2


def copies(rows: DataFrame, d: int, scale: int) -> DataFrame:
    """rows with v: the 16-bit copy of x, which is of a norm of at most 2^scale."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ldexp(_floats(b.column(1), d), -scale)
            v = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in v], pa.binary())], names=["node", "v"])

    return rows.select("node", "x").mapInArrow(run, "node long, v binary")


def runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys out of a sorted stream, with the runs' first rows."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        k = t.column(key).to_numpy()
        last = int(np.searchsorted(k, k[-1]))
        rest = t.slice(last)
        if last:
            yield t.slice(0, last).combine_chunks(), np.r_[0, np.nonzero(np.diff(k[:last]))[0] + 1]
    if rest is not None and rest.num_rows:
        k = rest.column(key).to_numpy()
        yield rest.combine_chunks(), np.r_[0, np.nonzero(np.diff(k))[0] + 1]


def best_of(node: np.ndarray, near: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct neighbours of every node."""
    at = np.lexsort((near, -sim, node))
    node, near, sim = node[at], near[at], sim[at]
    new = np.r_[True, (node[1:] != node[:-1]) | (near[1:] != near[:-1])]
    node, near, sim = node[new], near[new], sim[new]
    first = np.r_[True, node[1:] != node[:-1]]
    rank = np.arange(len(node)) - np.maximum.accumulate(np.where(first, np.arange(len(node)), 0))
    ok = rank < k
    return node[ok], near[ok], sim[ok]


def _edges(node, near, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(near, pa.int64()), pa.array(sim, pa.float32())], names=["node", "near", "sim"])


def _n(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def leaves(nodes: DataFrame, n: int, d: int, k: int, seed: int) -> DataFrame:
    """First neighbours: the k best within each leaf of each tree."""
    bits = max(0, ceil(log2(max(1, n / LEAF))))
    planes = np.random.default_rng(seed).normal(size=(TREES, d + 1, max(1, bits))).astype(np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = halves(b.column(1))
            if not len(v):
                continue
            for t in range(TREES):
                code = ((v @ planes[t] > 0) @ (1 << np.arange(planes.shape[2]))) if bits else np.zeros(len(v), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64) * TREES + t), b.column(0), b.column(1)], names=["leaf", "node", "v"])

    placed = nodes.mapInArrow(place, "leaf long, node long, v binary")
    sizes = placed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / (2 * LEAF)).alias("parts"))
    placed = placed.join(sizes, "leaf").withColumn("leaf", F.xxhash64("leaf", F.pmod(F.xxhash64("node"), F.col("parts")))).select("leaf", "node", "v")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in runs(batches):
            node, v = t.column(1).to_numpy(), halves(t.column(2).combine_chunks())
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
                if b - a < 2:
                    continue
                s = v[a:b] @ v[a:b].T
                np.fill_diagonal(s, -np.inf)
                m = min(k, b - a - 1)
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                out.append((np.repeat(node[a:b], m), node[a:b][top].ravel(), np.take_along_axis(s, top, 1).ravel()))
            if out:
                yield _edges(*best_of(*(np.concatenate(c) for c in zip(*out, strict=True)), k))

    return placed.repartition(_n(nodes.sparkSession), "leaf").sortWithinPartitions("leaf").mapInArrow(link, EDGE)


def merged(edges: DataFrame, k: int) -> DataFrame:
    """node, near, sim, fresh (not there before), worst: the k best of edges, which have a column old."""
    each = edges.groupBy("node", "near").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    w = Window.partitionBy("node")
    return (
        each.withColumn("rank", F.row_number().over(w.orderBy(F.desc("sim"), "near"))).where(F.col("rank") <= k)
        .withColumn("worst", F.when(F.count("*").over(w) < k, F.lit(-1e9)).otherwise(F.min("sim").over(w)).cast("float"))
        .select("node", "near", "sim", (F.col("old") == 0).alias("fresh"), "worst")
    )


def descend(graph: DataFrame, nodes: DataFrame, k: int, salt: int) -> DataFrame:
    """Pairs that meet at a node and are nearer than the worst neighbour of one of them: node, near, sim."""
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("node", "near", F.lit(salt))))
    ahead = graph.withColumn("r", order("node", "fresh")).where(F.col("r") <= SAMPLE).select(F.col("node").alias("centre"), F.col("near").alias("member"), "fresh")
    behind = graph.withColumn("r", order("near", "fresh")).where(F.col("r") <= SAMPLE).select(F.col("near").alias("centre"), F.col("node").alias("member"), "fresh")
    met = ahead.unionByName(behind).groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
    met = met.withColumn("any", F.max("fresh").over(Window.partitionBy("centre"))).where("any").drop("any")
    worst = graph.groupBy("node").agg(F.min("worst").alias("worst"))
    full = nodes.join(worst, "node", "left").select(F.col("node").alias("member"), "v", F.coalesce("worst", F.lit(-1e9).cast("float")).alias("worst"))
    rows = met.join(full, "member").select("centre", "member", "fresh", "worst", "v")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for t, starts in runs(batches):
            member, fresh, worst = t.column(1).to_numpy(), t.column(2).to_numpy(zero_copy_only=False), t.column(3).to_numpy()
            v = halves(t.column(4).combine_chunks())
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(member)], strict=True):
                if b - a < 2 or not fresh[a:b].any():
                    continue
                s = v[a:b] @ v[a:b].T
                ok = (s > worst[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b])
                np.fill_diagonal(ok, False)
                i, j = np.nonzero(ok)
                if len(i):
                    kept.append((member[a:b][i], member[a:b][j], s[i, j]))
                    size += len(i)
            if size > 1 << 20:
                yield _edges(*best_of(*(np.concatenate(c) for c in zip(*kept, strict=True)), k))
                kept, size = [], 0
        if kept:
            yield _edges(*best_of(*(np.concatenate(c) for c in zip(*kept, strict=True)), k))

    return rows.repartition(_n(graph.sparkSession), "centre").sortWithinPartitions("centre").mapInArrow(pairs, EDGE)


def neighbour_graph(nodes: DataFrame, n: int, d: int, k: int = DEGREE, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """node, near, sim over nodes (node, v)."""
    graph = cut(merged(leaves(nodes, n, d, k, seed).withColumn("old", F.lit(0)), k))
    for i in range(rounds):
        more = descend(graph, nodes, k, i).withColumn("old", F.lit(0))
        graph = cut(merged(graph.select("node", "near", "sim", F.lit(1).alias("old")).unionByName(more), k))
        if graph.where("fresh").count() <= SETTLED * k * n:
            break
    else:
        warnings.warn(f"the neighbour graph of {n} vectors hadn't settled after {rounds} rounds", stacklevel=2)
    return graph.select("node", "near", "sim")


def walk(graph: DataFrame, nodes: DataFrame, starts: DataFrame, asked: DataFrame, k: int, beam: int, rounds: int = 500, width: int = 12) -> DataFrame:
    """query, node of the best nodes found. asked: query, q (16-bit copies); starts: query, node. Too few rounds are an error."""
    links = cut(graph.select("node", "near").unionByName(graph.select(F.col("near").alias("node"), F.col("node").alias("near"))
        .withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("near")))).where(F.col("r") <= DEGREE).drop("r")).distinct())

    def near(found: DataFrame) -> DataFrame:
        """query, node with their similarity."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sim = np.einsum("ij,ij->i", halves(b.column(2)), halves(b.column(3)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim, pa.float32())], names=["query", "node", "sim"])

        return found.join(nodes, "node").join(asked, "query").select("query", "node", "v", "q").mapInArrow(run, "query long, node long, sim float")

    best = Window.partitionBy("query").orderBy(F.desc("sim"), "node")

    def top(df: DataFrame) -> DataFrame:
        """The best rows, and which of them are expanded now: one pass over one order, so a round is one plan with one cut for the driver to hold."""
        kept = df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= beam)
        turn = F.sum((~F.col("done")).cast("int")).over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return kept.withColumn("now", ~F.col("done") & (turn <= width) & (F.col("rank") <= 3 * k)).select("query", "node", "sim", "done", "now")

    state = cut(top(near(starts.distinct()).withColumn("done", F.lit(False))))
    for _ in range(rounds):
        open_ = state.where("now").select("query", "node")
        if open_.isEmpty():
            break
        more = open_.join(links, "node").select("query", F.col("near").alias("node")).distinct().join(state.select("query", "node"), ["query", "node"], "left_anti")
        known = state.select("query", "node", "sim", (F.col("done") | F.col("now")).alias("done"))
        state = cut(top(known.unionByName(near(more).withColumn("done", F.lit(False)))))
    else:
        raise RuntimeError("the search didn't settle")
    return state.select("query", "node")


def bands(rows: DataFrame) -> tuple[float, dict[int, int]]:
    """The largest log2 of a norm, and how many vectors each band holds (at most some thousand bands, as doubles go)."""
    top = rows.agg(F.max("log_norm")).first()[0]
    return top, {r["band"]: r["n"] for r in rows.groupBy(band_of(top).alias("band")).agg(F.count("*").alias("n")).collect()}


def band_of(top: float) -> Column:
    return F.floor((F.lit(top) - F.col("log_norm")) / BAND_BITS).cast("int")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per query its k nearest among vectors, its own id left out: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    rows, ask = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    d = rows.agg(F.max(F.size("x"))).first()[0]
    if d is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("x") == d)
    ask = cut(ask.where(F.size("x") == d).select("id", "x", F.monotonically_increasing_id().alias("query")))
    # equal vectors: the k + 1 smallest ids stand for all of them (a query may be one)
    few = cut(rows.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("r") <= k + 1))
    heads = cut(few.where("r = 1").select(F.monotonically_increasing_id().alias("node"), "x", log_norm().alias("log_norm")))
    members = few.join(heads.select("node", "x"), "x").select("node", F.col("id").alias("member"))
    asked = cut(copies_of_queries(ask, d))
    top, sizes = bands(heads)
    found = None
    for band, n in sorted(sizes.items()):
        inside = heads.where(band_of(top) == band)
        got = _searched(inside, n, ask, asked, d, ceil(top - band * BAND_BITS), k, beam)
        found = got if found is None else found.unionByName(got)
    # exact scores on the original vectors, one for each distinct vector
    exact = F.aggregate(F.zip_with("x", "q", lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c)
    scored = found.join(heads, "node").join(ask.select("query", F.col("id").alias("query_id"), F.col("x").alias("q")), "query").select("query_id", "node", exact.alias("score"))
    best = scored.join(members, "node").where("member <> query_id").groupBy("query_id", "member").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "member")
    return (
        best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("member").alias("vec_id"), "score")
    )


def _searched(heads: DataFrame, n: int, ask: DataFrame, asked: DataFrame, d: int, scale: int, k: int, beam: int) -> DataFrame:
    """query, node: the best that are found in one band (heads: node, x)."""
    if n <= PIVOTS:
        ids = [r["node"] for r in heads.select("node").collect()]
        return asked.select("query", F.explode(F.array(*[F.lit(i) for i in ids])).alias("node"))
    nodes = cut(copies(heads, d, scale))
    graph = neighbour_graph(nodes, n, d)
    pivots = nodes.orderBy(F.xxhash64("node")).limit(PIVOTS).collect()
    ids, table = np.array([p["node"] for p in pivots]), np.stack([np.frombuffer(p["v"], np.float16) for p in pivots]).astype(np.float32)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = halves(b.column(1))
            if not len(q):
                continue
            at = np.argsort(-(q @ table.T), axis=1, kind="stable")[:, :8]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), at.shape[1])), pa.array(ids[at].ravel())], names=["query", "node"])

    own = ask.join(heads, "x").select("query", "node")
    starts = asked.mapInArrow(enter, "query long, node long").unionByName(own).unionByName(own.join(graph, "node").select("query", F.col("near").alias("node")))
    return walk(graph, nodes, starts, asked, k, max(beam, 4 * k))


def copies_of_queries(ask: DataFrame, d: int) -> DataFrame:
    """query, q: a query is of norm 1 and has 0 where vectors have their further component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _floats(b.column(1), d)
            x = x / np.abs(x).max(axis=1, initial=0)[:, None]
            x = x / np.linalg.norm(x, axis=1)[:, None]
            q = np.hstack([x, np.zeros((len(x), 1))]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in q], pa.binary())], names=["query", "q"])

    return ask.select("query", "x").mapInArrow(run, "query long, q binary")

"""Related pages of a text (J2, J5, J11, FP18, G5-G6, S2-S3): seeds by name, then staged neighbours, then a cut.

A page is emitted once for each query, at the first place at which the stages reach it. Only stage (d), whose cap counts pages that no earlier
place has shown, needs the places in order. As at most ``most`` pages are shown, of each seed's and stage's list the first few pages
are enough: windows with a limit leave so many before the shuffle, and one bounded group for each query is then gone through in order. All joins
start from the seeds; no whole closure or list of a hub's inbound edges is formed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators import vocabulary as V
from tessera.operators.components import written
from tessera.operators.entities import is_current
from tessera.operators.history import histories
from tessera.session import checked_broadcast, dealt, ship

MAX_PAGES = 12
REVERSE_CAP = 5


def intents(text_col: str = "text"):
    """FP18: the relations that a text asks for."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    has = [F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws])) | F.array_contains(F.array(*[low.contains(p) for p in ps]), F.lit(True)), F.lit(r)) for r, (ws, ps) in V.INTENTS.items()]
    return F.filter(F.array(*has), lambda x: x.isNotNull())


#: Bytes on which names and texts meet: a shorter name is looked for whole, a longer one by a run of so many.
RUN = 8
#: Cells in which runs of names are counted, by hash; bits of the filter for each run, and at most (powers of two).
CELLS, FILTER_BITS, MOST_BITS, BLOCK_BITS = 1 << 20, 16, 28, 16
#: Bytes of texts that a task looks at in one go.
PIECE = 1 << 20
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _hashed(runs: np.ndarray, n, which: int, bits: int) -> np.ndarray:
    """So many bits of a hash of runs of n bytes."""
    h = (runs + np.uint64(_MIX[2]) * np.asarray(n, np.uint64)) * np.uint64(_MIX[which])
    return (((h ^ (h >> np.uint64(32))) * np.uint64(_MIX[which])) >> np.uint64(64 - bits)).astype(np.int64)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of strings as all of its bytes, with RUN zeros after them, and where each row starts (and the last ends)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)
    return np.concatenate([data, np.zeros(RUN, np.uint8)]), ends - ends[0]


def _runs(data: np.ndarray) -> np.ndarray:
    """The RUN bytes from each place on, as one number; the first n of them are its low bytes."""
    return np.ndarray((len(data) - RUN,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def _first(runs: np.ndarray, n) -> np.ndarray:
    return runs & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(RUN) - np.asarray(n, np.uint64))))


def _name_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of names: where each name's runs start among all, the length of a name's runs, and the runs."""
    data, ends = _bytes(column)
    sizes = np.diff(ends)
    many = np.maximum(sizes - RUN, 0) + 1
    starts = np.cumsum(many) - many
    at = np.repeat(ends[:-1] - starts, many) + np.arange(many.sum())
    n = np.minimum(sizes, RUN)
    return starts, n, _first(_runs(data)[at], np.repeat(n, many))


#: Characters of all names together up to which they are sent to the tasks as one automaton.
NAMES_CHARS = 4_000_000
#: The last automaton of a worker process.
_automata: dict = {}


def _by_automaton(texts: DataFrame, names: DataFrame) -> DataFrame:
    """query, name: every name in every text, found in one pass over the texts, which aren't shuffled. names: few enough (checked)."""
    spark = texts.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast([r["name"] for r in names.collect()])
    kind, key = texts.schema["query"].dataType.simpleString(), uuid.uuid4().hex

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        from tessera.operators.retrieval import _automata  # the worker's own, not a copy

        if key not in _automata:
            _automata.clear()
            made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, name in enumerate(sent.value):
                made.add_word(name, i)
            made.make_automaton()
            _automata[key] = made
        found, own = _automata[key], sent.value
        for b in batches:
            at, which = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                hits = {k for _, k in found.iter(text)}
                at += [i] * len(hits)
                which += [own[k] for k in hits]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(which, pa.string())], names=["query", "name"])

    return texts.select("query", "low").mapInArrow(find, f"query {kind}, name string")


def _by_runs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """The same for any number of names, by equality of runs of bytes. Texts are read in place, only ids and runs shuffle.

    A name of 8 bytes or more can only occur where each of its runs of 8 does, so it stands under the one that fewest names have (counted in CELLS cells, a
    matter of speed only). A filter of bounded size holds the runs under which names stand; a text's runs that pass it are joined to the names, and
    the whole name is verified in the texts of the pairs that are left. names: not empty.
    """
    spark = texts.sparkSession
    ship(spark)
    bits = CELLS.bit_length() - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for b in batches:
            starts, n, runs = _name_runs(b.column(0))
            cells += np.bincount(_hashed(runs, np.repeat(n, np.diff([*starts, len(runs)])), 0, bits), minlength=CELLS)
        some = np.nonzero(cells)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], names=["cell", "many"])

    counted = names.select("name").mapInArrow(count, "cell long, many long").groupBy("cell").agg(F.sum("many").alias("many")).toArrow()
    cells = np.zeros(CELLS, np.int64)
    cells[counted["cell"].to_numpy()] = counted["many"].to_numpy()
    seen = spark.sparkContext.broadcast(cells)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            starts, n, runs = _name_runs(b.column(0))
            own = np.repeat(np.arange(len(n)), np.diff([*starts, len(runs)]))
            best = np.lexsort((seen.value[_hashed(runs, n[own], 0, bits)], own))[starts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int8)), pa.array(runs[best].view(np.int64))], names=["name", "n", "run"])

    keys = written(names.select("name").mapInArrow(choose, "name string, n byte, run long"), "runs")
    sizes = {r["n"]: r["many"] for r in keys.groupBy("n").agg(F.count("*").alias("many")).collect()}
    wide = max(BLOCK_BITS, min(MOST_BITS, (FILTER_BITS * sum(sizes.values())).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, runs = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            both = np.concatenate([_hashed(runs, n, k, wide) for k in (0, 1)])
            yield pa.RecordBatch.from_arrays([pa.array(both >> BLOCK_BITS), pa.array(both & ((1 << BLOCK_BITS) - 1))], names=["block", "bit"])

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << BLOCK_BITS, np.uint8)
        own[rows["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": rows["block"].iloc[:1], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    blocks = keys.select("n", "run").distinct().mapInArrow(places, "block long, bit long").groupBy("block").applyInPandas(block, "block long, bits binary").toArrow()
    held = np.zeros((1 << (wide - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for i, own in zip(blocks["block"].to_pylist(), blocks["bits"].to_pylist(), strict=True):
        held[i] = np.frombuffer(own, np.uint8)
    sent, kind = spark.sparkContext.broadcast(held.ravel()), texts.schema["query"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        within = lambda runs, n, k: (held[(c := _hashed(runs, n, k, wide)) >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
        for b in batches:
            data, ends = _bytes(b.column(1))
            for at in range(0, len(data) - RUN, PIECE):
                every = _runs(data[at : at + PIECE + RUN])[:PIECE]
                for n in sizes:
                    runs = _first(every, n)
                    hit = np.nonzero(within(runs, n, 0))[0]
                    hit = hit[within(runs[hit], n, 1)]
                    row = np.searchsorted(ends, hit + at, "right") - 1
                    inside = hit + at + n <= ends[row + 1]  # not across two texts
                    met = pd.DataFrame({"row": row[inside], "run": runs[hit[inside]].view(np.int64)}).drop_duplicates()
                    if len(met):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(met["row"].to_numpy())), pa.array(np.full(len(met), n, np.int8)), pa.array(met["run"].to_numpy())], names=["query", "n", "run"])

    rows = texts.select("query", "low").mapInArrow(find, f"query {kind}, n byte, run long")
    pairs = written(rows.join(checked_broadcast(keys), ["n", "run"]).select(F.col("query").alias("of"), "name").distinct(), "pairs")
    return texts.join(checked_broadcast(pairs), F.col("query").eqNullSafe(F.col("of"))).where(F.expr("contains(low, name)")).select("query", "name")


def name_seeds(queries: DataFrame, pages: DataFrame, most: int = NAMES_CHARS) -> DataFrame:
    """Query, slug, load_ord of pages whose title or slug occurs in the text, first page of each slug.

    A containment join without a cross join: names of up to ``most`` characters in all go to the tasks as an Aho-Corasick automaton; more of them meet
    the texts on runs of bytes.
    """
    texts = queries.select("query", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    names = pages.select("slug", "load_ord", F.explode(F.array_distinct(F.array(F.lower("title"), F.lower("slug")))).alias("name")).where("name <> ''")
    # names are nearly distinct, so they are dealt out before and not aggregated in whole splits
    some = written(dealt(names.select("name"), "name", rows=2 * pages.count()).distinct(), "names")
    size = some.agg(F.sum(F.length("name") + 1)).first()[0] or 0
    if not size:
        return queries.select("query").limit(0).crossJoin(names.select("slug", "load_ord").limit(0))
    found = written(_by_automaton(texts, some) if size <= most else _by_runs(texts, some), "found")
    return names.join(checked_broadcast(found), "name").groupBy("query", "slug").agg(F.min("load_ord").alias("load_ord"))


#: Rows of one id from which it is joined apart from the others.
HOT_ID = 100_000


def selected(queries: DataFrame, pages: DataFrame, most: int, hot: int = HOT_ID) -> DataFrame:
    """Ids that a selector has returned (queries.selected, array), those there are, in its order, once each.

    Ids that more than ``hot`` rows name are few, whatever the input: their pages are broadcast, so no task gets all rows of an id. Repeats go where
    a query's rows are, in partitions of bounded size; before that nearly all keys differ, and a partial aggregation would only hold them.
    """
    ids = queries.select("query", F.posexplode("selected").alias("pos", "slug"))
    pages = pages.select("slug")
    each = ids.groupBy("slug").agg(F.count("*").alias("n"))
    seen = each.agg(F.sum("n").alias("rows"), F.collect_list(F.when(F.col("n") > hot, F.col("slug"))).alias("often")).first()
    often = seen["often"]
    rows = ids.where(~F.col("slug").isin(often)).join(pages, "slug", "left_semi") if often else ids.join(pages, "slug", "left_semi")
    if often:
        some = F.col("slug").isin(often)
        rows = rows.unionByName(ids.where(some).join(F.broadcast(pages.where(some).distinct()), "slug", "left_semi").select(rows.columns))
    w = Window.partitionBy("query").orderBy("pos")
    first = dealt(rows, "query", rows=seen["rows"] or 0).groupBy("query", "slug").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query", "slug", "rank")


def related_pages(queries: DataFrame, entities: DataFrame, e: DataFrame, most: int = MAX_PAGES, exclude: tuple[str, ...] = (), history: bool = False, cap: int = REVERSE_CAP) -> DataFrame:
    """The flagship: query, rank, slug. queries: query, text [, selected]; entities: type, slug, title, status, t_invalid, load_ord."""
    pages = entities.where(~F.col("type").isin(*exclude)) if exclude else entities
    pages = pages if history else pages.where(is_current())
    pages = pages.select("type", "slug", "title", "load_ord")
    first = written(dealt(pages.select("slug", "load_ord"), "slug").groupBy("slug").agg(F.min("load_ord").alias("ord")), "first")
    seeds = name_seeds(queries, pages).select("query", "slug", F.lit(0).alias("part"), F.col("load_ord").alias("key"))
    if "selected" in queries.columns:
        seeds = seeds.unionByName(selected(queries, pages, most).select("query", "slug", F.lit(1).alias("part"), F.lpad(F.col("rank").cast("string"), 9, "0").alias("key")))
        seeds = seeds.groupBy("query", "slug").agg(F.min(F.struct("part", "key")).alias("k")).select("query", "slug", "k.*")
    # seeds come before all neighbours, and no seed beyond the cut can be shown or bring anything that is
    order = Window.partitionBy("query").orderBy("part", "key")
    seeds = seeds.withColumn("seed_ord", F.row_number().over(order)).where(F.col("seed_ord") <= most).select("query", "slug", "seed_ord")
    # cut and broadcast: few as they are, they would else be worked out, and a hub's edges gathered, once for each stage
    seeds = checked_broadcast(written(checked_broadcast(written(seeds, "seeds")).join(first, "slug"), "seeds"))
    found = lambda df, col, ord_: checked_broadcast(written(df, "ahead")).join(first.select(F.col("slug").alias(col), F.col("ord").alias(ord_)), col)
    pad = lambda c: F.lpad(c.cast("string"), 9, "0")
    rel, pos = G.relation_order(), F.col("pos")
    place = lambda step, key, page, relation=F.lit(""): ["query", "seed_ord", F.lit(step).alias("step"), relation.alias("relation"), key.alias("key"), F.col(page).alias("page")]
    # of a slug in two types the first page is meant (TR9): edges of its other pages go
    at = ["src_slug", "src_ord"]
    every = entities.select(F.col("slug").alias("src_slug"), F.col("load_ord").alias("src_ord"))
    others = checked_broadcast(written(every.join(first.select(F.col("slug").alias("src_slug"), F.col("ord").alias("src_ord")), at, "left_anti"), "others"))
    ahead = e.select("src_slug", "src_ord", "relation", "pos", "target")
    own = written(found(ahead.join(seeds, F.col("src_slug") == F.col("slug")).join(others, at, "left_anti"), "target", "target_ord"), "own")
    typed = own.where("relation <> 'related'")
    rows = seeds.select(*place(-1, F.lit(""), "slug")).unionByName(typed.select(*place(0, F.concat(pad(rel), pad(pos)), "target")))
    one = typed.where(F.col("relation").isin(*V.TRANSITIVE)).select("query", "seed_ord", F.col("target").alias("mid"), F.concat(pad(rel), pad(pos)).alias("way"))
    two = found(ahead.where(F.col("relation").isin(*V.TRANSITIVE)).join(checked_broadcast(one), F.col("src_slug") == F.col("mid")).join(others, at, "left_anti"), "target", "target_ord")
    rows = rows.unionByName(two.select(*place(1, F.concat("way", pad(rel), pad(pos)), "target")))
    # any page may be a source, also a later one of its slug, but none that is left out
    out = checked_broadcast(written(every.join(pages.select(F.col("slug").alias("src_slug"), F.col("load_ord").alias("src_ord")), at, "left_anti"), "out"))
    back = e.select("src_slug", "src_ord", "relation", "target").join(seeds.withColumnRenamed("slug", "target"), "target")
    back = written(back.join(first.select(F.col("slug").alias("src_slug")), "src_slug", "left_semi").join(out, at, "left_anti"), "back")
    rows = rows.unionByName(back.where(F.col("relation").isin(*V.SYMMETRIC)).select(*place(2, F.col("src_ord"), "src_slug")))
    asked = queries.select("query", F.explode(intents()).alias("relation"))
    rows = rows.unionByName(back.join(checked_broadcast(asked), ["query", "relation"]).select(*place(3, F.concat("src_ord", F.lit(" "), pad(rel)), "src_slug", F.col("relation"))))
    rows = rows.unionByName(own.where("relation = 'related'").select(*place(4, pad(pos), "target")))
    rows = rows.groupBy("query", "seed_ord", "step", "relation", "page").agg(F.min("key").alias("key"))
    # of a list at most ``most`` pages have been shown before, and at most as many can be shown
    few = Window.partitionBy("query", "seed_ord", "step", "relation").orderBy("key", "page")
    rows = rows.withColumn("n", F.row_number().over(few)).where(F.col("n") <= 2 * most)
    ship(queries.sparkSession)

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(late=group.step >= 0).sort_values(["late", "seed_ord", "step", "key", "page"], kind="stable")
        shown: dict[str, int] = {}
        took: dict[tuple, int] = {}
        for r in group.itertuples():
            if len(shown) == most:
                break
            if r.page in shown or r.step == 3 and took.get((r.seed_ord, r.relation), 0) == cap:
                continue
            shown[r.page] = len(shown) + 1
            if r.step == 3:
                took[r.seed_ord, r.relation] = took.get((r.seed_ord, r.relation), 0) + 1
        return pd.DataFrame({"query": group["query"].iloc[0], "rank": list(shown.values()), "slug": list(shown)})

    kind = dict(rows.dtypes)["query"]
    return rows.select("query", "seed_ord", "step", "relation", "key", "page").groupBy("query").applyInPandas(resolve, f"query {kind}, rank int, slug string")


def citations(answers: DataFrame) -> DataFrame:
    """Answers (query, answer, provided: array of slugs) to query, sources.

    Wikilinked slugs that were provided, in order; then provided slugs that occur in the text; if none, all provided.
    """
    links = F.filter(X.wikilinks("answer"), lambda s: F.array_contains("provided", s))
    plain = F.filter("provided", lambda s: F.expr("answer").contains(s) & (s != ""))
    found = F.array_distinct(F.concat(links, plain))
    return answers.select("query", F.when(F.size(found) > 0, found).otherwise(F.col("provided")).alias("sources"))


def with_history(chosen: DataFrame, e: DataFrame, pages: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """Each chosen page followed by what it supersedes, first per page, cut. chosen: query, rank, slug (or ``type:slug``)."""
    walk = histories(e, pages, chosen.select(F.col("slug").alias("ref")))
    rows = chosen.join(walk.select("start", "place", "type", F.col("slug").alias("page")), chosen["slug"] == walk["start"]).select("query", "type", "page", F.struct("rank", "place").alias("place"))
    first = rows.groupBy("query", "type", "page").agg(F.min("place").alias("place"))
    w = Window.partitionBy("query").orderBy("place", "type", "page")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query", "rank", F.col("page").alias("slug"))

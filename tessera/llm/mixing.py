"""Mixing sources to target weights by temperature; DataFrame functions only.

Source token shares are raised to an exponent in [0, 1], which is bisected until the entropy of the
weights meets a target or until no source is repeated more often than a limit. The weights are then
realised as budgeted block permutations: a source whose quota is q tokens of its s tokens is read
q div s whole times, then in a permutation of its blocks until the rest of the quota is used up.

Tokens here are runs of characters other than ``[\\x20\\x09-\\x0D]``. A document's key in a reading (epoch) is the first 60 bits of
MD5(seed:epoch:id); its leading bits are its block and blocks follow one another in key order, so a random
permutation of blocks and of documents in a block is a sort by key that needs no row to move, and every reading has one of its own.

The table of sources is one row of arrays; it is taken to fit (up to about a million sources).

Defined cases: a null source is a source of its own; a null text has no tokens; a null id has the key of
an empty id; documents that share a key are taken or left together, repeated rows among them; a source without tokens has
weight 0 and is read once; an empty table gives an empty result; further columns pass through ``mix``, whose own names begin
with mix_, or where a column of docs does so already with as many more underscores before it as it takes.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checked_broadcast, cut, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
STEPS = 60
DIGITS = 6
KEY_BITS = 60


def token_count(col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text_or_empty(col), F.lit(WORD)), F.lit(0)).cast("long")


def key_of(id_col: str, seed: int, epoch: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, also within lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _weights(tokens: Column, alpha: Column) -> Column:
    """Normalised weights of an array of token counts."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    share = lambda n: F.transform(tokens, lambda t: F.when(t > 0, F.pow(t / n, alpha)).otherwise(F.lit(0.0)))
    normal = lambda raw: _let(total(raw), lambda n: F.transform(raw, lambda w: F.try_divide(w, n)))
    return _let(total(tokens), lambda n: _let(share(n), normal))


def temperature(sources: DataFrame, max_repeats: float | None = None, entropy: float | None = None) -> DataFrame:
    """source, tokens, alpha, weight: sources has source and tokens.

    ``max_repeats``: the largest exponent at which the source that is repeated most is read at most so
    often while the one repeated least is read once. ``entropy``: the exponent at which the weights have
    so many nats (the nearest that exponents in [0, 1] reach). The exponent is rounded to 6 digits.
    """
    row = sources.agg(F.array_sort(F.collect_list(F.struct("source", F.col("tokens").cast("double").alias("tokens")))).alias("s"))
    row = row.withColumn("t", F.transform("s", lambda x: x["tokens"]))
    some = F.filter("t", lambda x: x > 0)
    row = cut(row.withColumn("spread", F.log(F.try_divide(F.array_max(some), F.array_min(some)))))

    def too_flat(alpha: Column) -> Column:
        """Whether the exponent has to grow."""
        if max_repeats is not None:
            return (1 - alpha) * F.col("spread") > log(max_repeats)
        h = lambda ws: F.aggregate(ws, F.lit(0.0), lambda a, w: a - F.when(w > 0, w * F.log(w)).otherwise(F.lit(0.0)))
        return _let(_weights(F.col("t"), alpha), h) > entropy

    if max_repeats is None and entropy is None:
        raise ValueError("max_repeats or entropy must be given")
    half = lambda a: lambda m: F.when(too_flat(m), F.struct(m.alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi")))
    step = lambda a, _: _let((a["lo"] + a["hi"]) / 2, half(a))
    alpha = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step, lambda a: F.round(a["hi"], DIGITS))
    row = cut(row.select("s", "t", F.coalesce(alpha, F.lit(1.0)).alias("alpha")))
    row = row.withColumn("w", _weights(F.col("t"), F.col("alpha")))
    return row.select(F.explode(F.arrays_zip("s", "w")).alias("x"), "alpha").select("x.s.source", F.col("x.s.tokens").cast("long").alias("tokens"), "alpha", F.coalesce("x.w", F.lit(0.0)).alias("weight"))


def quotas(weights: DataFrame, budget: int | None = None) -> DataFrame:
    """Adds passes (whole readings) and rest (tokens of the last, partial one).

    ``budget`` is the mixture's size in tokens; without one it is the least at which every source is
    read at least once, so that the weights are met by repetition and no document is lost.
    """
    w = Window.partitionBy(F.lit(0))  # a row for each source
    size = F.lit(float(budget)) if budget is not None else F.max(F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight"))).over(w)
    quota = F.floor(F.col("weight") * F.col("size") + F.lit(1e-6)).cast("long")
    return (
        weights.withColumn("size", size).withColumn("quota", quota)
        .withColumn("passes", F.when(F.col("tokens") == 0, F.lit(1)).otherwise(F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).cast("long"))
        .withColumn("rest", F.when(F.col("tokens") == 0, F.lit(-1)).otherwise(F.greatest(F.col("quota") - F.col("passes") * F.col("tokens"), F.lit(0))).cast("long")).drop("size")
    )


def cutoffs(counted: DataFrame, shares: DataFrame, block_rows: int = 4096) -> DataFrame:
    """Per source the last key that the partial reading takes (null: none).

    counted: source, key, tokens. Block sums first, then the running sum of blocks, then the rows of
    the one block in which the quota ends: no window holds more than a source's blocks or a block.
    """
    n = counted.groupBy("source").agg(F.count("*").alias("n"))
    bits = F.least(F.lit(KEY_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / block_rows)))).cast("int")
    shape = checked_broadcast(cut(n.join(shares.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).select("s", "rest", (F.lit(KEY_BITS) - bits).alias("shift"))))
    keyed = counted.join(shape, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.expr("shiftright(key, shift)"))
    sums = keyed.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    run = Window.partitionBy("source").orderBy("block")
    ends = sums.withColumn("upto", F.sum("tokens").over(run)).withColumn("before", F.col("upto") - F.col("tokens")).where("before <= rest")
    last = ends.groupBy("source").agg(F.max(F.struct("block", "before", "rest")).alias("e")).select(F.col("source").alias("ls"), "e.*")
    last = checked_broadcast(cut(last.withColumnRenamed("block", "lb").withColumnRenamed("rest", "lr")))
    inside = keyed.join(last, F.col("source").eqNullSafe(F.col("ls")) & (F.col("block") == F.col("lb")))
    upto = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("key")))
    taken = upto.groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("lr"), F.col("key"))).alias("key"), F.min("lb").alias("lb"), F.min("shift").alias("shift"))
    # none of the block is taken: the key before its first
    return taken.select(F.col("source").alias("cs"), F.coalesce("key", F.expr("shiftleft(lb, shift) - 1")).alias("last_key"))


def plan(docs: DataFrame, max_repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each source: source, tokens, alpha, weight, quota, passes, rest, last_key."""
    counted = cut(docs.select(F.col(source_col).alias("source"), F.col(id_col).cast("string").alias("id"), token_count(text_col).alias("tokens")))
    sources = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    shares = cut(quotas(temperature(sources, max_repeats, entropy), budget))
    # the partial reading comes after the whole ones
    last = checked_broadcast(shares.select(F.col("source").alias("s"), "passes"))
    keyed = counted.join(last, F.col("source").eqNullSafe(F.col("s"))).select("source", key_of("id", seed, F.col("passes")).alias("key"), "tokens")
    ends = cutoffs(keyed, shares)
    return cut(shares.join(ends, F.col("source").eqNullSafe(F.col("cs")), "left").drop("cs"))


def mix(docs: DataFrame, max_repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs' rows as often as the mixture reads them, with mix_epoch (from 0), mix_key, mix_alpha and mix_weight."""
    shares = plan(docs, max_repeats, entropy, budget, seed, id_col, text_col, source_col)
    m = "mix_"
    while any(c.lower().startswith(m) for c in docs.columns):
        m = "_" + m
    per_source = checked_broadcast(shares.select(F.col("source").alias(f"{m}source"), F.col("passes").alias(f"{m}passes"), F.col("last_key").alias(f"{m}last"), F.col("alpha").alias(f"{m}alpha"), F.col("weight").alias(f"{m}weight")))
    passes = F.col(f"{m}passes")
    rows = docs.join(per_source, docs[source_col].eqNullSafe(F.col(f"{m}source")))
    times = passes + F.when(key_of(id_col, seed, passes) <= F.col(f"{m}last"), 1).otherwise(0)
    rows = rows.withColumn(f"{m}times", times).where(F.col(f"{m}times") > 0)
    rows = rows.withColumn(f"{m}epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{m}times") - 1)))
    return rows.withColumn(f"{m}key", key_of(id_col, seed, F.col(f"{m}epoch"))).select(*docs.columns, *(f"{m}{c}" for c in ("epoch", "key", "alpha", "weight")))

"""Token similarity of statements (J7, J9, D1): exact on the normalised text, or Jaccard of words at a threshold.

Candidates meet on their rarest words (prefix filter): two sets with Jaccard t or more share one of the first
size - ceil(t * size) + 1 words of each in a common order of rarity, so no pair is missed and frequent words
hardly ever meet. Verification is exact. No cross join; equal word sets are one row while they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.components import written
from tessera.session import checked_broadcast

THRESHOLD = 0.75


def prefixed(sets: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """set_id, gram, size: the words of each set's prefix, rarest first. frequency: word, n."""
    ranked = sets.select("set_id", F.size("words").alias("size"), F.explode("words").alias("word")).join(frequency, "word")
    order = Window.partitionBy("set_id").orderBy("n", "word")
    return ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).select("set_id", F.col("word").alias("gram"), "size")


def _sizes(sets: DataFrame) -> tuple[int, int]:
    r = sets.agg(F.min(F.size("words")).alias("a"), F.max(F.size("words")).alias("b")).first()
    return (0, -1) if r["a"] is None else (r["a"], r["b"])


def similar_sets(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """left and right (set_id, words) to li, ri, score: every pair of different or equal sets at the threshold.

    Sets outside the sizes that the other side can match go first; the rest is written once, and from there on only ids
    shuffle until pairs are verified.
    """
    some = F.size("words") > 0
    least, most = _sizes(right.where(some))
    fits = F.size("words").between(F.ceil(F.lit(least) * threshold - 1e-9), F.floor(F.lit(most) / threshold + 1e-9))
    l = written(left.where(some & fits).select("set_id", "words").dropDuplicates(["set_id"]), "sets")  # noqa: E741
    least, most = _sizes(l)
    fits = F.size("words").between(F.ceil(F.lit(least) * threshold - 1e-9), F.floor(F.lit(most) / threshold + 1e-9))
    r = written(right.where(some & fits).select("set_id", "words").dropDuplicates(["set_id"]), "sets")
    freq = l.select("words").unionByName(r.select("words")).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    lp = prefixed(l, freq, threshold).select(F.col("set_id").alias("li"), "gram", F.col("size").alias("ls"))
    rp = prefixed(r, freq, threshold).select(F.col("set_id").alias("ri"), "gram", F.col("size").alias("rs"))
    near = (F.col("ls") >= F.ceil(F.col("rs") * threshold - 1e-9)) & (F.col("rs") >= F.ceil(F.col("ls") * threshold - 1e-9))
    pairs = lp.join(rp, "gram").where(near).select("li", "ri").distinct()
    full = pairs.join(l.select(F.col("set_id").alias("li"), F.col("words").alias("lw")), "li").join(r.select(F.col("set_id").alias("ri"), F.col("words").alias("rw")), "ri")
    return written(full.select("li", "ri", X.jaccard(F.col("lw"), F.col("rw")).alias("score")).where(F.col("score") >= threshold), "pairs")


def digest(text: Column) -> Column:
    """128 bits that stand for a text in shuffles."""
    return F.unhex(F.md5(text))


def with_words(rows: DataFrame, statement: str = "statement") -> DataFrame:
    """rows with norm, norm_id, words (sorted) and set_id: ids of the normalised text and of its set of words."""
    out = rows.withColumn("norm", X.normalize(statement))
    out = out.withColumn("words", F.array_sort(F.array_distinct(F.filter(F.split("norm", " "), lambda w: w != ""))))
    return out.withColumns({"norm_id": digest(F.col("norm")), "set_id": digest(F.array_join("words", " "))})


def best_scores(candidates: DataFrame, known: DataFrame, threshold: float = THRESHOLD, statement: str = "statement") -> DataFrame:
    """Candidates with norm_id and best, the highest similarity to a known statement (null below the threshold; 1 if equal)."""
    c, k = with_words(candidates, statement), written(with_words(known, statement).select("norm", "norm_id", "set_id", "words"), "known")
    pairs = similar_sets(c, k, threshold).groupBy(F.col("li").alias("set_id")).agg(F.max("score").alias("__score"))
    equal = k.where("norm <> ''").select("norm_id").distinct().withColumn("__equal", F.lit(1.0))
    out = c.join(checked_broadcast(equal), "norm_id", "left").join(checked_broadcast(pairs), "set_id", "left")
    return out.select(*candidates.columns, "norm_id", (F.col("norm") != "").alias("__some"), F.coalesce("__equal", "__score").alias("best"))


def dedupe(candidates: DataFrame, known: DataFrame, ord_col: str = "ord", threshold: float = THRESHOLD, statement: str = "statement") -> DataFrame:
    """Candidates with kept. A blank one, a repeat of an earlier one (exact only, TR7) or of a known one is dropped."""
    scored = best_scores(candidates, known, threshold, statement)
    first = scored.groupBy("norm_id").agg(F.min(ord_col).alias("__first"))
    out = scored.join(first, "norm_id")
    return out.select(*candidates.columns, (F.col("__some") & F.col("best").isNull() & (F.col(ord_col) == F.col("__first"))).alias("kept"))


def best_entries(candidates: DataFrame, ledger: DataFrame, threshold: float = THRESHOLD, statement: str = "statement") -> DataFrame:
    """Each candidate's ledger entry: exact fingerprint, else the most similar variant; ties to the later entry (ord).

    candidates: cand, kind, statement; ledger: kind, fingerprint, statements, ord. The best over all variants of an
    entry counts (TR6). Gives cand, kind, fingerprint, score.
    """
    c = with_words(candidates, statement).where("norm <> ''").select("cand", "kind", "norm_id", "set_id", "words")
    own = ledger.select("kind", "fingerprint", digest(F.col("fingerprint")).alias("norm_id"))
    exact = c.join(own, ["kind", "norm_id"]).select("cand", "kind", "fingerprint", F.lit(1.0).alias("score"), F.lit(True).alias("exact"), F.lit(0).cast("long").alias("ord"))
    variants = ledger.select("kind", "fingerprint", "ord", F.explode(F.concat(F.array("fingerprint"), F.coalesce("statements", F.array().cast("array<string>")))).alias("__v"))
    variants = with_words(variants, "__v")
    pairs = similar_sets(c, variants, threshold)
    fuzzy = c.select("cand", "kind", F.col("set_id").alias("li")).join(checked_broadcast(pairs), "li").join(variants.select("kind", "fingerprint", F.col("ord").cast("long").alias("ord"), F.col("set_id").alias("ri")), ["kind", "ri"])
    best = exact.unionByName(fuzzy.select("cand", "kind", "fingerprint", "score", F.lit(False).alias("exact"), "ord")).groupBy("cand", "kind").agg(F.max(F.struct("exact", "score", "ord", "fingerprint")).alias("b"))
    return best.select("cand", "kind", F.col("b.fingerprint").alias("fingerprint"), F.col("b.score").alias("score"))

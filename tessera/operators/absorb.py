"""Statements absorbed into the ledger one after the other (ST6, J9, D2): each may match an entry that an earlier one of the same batch opened.

Whatever can match lies in one component of the graph of similar word sets (with each entry's own variants linked), so components are
independent and only within one does order count. Components are found with joins; each is then folded in order by a task that
streams its rows. The fold looks entries up by their rarest words: an entry that reaches the threshold holds one of the first
size - ceil(t * size) + 1 of any order of the statement's words.

Defined cases: blank statements are passed over; a null confidence counts as 0, a null category as none; of rows with equal ``ord`` the order is by statement; entries that
no statement can reach pass unchanged and are not read by the fold; an empty batch leaves the ledger as it is; further columns of the batch are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import similarity as S
from tessera.operators.components import components, written
from tessera.session import ship

ENTRY = (
    "kind string, fingerprint string, statements array<string>, categories array<string>, first_seen string, last_seen string, "
    "seen_count long, confidence_history array<double>, promoted boolean, promoted_at string"
)


class Entries:
    """The entries of one component, in the ledger's order."""

    def __init__(self, threshold: float, statements: int, confidences: int):
        self.threshold, self.most_statements, self.most_confidences = threshold, statements, confidences
        self.rows: list[dict] = []
        self.variants: list[list[tuple[str, frozenset]]] = []
        self.by_key: dict[tuple[str, str], int] = {}
        self.holding: dict[tuple[str, str], set[int]] = {}

    def put(self, row: dict, variants: list[tuple[str, frozenset]]) -> int:
        i = len(self.rows)
        self.rows.append(row)
        self.variants.append(variants)
        self.by_key[row["kind"], row["fingerprint"]] = i
        for _, words in variants:
            self._hold(i, words)
        return i

    def _hold(self, i: int, words: frozenset) -> None:
        for w in words:
            self.holding.setdefault((self.rows[i]["kind"], w), set()).add(i)

    def find(self, kind: str, fingerprint: str, words: frozenset) -> int | None:
        """The entry of that key; else the most similar one: entries in order, equal scores to the later, of an entry the first variant that is no worse than the best so far."""
        if (i := self.by_key.get((kind, fingerprint))) is not None:
            return i
        held = sorted((self.holding.get((kind, w), ()) for w in words), key=len)
        near = set().union(*held[: len(words) - ceil(self.threshold * len(words) - 1e-9) + 1])
        found, best = None, self.threshold
        for i in sorted(near):
            for _, own in self.variants[i]:
                both = len(words & own)
                if both and (score := both / (len(words) + len(own) - both)) >= best:
                    found, best = i, score
                    break
        return found

    def record(self, i: int, statement: str, words: frozenset, confidence: float, category: str | None, today: str) -> None:
        e = self.rows[i]
        e["first_seen"] = e["first_seen"] or today
        e["last_seen"] = today
        e["seen_count"] += 1
        e["confidence_history"] = [*e["confidence_history"], max(0.0, min(1.0, confidence))][-self.most_confidences :]
        if statement and statement not in e["statements"]:
            e["statements"] = [*e["statements"], statement][-self.most_statements :]
            kept = set(e["statements"])
            self.variants[i] = [self.variants[i][0], *(v for v in self.variants[i][1:] if v[0] in kept), (statement, words)]
            self._hold(i, words)
        if category and e["kind"] == "fact" and category not in e["categories"]:
            e["categories"] = [*e["categories"], category]


def absorb(ledger: DataFrame, batch: DataFrame, today: str, threshold: float = S.THRESHOLD, statements: int = 5, confidences: int = 30) -> DataFrame:
    """The ledger (as ENTRY) with the batch (kind, statement, confidence, category, ord) recorded in order, and ``today_confidence``: the highest of
    today's statements that would now find the entry (null: none), and ``opened``: the ord of the row that opened it (null: it was there)."""
    spark = ledger.sparkSession
    ship(spark)
    none = F.array().cast("array<string>")
    old = ledger.select(*(F.col((n := f.split())[0]).cast(n[1]) for f in ENTRY.split(", "))).withColumns({"statements": F.coalesce("statements", none), "categories": F.coalesce("categories", none), "confidence_history": F.coalesce("confidence_history", F.array().cast("array<double>"))})
    new = written(S.with_words(batch.select("kind", F.coalesce("statement", F.lit("")).alias("statement"), "confidence", "category", "ord")).where("norm <> ''"), "batch")
    # the ledger may be worked out from all sightings: it is read five times, so it is written first
    entry = written(S.with_words(old, "fingerprint").select(*old.columns, F.col("set_id").alias("own")), "ledger")
    variants = written(S.with_words(entry.select("kind", "fingerprint", F.explode(F.concat(F.array("fingerprint"), "statements")).alias("__v")), "__v").select("kind", "fingerprint", "set_id", "words"), "variants")
    # what may meet: similar sets, and an entry's variants
    sets = written(new.select("set_id", "words").unionByName(variants.select("set_id", "words")).dropDuplicates(["set_id"]), "words")
    near = S.similar_sets(sets, sets, threshold).where("li <= ri").select(F.col("li").alias("u"), F.col("ri").alias("v"))
    held = variants.join(entry.select("kind", "fingerprint", "own"), ["kind", "fingerprint"]).select(F.col("own").alias("u"), F.col("set_id").alias("v"))
    part = components(near.unionByName(held).unionByName(sets.select(F.col("set_id").alias("u"), F.col("set_id").alias("v")))).withColumnRenamed("node", "set_id")
    touched = written(new.join(part, "set_id"), "touched")
    placed = written(entry.join(part.withColumnRenamed("set_id", "own"), "own"), "placed")
    live = touched.select("component").distinct()
    reached = placed.join(live, "component", "left_semi")
    rest = placed.join(live, "component", "left_anti").select(old.columns)

    words = lambda v: F.array_distinct(F.filter(F.split(X.normalize(v), " "), lambda w: w != ""))
    pair = lambda v: F.struct(v.alias("text"), words(v).alias("words"))
    # entries stand before the batch, in the ledger's order
    a = reached.select("component", F.lit(0).alias("side"), F.lit(None).cast("long").alias("ord"), "kind", "fingerprint", F.lit(None).cast("string").alias("statement"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("array<string>").alias("words"), F.struct(*old.columns).alias("entry"), F.transform(F.concat(F.array("fingerprint"), "statements"), pair).alias("variants"))
    b = touched.select("component", F.lit(1).alias("side"), F.col("ord").cast("long").alias("ord"), "kind", F.col("norm").alias("fingerprint"), "statement", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), "category", "words", F.lit(None).cast(a.schema["entry"].dataType).alias("entry"), F.lit(None).cast(a.schema["variants"].dataType).alias("variants"))
    # facts come before patterns, as two lists
    rows = a.unionByName(b).withColumn("order", F.when(F.col("side") == 1, F.col("ord")))
    rows = rows.repartition("component").sortWithinPartitions("component", "side", "kind", "order", F.when(F.col("side") == 0, F.col("fingerprint")), "statement").drop("order", "side")
    names = [f.split()[0] for f in ENTRY.split(", ")]
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "long": pa.int64(), "array<double>": pa.list_(pa.float64()), "boolean": pa.bool_()}
    schema = pa.schema([*((f.split()[0], kinds[f.split()[1]]) for f in ENTRY.split(", ")), ("today_confidence", pa.float64()), ("opened", pa.int64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, said = None, None, {}

        def done() -> list[dict]:
            best: dict[int, float] = {}
            for (kind, fingerprint), (words, confidence) in said.items():
                if (i := state.find(kind, fingerprint, words)) is not None:
                    best[i] = max(best.get(i, 0.0), confidence)
            return [{"opened": None} | e | {"today_confidence": best.get(i)} for i, e in enumerate(state.rows)]

        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                if state is None or r["component"] != now:
                    if state is not None:
                        out += done()
                    state, now, said = Entries(threshold, statements, confidences), r["component"], {}
                if r["entry"] is not None:
                    state.put({n: r["entry"][n] for n in names}, [(v["text"], frozenset(v["words"])) for v in r["variants"]])
                    continue
                words, key = frozenset(r["words"]), (r["kind"], r["fingerprint"])
                i = state.find(*key, words)
                if i is None:
                    made = {"kind": r["kind"], "fingerprint": r["fingerprint"], "statements": [], "categories": [], "first_seen": "", "last_seen": "", "seen_count": 0, "confidence_history": [], "promoted": False, "promoted_at": "", "opened": r["ord"]}
                    i = state.put(made, [(r["fingerprint"], words)])
                state.record(i, r["statement"].strip(), words, r["confidence"], r["category"], today)
                said[key] = (words, max(r["confidence"], said[key][1]) if key in said else r["confidence"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist(done(), schema)

    folded = rows.mapInArrow(fold, f"{ENTRY}, today_confidence double, opened long")
    return written(folded, "absorbed").unionByName(rest.withColumns({"today_confidence": F.lit(None).cast("double"), "opened": F.lit(None).cast("long")}))

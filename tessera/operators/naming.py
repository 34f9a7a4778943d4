"""Names that are free (M16, Z7): a row whose name is taken gets the first free of name-2, name-3 ..., as if rows were saved one after the other.

Only two kinds of rows can take ``x-5``: a row of group ``x``, in turn, and the first row of group ``x-5`` itself. So groups are dealt with from the
outermost name inwards. In a group the g-th row that needs a number takes the g-th that is not blocked; a number is blocked if it is stored,
or if its own group's first row came before the row that would get there. Blocked numbers b_1 < b_2 ... shift all rows from the
(b_j - j)-th on, so a row's number follows from its place among rows and blocked numbers in one order, which is found by ranges: a
hot name lies in many tasks. Which numbers are blocked by rows is settled in rounds, the lowest first; mostly one or two are enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import written
from tessera.operators.ranking import ranked

#: A number that a name may end in: from 2 on, without leading zeros.
NUMBER = r"-([2-9]|[1-9][0-9]{1,17})$"
ROUNDS = 1000


def _stem(c: str) -> Column:
    return F.when(F.col(c).rlike(NUMBER), F.regexp_replace(c, NUMBER, ""))


def _number(c: str) -> Column:
    return F.regexp_extract(c, NUMBER, 1).cast("long")


def _numbered(rows: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (g) with n, and blocked (scope, name, n) with g: the row that would get there."""
    by = ["scope", "name"]
    marks = written(ranked(blocked, by, [F.col("n")], "j").select(*by, "n", (F.col("n") - F.col("j")).alias("g")), "marks")
    both = rows.select(*by, "at", "g", F.lit(1).alias("side")).unionByName(marks.select(*by, F.lit(None).cast(rows.schema["at"].dataType).alias("at"), "g", F.lit(0).alias("side")))
    placed = ranked(both, by, [F.col("g"), F.col("side")], "p").where("side = 1").select(*by, "at", "g", (F.col("p") + 1).alias("n"))
    return written(placed, "numbers"), marks


def free_names(rows: DataFrame, stored: DataFrame, name: str = "slug", order: str = "ord", scope: str | None = None) -> DataFrame:
    """rows with ``name`` replaced by one that is free in its scope. stored: scope (if any) and ``name`` of what is there.

    Defined cases: of rows with equal order those with the lesser name come first; null names and scopes are names and scopes of their own, a null name stays; repeated
    stored names count once; an empty table gives an empty result; further columns stay.
    """
    kind = rows.schema[order].dataType.simpleString()
    sc = F.col(scope) if scope else F.lit("")
    sc = F.coalesce(F.concat(F.lit("="), sc.cast("string")), F.lit("-"))
    own = written(rows.withColumns({"__scope": sc, "__row": F.monotonically_increasing_id()}), "rows")
    todo = own.where(F.col(name).isNotNull()).select(F.col("__scope").alias("scope"), F.col(name).alias("name"), F.struct(F.col(order).cast(kind).alias("o"), F.col(name).alias("s"), F.col("__row").alias("r")).alias("at"))
    there = stored.where(F.col(name).isNotNull()).select(sc.alias("scope"), F.col(name).alias("name")).distinct()
    depth = F.size(F.split(F.regexp_extract("name", "((?:-(?:[2-9]|[1-9][0-9]{1,17}))*)$", 1), "-")) - 1
    todo = ranked(todo, ["scope", "name"], [F.col("at")]).withColumn("depth", depth)
    todo = written(todo, "ranked")
    groups = written(todo.where("place = 1").select("scope", "name", F.col("at").alias("first"), "depth"), "groups")
    numbers = lambda df, *more: df.select("scope", _stem("name").alias("stem"), _number("name").alias("n"), *more).where("stem IS NOT NULL").withColumnRenamed("stem", "name")
    kept = written(numbers(there), "stored")
    rivals = written(numbers(groups.join(there, ["scope", "name"], "left_anti"), "first"), "rivals")
    deepest = groups.agg(F.max("depth")).first()[0]
    taken, done = None, None
    for d in range((deepest if deepest is not None else -1) + 1):
        # a group has its own name unless it is stored or a row of the outer group took it before
        level = groups.where(F.col("depth") == d).select("scope", "name", "first").join(there.withColumn("had", F.lit(True)), ["scope", "name"], "left")
        if taken is not None:
            level = level.join(taken, ["scope", "name"], "left").withColumn("had", F.coalesce(F.col("had"), F.col("by") < F.col("first")))
        level = level.select("scope", "name", F.coalesce("had", F.lit(False)).alias("had"))
        here = written(todo.where(F.col("depth") == d).join(level, ["scope", "name"]).withColumn("g", F.col("place") - F.when(F.col("had"), 0).otherwise(1)), "level")
        need = here.where("g > 0")
        live = need.select("scope", "name").distinct()
        fixed, rival = written(kept.join(live, ["scope", "name"], "left_semi"), "fixed"), written(rivals.join(live, ["scope", "name"], "left_semi"), "rival")
        some = rival.limit(1).count() > 0
        won = rival.where("false").select("scope", "name", "n")
        for _ in range(ROUNDS):
            placed, marks = _numbered(need, fixed.unionByName(won))
            if not some:
                break
            # the row that gets to a rival's number, or would if it weren't blocked
            at = rival.join(marks, ["scope", "name", "n"], "left").join(placed.select("scope", "name", "n", F.col("at").alias("a")), ["scope", "name", "n"], "left")
            at = at.join(placed.select("scope", "name", "g", F.col("at").alias("b")), ["scope", "name", "g"], "left")
            new = written(at.where(F.col("first") < F.coalesce("a", "b")).select("scope", "name", "n"), "won")
            if new.exceptAll(won).limit(1).count() == 0 and won.exceptAll(new).limit(1).count() == 0:
                break
            won = new
        else:
            raise RuntimeError("names didn't settle")
        part = here.where("g = 0").select("scope", "at", F.col("name").alias("free"))
        part = part.unionByName(placed.select("scope", "at", F.concat("name", F.lit("-"), "n").alias("free")))
        done = part if done is None else done.unionByName(part)
        taken = written(placed.select("scope", F.concat("name", F.lit("-"), "n").alias("name"), F.col("at").alias("by")), "taken")
    if done is None:
        return rows
    out = own.join(done.select(F.col("at.r").alias("__row"), "free"), "__row", "left")
    return out.withColumn(name, F.coalesce("free", name)).select(rows.columns)

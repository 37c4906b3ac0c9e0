"""Seeded samples, corrupted facts and negatives. All choices follow md5 hashes, so any engine can repeat them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ordinal_ranks
from ..functions.saved import saved
from ..functions.scalars import stable_hash, stable_hex
from .statistics import type_sets


def per_relation(facts: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """At most k facts of each relation, those whose hash is least. Spark keeps k rows of each task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("p").orderBy(stable_hash("p", "s", "o", seed=seed), "s", "o"))
    return facts.withColumn("_k", rank).filter(F.col("_k") <= k).drop("_k")


def drawn_per_relation(facts: DataFrame, k: int, seed: int, n: dict) -> DataFrame:
    """per_relation(), by the number of facts of each relation: only facts whose hash is below a bound that k facts are below are
    sorted. Where fewer are, all are."""
    kind = facts.schema["p"].dataType.simpleString()
    rows = [(p, f"{min(2**32 - 1, int(2**32 * (k + 8 * k**0.5 + 40) / c)):08x}" if c > k else "g") for p, c in n.items()]
    limit = F.broadcast(facts.sparkSession.createDataFrame(rows, f"p {kind}, _t string"))  # a row for each relation
    low = saved(facts.join(limit, "p").filter(stable_hex("p", "s", "o", seed=seed) < F.col("_t")).select(facts.columns), "low")
    found = {r["p"]: r["count"] for r in low.groupBy("p").count().collect()}
    enough = all(found.get(p, 0) >= min(k, c) for p, c in n.items())
    return per_relation(low if enough else facts, k, seed)


def share(facts: DataFrame, part: float, seed: int = 42) -> DataFrame:
    """The facts whose hash is in the lowest part of all hashes: a share without a sort."""
    return facts.filter(stable_hash("p", "s", "o", seed=seed) < int(part * 2**32))


def exact_share(facts: DataFrame, part: float, seed: int = 42) -> DataFrame:
    """floor(n * part) of n facts, those of least hash, without replacement."""
    rows = ordinal_ranks(facts.withColumn("_h", stable_hash("p", "s", "o", seed=seed).cast("double")), "_h", ["p", "s", "o"], "_k")
    n = rows.agg(F.floor(F.count("*") * part).alias("_n"))  # one row
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(n.withColumn("_one", F.lit(1))), "_one").filter("_k <= _n").drop("_h", "_k", "_n", "_one")


def numbered(entities: DataFrame, keys: list[str]) -> DataFrame:
    """e, keys, _i from 0 within keys, _n: entities in order of their name, for a choice by hash modulo _n."""
    if not keys:
        n = entities.count()
        return ordinal_ranks(entities, "e", [], "_i").withColumn("_i", F.col("_i") - 1).withColumn("_n", F.lit(n))
    w = Window.partitionBy(*keys)
    return entities.withColumn("_i", F.row_number().over(w.orderBy("e")) - 1).withColumn("_n", F.count("*").over(w))


def corrupted(facts: DataFrame, types: DataFrame, part: float = 0.01, kind: int = 1, seed: int = 42, tries: int = 4, exact: bool = False) -> DataFrame:
    """p, s, o: about `part` as many wrong facts as there are facts; drawn from floor(n * part) facts if `exact`.

    A fair coin picks the end to replace. Kind 1 takes any entity, kind 2 one with exactly the same types; the end's type set
    must be shared by another entity. Of `tries` draws the first that is not the entity itself and makes no fact counts; where
    none does, the fact gives no error."""
    if kind not in (1, 2):
        raise ValueError("kind is 1 or 2")
    drawn = (exact_share if exact else share)(facts, part, seed).withColumn("coin", stable_hash("p", "s", "o", seed=seed + 1) % 2)
    drawn = drawn.withColumn("e", F.when(F.col("coin") == 0, F.col("s")).otherwise(F.col("o")))
    sets = saved(type_sets(types), "sets")
    size = sets.groupBy("ts").agg(F.count("*").alias("n_same"))
    drawn = saved(drawn.join(sets, "e").join(size.filter("n_same > 1"), "ts"), "drawn")
    if kind == 2:
        pool = numbered(sets.withColumn("g", F.concat_ws(",", "ts")).select("e", "g"), ["g"])
        drawn = drawn.withColumn("g", F.concat_ws(",", "ts")).withColumn("_n", F.col("n_same"))
        on = ["g", "_i"]
    else:
        pool = ordinal_ranks(sets.select("e", stable_hash("e", seed=seed).cast("double").alias("h")), "h", ["e"], "_i").withColumn("_i", F.col("_i") - 1).select("e", "_i")
        drawn = drawn.withColumn("_n", F.lit(sets.count()))
        on = ["_i"]
    draws = drawn.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("_i", stable_hash("p", "s", "o", "try", seed=seed + 2) % F.col("_n"))
    got = draws.join(pool.select(F.col("e").alias("new"), *on), on).filter(F.col("new") != F.col("e"))
    got = got.select("p", F.when(F.col("coin") == 0, F.col("new")).otherwise(F.col("s")).alias("s2"), F.when(F.col("coin") == 0, F.col("o")).otherwise(F.col("new")).alias("o2"), "s", "o", "try")
    got = got.join(facts.select("p", F.col("s").alias("s2"), F.col("o").alias("o2")), ["p", "s2", "o2"], "left_anti")
    first = got.groupBy("p", "s", "o").agg(F.min(F.struct("try", "s2", "o2")).alias("x"))
    return first.select("p", F.col("x.s2").alias("s"), F.col("x.o2").alias("o")).distinct()


def with_errors(facts: DataFrame, errors: DataFrame) -> DataFrame:
    return facts.withColumn("is_error", F.lit(False)).unionByName(errors.withColumn("is_error", F.lit(True)))


def negatives(positives: DataFrame, facts: DataFrame, n_neg: int = 1, seed: int = 42, chain: bool = False, few: bool = False) -> DataFrame:
    """p, s, o: for each positive n_neg draws; a coin picks the end, which is replaced by the same end of another positive of
    the relation. Facts and duplicates go, so there may be fewer. With `chain` a draw starts from the outcome of the one before. `few`: the
    draws are few enough for every task, so that the facts are not shuffled to find those that are drawn."""
    pool = positives.withColumn("e", F.explode(F.array("s", "o"))).select("p", "e").distinct()
    pool = numbered(pool, ["p"])
    n = pool.groupBy("p").agg(F.max("_n").alias("_n"))
    pick = pool.select("p", "_i", F.col("e").alias("new"))
    first = positives.select("p", "s", "o", F.col("s").alias("_s"), F.col("o").alias("_o")).join(F.broadcast(n), "p")  # n: a row for each relation

    def draw(x: DataFrame) -> DataFrame:
        x = x.withColumn("coin", stable_hash("p", "s", "o", "k", seed=seed + 1) % 2).withColumn("_i", stable_hash("p", "s", "o", "k", seed=seed + 2) % F.col("_n")).join(pick, ["p", "_i"])
        return x.withColumn("_s", F.when(F.col("coin") == 0, F.col("new")).otherwise(F.col("_s"))).withColumn("_o", F.when(F.col("coin") == 0, F.col("_o")).otherwise(F.col("new"))).drop("coin", "_i", "new")

    if chain:
        steps = []
        for k in range(1, n_neg + 1):
            first = draw(first.withColumn("k", F.lit(k)))
            steps.append(first.select("p", F.col("_s").alias("s"), F.col("_o").alias("o")))
        out = reduce(DataFrame.unionByName, steps).distinct()
    else:
        out = draw(first.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n_neg))))).select("p", F.col("_s").alias("s"), F.col("_o").alias("o")).distinct()
    if few:
        out = saved(out, "drawn")
        facts = facts.join(F.broadcast(out), ["p", "s", "o"], "left_semi")
    return out.join(facts, ["p", "s", "o"], "left_anti")


def graded_negatives(positives: DataFrame, scored: DataFrame, entities: DataFrame, base: float = 1.25, seed: int = 42) -> DataFrame:
    """p, s, o: hard negatives for each subject of positives. scored (p, s, o, score) holds the entities that paths reach from a
    subject; ranked by score, from 0, those at the places floor(k * base**k) for k = 1, 2, ... are taken, or the next one that is
    not a positive. Beyond the last reached entity the places go on over all entities, with any entity that is not reached."""
    n = entities.count()
    places = [(k, int(k * base**k)) for k in range(1, 200) if int(k * base**k) < n]
    spark = positives.sparkSession
    subjects = positives.select("p", "s").distinct()
    w = Window.partitionBy("p", "s").orderBy(F.desc("score"), "o")
    true = positives.select("p", "s", "o").distinct().withColumn("_true", F.lit(True))
    rows = scored.join(subjects, ["p", "s"], "left_semi").join(true, ["p", "s", "o"], "left").withColumn("at", F.row_number().over(w) - 1)
    after = F.first(F.when(F.col("_true").isNull(), F.col("o")), ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    table = F.broadcast(spark.createDataFrame(places, "k int, at int"))  # fewer than 200 rows
    hard = rows.withColumn("neg", after).join(table, "at").filter("neg IS NOT NULL").select("p", "s", F.col("neg").alias("o")).distinct()
    reached = rows.groupBy("p", "s").agg(F.count("*").alias("reached"))
    all_ = numbered(entities.select("e").distinct(), [])
    rest = subjects.join(reached, ["p", "s"], "left").withColumn("reached", F.coalesce("reached", F.lit(0))).withColumn("one", F.lit(1))
    rest = rest.join(table.withColumn("one", F.lit(1)), "one").filter("at >= reached").withColumn("_i", stable_hash("p", "s", "k", seed=seed) % n)
    soft = rest.join(all_.select("_i", F.col("e").alias("o")), "_i").select("p", "s", "o").distinct().join(rows.select("p", "s", "o"), ["p", "s", "o"], "left_anti")
    return hard.unionByName(soft).distinct().join(true, ["p", "s", "o"], "left_anti")


def co_occurring_negatives(positives: DataFrame, facts: DataFrame, seed: int = 42) -> DataFrame:
    """p, s, o: the object becomes one that the subject has in some other relation, the one of least hash."""
    seen = facts.select("s", F.col("o").alias("new")).distinct()
    x = positives.join(seen, "s").filter(F.col("new") != F.col("o"))
    x = x.select("p", "s", F.col("o").alias("was"), F.col("new").alias("o")).join(facts, ["p", "s", "o"], "left_anti")
    first = x.groupBy("p", "s", "was").agg(F.min(F.struct(stable_hash("p", "s", "was", "o", seed=seed).alias("h"), "o")).alias("x"))
    return first.select("p", "s", F.col("x.o").alias("o")).distinct()


def examples(facts: DataFrame, k: int, n_neg: int = 1, seed: int = 42, n: dict | None = None) -> DataFrame:
    """p, s, o, label: positives of each relation and negatives made from them. n: the number of facts of each relation, if it is known."""
    pos = saved(drawn_per_relation(facts, k, seed, n) if n else per_relation(facts, k, seed), "positives")
    return pos.withColumn("label", F.lit(1)).unionByName(negatives(pos, facts, n_neg, seed, few=True).withColumn("label", F.lit(0)))

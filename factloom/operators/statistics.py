"""Counts and distributions of facts and types, and the models that need nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def relation_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("p").agg(F.count("*").alias("n"))


def endpoint_counts(facts: DataFrame) -> DataFrame:
    """p, n_subjects, n_objects: distinct ends, counted side by side so that each is one hash aggregation."""
    ends = facts.select("p", F.explode(F.array(F.struct(F.lit("s").alias("k"), F.col("s").alias("e")), F.struct(F.lit("o").alias("k"), F.col("o").alias("e")))).alias("x")).select("p", "x.k", "x.e").distinct()
    return ends.groupBy("p").agg(F.count_if(F.col("k") == "s").alias("n_subjects"), F.count_if(F.col("k") == "o").alias("n_objects"))


def inverse(facts: DataFrame) -> DataFrame:
    return facts.select(F.concat(F.lit("^"), "p").alias("p"), F.col("o").alias("s"), F.col("s").alias("o"))


def symmetric_relations(facts: DataFrame) -> DataFrame:
    """p, symmetric: true if each fact's inverse is a fact too."""
    back = facts.select("p", F.col("o").alias("s"), F.col("s").alias("o"), F.lit(1).alias("there"))
    return facts.join(back, ["p", "s", "o"], "left").groupBy("p").agg((F.count("*") == F.count("there")).alias("symmetric"))


def with_inverses(facts: DataFrame) -> DataFrame:
    """facts and the inverses of relations that are not symmetric."""
    odd = symmetric_relations(facts).filter(~F.col("symmetric")).select("p")
    return facts.unionByName(inverse(facts.join(odd, "p", "left_semi")))


def type_sets(types: DataFrame) -> DataFrame:
    """e, ts: each entity's types as a sorted array."""
    return types.groupBy("e").agg(F.sort_array(F.collect_set("t")).alias("ts"))


def type_groups(types: DataFrame) -> DataFrame:
    """ts, n: how many entities have exactly these types."""
    return type_sets(types).groupBy("ts").agg(F.count("*").alias("n"))


def omnipresent_types(types: DataFrame) -> DataFrame:
    """The types that every typed entity has."""
    n = types.select("e").distinct().groupBy().agg(F.count("*").alias("all_n"))
    return types.distinct().groupBy("t").agg(F.count("*").alias("n")).join(n, F.col("n") == F.col("all_n")).select("t")


def add_universal_type(entities: DataFrame, types: DataFrame, name: str) -> DataFrame:
    """If any entity has no type, every entity gets one more."""
    if entities.join(types, "e", "left_anti").isEmpty():
        return types
    return types.unionByName(entities.select("e", F.lit(name).alias("t")))


def by_type_set(facts: DataFrame, types: DataFrame, end: str = "o") -> DataFrame:
    """facts with ts, the sorted types of one end; an end without types has an empty array. One shuffle of the facts by that
    end; all that depends on types only is then computed for the few distinct (p, ts)."""
    sets = type_sets(types).withColumnRenamed("e", end)
    return facts.join(sets, end, "left").select("p", "s", "o", F.coalesce("ts", F.array().cast("array<string>")).alias("ts"))


def type_distribution(facts: DataFrame, types: DataFrame, end: str = "o") -> DataFrame:
    """p, t, w: facts of p whose end has type t, over all facts of all relations."""
    counts = by_type_set(facts, types, end).groupBy("p", "ts").agg(F.count("*").alias("n"))
    return _distribution(counts)


def _distribution(counts: DataFrame) -> DataFrame:
    n = counts.select("p", F.explode_outer("ts").alias("t"), "n")
    total = counts.agg(F.sum("n").alias("total"))
    return n.filter("t IS NOT NULL").groupBy("p", "t").agg(F.sum("n").alias("n")).join(F.broadcast(total), F.col("n") <= F.col("total")).select("p", "t", (F.col("n") / F.col("total")).alias("w"))  # total is one row


def relative_predicate_frequency(facts: DataFrame) -> DataFrame:
    """p, o, rpf: the share of p among the facts with object o."""
    n = facts.groupBy("o", "p").agg(F.count("*").alias("n"))
    return n.select("p", "o", (F.col("n") / F.sum("n").over(Window.partitionBy("o"))).alias("rpf"))


def agreement(pairs: DataFrame, types: DataFrame, w: DataFrame) -> DataFrame:
    """p, s, o, score of pairs: the cosine of the object's types with the weights w (p, t, w) of its relation, 0 if either is zero.
    It is computed for the few distinct (p, types)."""
    return _agreement(by_type_set(pairs, types), w)


def _agreement(f: DataFrame, w: DataFrame) -> DataFrame:
    norm = w.groupBy("p").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    kinds = f.select("p", "ts").distinct()
    hit = kinds.select("p", "ts", F.explode("ts").alias("t")).join(w, ["p", "t"]).groupBy("p", "ts").agg(F.sum("w").alias("hit"))
    score = hit.join(norm, "p").select("p", "ts", F.round(F.try_divide("hit", F.sqrt(F.size("ts")) * F.col("norm")), 9).alias("score"))
    return f.join(score, ["p", "ts"], "left").select("p", "s", "o", F.coalesce("score", F.lit(0.0)).alias("score"))


def type_agreement(facts: DataFrame, types: DataFrame) -> DataFrame:
    """p, s, o, score: the cosine of the object's types with the distribution of object types of p (0 if either is zero)."""
    f = by_type_set(facts, types)
    return _agreement(f, _distribution(f.groupBy("p", "ts").agg(F.count("*").alias("n"))))


def induced_ends(facts: DataFrame, types: DataFrame, end: str, conf: float = 0.95) -> DataFrame:
    """p, t, prob: of the types that more than conf of the distinct ends have, the one with fewest instances."""
    ends = facts.select("p", F.col(end).alias("e")).distinct()
    t = types.distinct()
    n = ends.groupBy("p").agg(F.count("*").alias("n"))
    has = ends.join(t, "e").groupBy("p", "t").agg(F.count("*").alias("k"))
    size = t.groupBy("t").agg(F.count("*").alias("instances"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("instances", "t"))
    good = has.join(n, "p").withColumn("prob", F.col("k") / F.col("n")).filter(F.col("prob") > conf).join(size, "t")
    return good.withColumn("k", rank).filter("k = 1").select("p", "t", "prob")


def domain_range_scores(facts: DataFrame, types: DataFrame, conf: float = 0.95, ends: dict[str, DataFrame] | None = None) -> DataFrame:
    """p, s, o, score: the lesser of both ends' parts: prob with the induced type, 1 - prob without, 1 if none is induced. ends: what
    induced_ends() gave for s and o, from the facts themselves by default."""
    out = facts
    for end in ("s", "o"):
        want = (ends[end] if ends else induced_ends(facts, types, end, conf)).select("p", F.col("t").alias("want"), "prob")
        sets = type_sets(types).withColumnRenamed("e", end)
        part = F.when(F.col("want").isNull(), 1.0).when(F.coalesce(F.array_contains("ts", F.col("want")), F.lit(False)), F.col("prob")).otherwise(1 - F.col("prob"))
        out = out.join(want, "p", "left").join(sets, end, "left").withColumn(f"_{end}", part).drop("want", "prob", "ts")
    return out.select("p", "s", "o", F.round(F.least("_s", "_o"), 9).alias("score"))


def outlier_scores(scores: DataFrame, per_relation: bool = True) -> DataFrame:
    """score below the mean becomes its distance in standard deviations (population), others 1. Over all relations the scores
    below the mean stay as they are. Where all scores of a relation are equal, the outcome is 1."""
    keys = ["p"] if per_relation else []
    stats = scores.groupBy(*keys).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("*").alias("n"))
    out = scores.join(stats, keys) if keys else scores.withColumn("_all", F.lit(1)).join(F.broadcast(stats.withColumn("_all", F.lit(1))), "_all")  # one row
    mean, std = F.when(F.col("n") > 1, F.round("mean", 9)).otherwise(1.0), F.when(F.col("n") > 1, F.round("std", 9)).otherwise(0.0)
    below = F.when(std == 0, 1.0).otherwise(F.try_divide(F.col("score") - mean, std)) if per_relation else F.col("score")
    return out.select("p", "s", "o", F.round(F.when(F.col("score") < mean, below).otherwise(1.0), 6).alias("score"))


def threshold(scores: DataFrame, least: float = 0.5) -> DataFrame:
    return scores.withColumn("label", (F.col("score") > least).cast("double"))

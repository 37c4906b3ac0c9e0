"""Proposals for wrong facts: better types of their ends, or another object of a similar name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.saved import saved
from . import evaluation, names

#: Detectors whose scores are probabilities, or cosines between 0 and 1.
PROBABILISTIC = ("sdv", "domran", "pabred", "tybred", "patybred")


def candidates(wrong: DataFrame, name_of: DataFrame, g, links: DataFrame | None = None, d: int = 2, subjects: bool = False) -> DataFrame:
    """p, s, o, end, cand, dist: other entities for the object (and the subject) of wrong facts. Legal ones have a type of the
    relation's domain or range where that is known, are at distance 2 or less, and do not make a fact."""
    out = []
    for end, schema in [("o", g.ranges), *([("s", g.domains)] if subjects or links is not None else [])]:
        parts = []
        if end == "o" or subjects:
            asked = wrong.select(F.col(end).alias("q")).distinct().join(name_of.withColumnRenamed("e", "q"), "q")
            parts.append(names.suggestions(asked, name_of, d).select(F.col("q").alias(end), F.col("e").alias("cand"), "dist"))
        if links is not None:
            parts.append(links.select(F.col("a").alias(end), F.col("b").alias("cand"), F.lit(1).cast("long").alias("dist")))
        c = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        c = c.groupBy(end, "cand").agg(F.min("dist").alias("dist"))
        x = wrong.select("p", "s", "o").join(c, end).filter((F.col("cand") != F.col(end)) & (F.col("dist") <= 2))
        if schema is not None:
            x = x.join((schema.select("p", F.col("t").alias("_want"))), "p", "left")
            fits = x.join(g.types.select(F.col("e").alias("cand"), F.col("t").alias("_want")), ["cand", "_want"], "left_semi").unionByName(x.filter("_want IS NULL"))
            x = fits.drop("_want")
        new = [F.col("cand").alias("s"), "o"] if end == "s" else ["s", F.col("cand").alias("o")]
        bad = x.select("p", *new, F.struct("p", "s", "o", "cand", "dist").alias("x")).join(g.facts, ["p", "s", "o"], "left_anti").select("x.*")
        out.append(bad.select("p", "s", "o", F.lit(end).alias("end"), "cand", "dist"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def accepted(scored: DataFrame, gain: float = 1.5, least: float = 0.75) -> DataFrame:
    """The best candidate of each fact (p, s, o, score, cand, cand_score, dist): a score of gain times the fact's at least, and
    above `least`; equal scores by distance, then by name. A fact with score 0 needs only the second."""
    good = scored.filter((F.col("cand_score") > least) & (F.col("cand_score") >= gain * F.col("score")))
    rank = F.row_number().over(Window.partitionBy("p", "s", "o").orderBy(F.desc("cand_score"), "dist", "cand"))
    return good.withColumn("_k", rank).filter("_k = 1").drop("_k")


def several_types(types: DataFrame, end: str) -> DataFrame:
    return types.groupBy(F.col("e").alias(end)).agg(F.count("*").alias("n")).filter("n > 1").select(end)


def correct(scores: DataFrame, g, detector, name_of: DataFrame, part: float = 0.01, gain: float = 1.5, links: DataFrame | None = None, subjects: bool = False, predicted_types: DataFrame | None = None, d: int = 2) -> DataFrame:
    """p, s, o, score, kind (type or entity), end, cand, cand_score, dist for the worst `part` of the facts. A repair of types
    that gains enough goes before another entity, the subject's before the object's."""
    wrong = saved(evaluation.worst(scores, part).select("p", "s", "o", "score"), "worst")
    found = saved(candidates(wrong, name_of, g, links, d, subjects), "candidates")
    eligible = found.filter("end = 'o'").join(several_types(g.types, "o"), "o", "left_semi").unionByName(found.filter("end = 's'").join(several_types(g.types, "s"), "s", "left_semi").select(found.columns) if "s" in found.columns else found.limit(0))
    made = saved(eligible.select("*", F.when(F.col("end") == "s", F.col("cand")).otherwise(F.col("s")).alias("s2"), F.when(F.col("end") == "o", F.col("cand")).otherwise(F.col("o")).alias("o2")), "made")
    judged = saved(detector.score(made.select("p", F.col("s2").alias("s"), F.col("o2").alias("o")).distinct()), "judged").withColumnsRenamed({"s": "s2", "o": "o2", "score": "cand_score"})
    best = accepted(made.join(judged, ["p", "s2", "o2"]).join(wrong, ["p", "s", "o"]), gain)
    out = best.select("p", "s", "o", "score", F.lit("entity").alias("kind"), "end", "cand", "cand_score", "dist")
    if predicted_types is None:
        return out
    fixed = type_repairs(wrong, g, detector, predicted_types, gain)
    return fixed.unionByName(out.join(fixed, ["p", "s", "o"], "left_anti"))


def type_repairs(wrong: DataFrame, g, detector, predicted_types: DataFrame, gain: float = 1.5) -> DataFrame:
    """Facts that score enough better if one end had its predicted types; the graph itself does not change."""
    from copy import copy

    out = []
    for k, end in enumerate(("s", "o")):
        ends = wrong.select(F.col(end).alias("e")).distinct()
        own = predicted_types.join(ends, "e", "left_semi")
        trial = copy(detector)
        types = g.types.join(own.select("e").distinct(), "e", "left_anti").unionByName(own.select("e", "t"))
        trial.types = types
        if hasattr(trial, "g"):
            trial.g = copy(g)
            trial.g.types = types
        better = trial.score(wrong.join(own.select(F.col("e").alias(end)).distinct(), end, "left_semi").select("p", "s", "o")).withColumnRenamed("score", "cand_score")
        x = wrong.join(better, ["p", "s", "o"]).filter((F.col("cand_score") > 0.75) & (F.col("cand_score") >= gain * F.col("score")))
        out.append(x.select("p", "s", "o", "score", F.lit("type").alias("kind"), F.lit(end).alias("end"), F.col(end).alias("cand"), "cand_score", F.lit(k).cast("long").alias("dist")))
    both = out[0].unionByName(out[1])
    rank = F.row_number().over(Window.partitionBy("p", "s", "o").orderBy("dist"))
    return both.withColumn("_k", rank).filter("_k = 1").drop("_k").withColumn("dist", F.lit(0).cast("long"))

"""Scores of a stream of new facts with a fitted, static model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.statistics import type_distribution, type_sets


def agreement_model(facts: DataFrame, types: DataFrame) -> DataFrame:
    """p, w (map of type to weight) and norm: a row for each relation."""
    w = type_distribution(facts, types)
    return w.groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("t", "w"))).alias("w"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def score_stream(stream: DataFrame, types: DataFrame, model: DataFrame) -> DataFrame:
    """stream (p, s, o) with score: stateless joins of the stream with static tables."""
    x = stream.join(type_sets(types).withColumnRenamed("e", "o"), "o", "left").join(model, "p", "left")
    hit = F.aggregate("ts", F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at("w", t), F.lit(0.0)))
    return x.select("p", "s", "o", F.round(F.coalesce(F.try_divide(hit, F.sqrt(F.size("ts")) * F.col("norm")), F.lit(0.0)), 9).alias("score"))


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of N-Triples files as they arrive."""
    from ..sources.triples import parse

    return parse(spark.readStream.text(folder))

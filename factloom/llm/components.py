"""Distributed connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v and component, the smallest vertex that v reaches, for every vertex of an edge.

    Each round points every vertex at its smallest neighbour, follows the pointers once, and contracts the edges by them, so
    a star vanishes in one round and a path shrinks by a constant factor. All state is tables; nothing reaches the driver but
    the number of edges left. Null ends and loops are dropped.
    """
    left = saved(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        near = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p"))
        near = saved(near, "near")
        up = near.select(F.col("v").alias("p"), F.col("p").alias("q"))
        step = saved(near.join(up, "p").select("v", F.col("q").alias("p")), "step")
        steps.append(step)
        for end in ("a", "b"):
            left = left.join(step.withColumnRenamed("v", end), end).drop(end).withColumnRenamed("p", end)
        left = saved(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    if not steps:
        return left.select(F.col("a").alias("v"), F.col("b").alias("component"))
    out = steps[0].withColumnRenamed("p", "component")
    for step in steps[1:]:
        nxt = step.select(F.col("v").alias("component"), F.col("p").alias("further"))
        out = out.join(nxt, "component", "left").select("v", F.coalesce("further", "component").alias("component"))
    return out

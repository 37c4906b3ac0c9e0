"""Schema reasoning: closures of hierarchies, inherited types and facts, equivalences, domains and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.saved import saved
from ..model import Graph


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """All pairs of a node and a node above it, by squaring: each round joins the pairs found with themselves, so the number
    of rounds is the logarithm of the longest chain. Cycles end it as no pair is new; self-pairs are left out."""
    found = saved(edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).filter("child <> parent").distinct(), "closure")
    n = found.count()
    while True:
        up = found.select(F.col("child").alias("parent"), F.col("parent").alias("top"))
        more = found.join(up, "parent").select("child", F.col("top").alias("parent")).filter("child <> parent")
        longer = saved(found.unionByName(more).distinct(), "closure")
        if (m := longer.count()) == n:
            return found
        found, n = longer, m


def inherited_types(types: DataFrame, subclass: DataFrame) -> DataFrame:
    up = closure(subclass)
    return types.unionByName(types.join(up.withColumnRenamed("child", "t"), "t").select("e", F.col("parent").alias("t"))).distinct()


def inherited_facts(facts: DataFrame, subproperty: DataFrame) -> DataFrame:
    up = closure(subproperty)
    return facts.unionByName(facts.join(up.withColumnRenamed("child", "p"), "p").select(F.col("parent").alias("p"), "s", "o")).distinct()


def domain_range_types(facts: DataFrame, types: DataFrame, domains: DataFrame, ranges: DataFrame) -> DataFrame:
    """types and those that domains give to subjects, ranges to objects."""
    s = facts.join(domains, "p").select(F.col("s").alias("e"), "t")
    o = facts.join(ranges, "p").select(F.col("o").alias("e"), "t")
    return types.unionByName(s).unionByName(o).distinct()


def equivalent_types(types: DataFrame, equiv: DataFrame, pairwise: bool = False) -> DataFrame:
    """types and those equivalent to them, through chains unless pairwise."""
    both = equiv.select("t1", "t2").unionByName(equiv.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"))).distinct()
    if not pairwise:
        both = closure(both, "t1", "t2").toDF("t1", "t2")
    return types.unionByName(types.join(both.withColumnRenamed("t1", "t"), "t").select("e", F.col("t2").alias("t"))).distinct()


def with_type_facts(facts: DataFrame, types: DataFrame, relation: str = "rdf:type", prefix: str = "type:") -> DataFrame:
    """facts and a fact for each type of an entity, as training data of embeddings."""
    return facts.select("p", "s", "o").unionByName(types.select(F.lit(relation).alias("p"), F.col("e").alias("s"), F.concat(F.lit(prefix), "t").alias("o")))


def roots(edges: DataFrame) -> DataFrame:
    """Nodes without a parent."""
    e = edges.filter("child <> parent")
    return e.select(F.col("parent").alias("node")).distinct().join(e.select(F.col("child").alias("node")), "node", "left_anti")


def levels(edges: DataFrame) -> DataFrame:
    """node, level: the least number of steps from a root; a level is found from the one before it."""
    e = saved(edges.filter("child <> parent").distinct(), "edges")
    out = frontier = saved(roots(e).withColumn("level", F.lit(0)), "level")
    k = 0
    while True:
        k += 1
        nxt = saved(frontier.join(e.withColumnRenamed("parent", "node"), "node").select(F.col("child").alias("node")).distinct().join(out, "node", "left_anti").withColumn("level", F.lit(k)), "level")
        if nxt.isEmpty():
            return out
        out, frontier = out.unionByName(nxt), nxt


def tree(edges: DataFrame) -> DataFrame:
    """Each node's least parent only."""
    return edges.filter("child <> parent").groupBy("child").agg(F.min("parent").alias("parent"))


def reason(g: Graph, types: bool = False, properties: bool = False, ends: bool = False) -> Graph:
    """Equivalences, then domains and ranges, then superclasses, then superproperties."""
    t, f = g.types, g.facts
    if g.equiv is not None:
        t = equivalent_types(t, g.equiv)
    if ends and g.domains is not None and g.ranges is not None:
        t = domain_range_types(f, t, g.domains, g.ranges)
    if types and g.subclass is not None:
        t = inherited_types(t, g.subclass)
    if properties and g.subproperty is not None:
        f = inherited_facts(f, g.subproperty)
    return Graph(f, t, g.subclass, g.subproperty, g.domains, g.ranges, g.equiv)

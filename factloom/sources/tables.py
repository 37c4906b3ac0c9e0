"""Relational tables read as a knowledge graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph

#: relation: table, subject kind and column, object kind and column, domain, range.
RELATIONS = {
    "placedBy": ("orders", "order", "o_orderkey", "customer", "o_custkey", "Order", "Customer"),
    "hasPart": ("lineitem", "order", "l_orderkey", "part", "l_partkey", "Order", "Part"),
    "shippedBy": ("lineitem", "order", "l_orderkey", "supplier", "l_suppkey", "Order", "Supplier"),
    "suppliedBy": ("lineitem", "part", "l_partkey", "supplier", "l_suppkey", "Part", "Supplier"),
    "custNation": ("customer", "customer", "c_custkey", "nation", "c_nationkey", "Customer", "Nation"),
    "suppNation": ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "Supplier", "Nation"),
    "inRegion": ("nation", "nation", "n_nationkey", "region", "n_regionkey", "Nation", "Region"),
}
#: class: table, entity kind, key column, column of the subclass.
CLASSES = {
    "Order": ("orders", "order", "o_orderkey", "o_orderstatus"),
    "Customer": ("customer", "customer", "c_custkey", "c_mktsegment"),
    "Part": ("part", "part", "p_partkey", "p_type"),
    "Supplier": ("supplier", "supplier", "s_suppkey", None),
    "Nation": ("nation", "nation", "n_nationkey", None),
    "Region": ("region", "region", "r_regionkey", None),
}


def _key(kind: str, column: str) -> F.Column:
    return F.concat(F.lit(f"{kind}/"), F.col(column).cast("string"))


def facts(spark: SparkSession, sf_dir: str, relations: list[str] | None = None) -> DataFrame:
    """p, s, o as a set. Duplicates can only arise within a relation; each table is read once, and its keys are made distinct as
    numbers, all its relations together."""
    by_table: dict[str, list[str]] = {}
    for p in relations or RELATIONS:
        by_table.setdefault(RELATIONS[p][0], []).append(p)
    parts = []
    for table, own in by_table.items():
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        keys = F.array(*(F.struct(F.lit(k).alias("k"), F.col(RELATIONS[p][2]).cast("long").alias("a"), F.col(RELATIONS[p][4]).cast("long").alias("b")) for k, p in enumerate(own)))
        rows = df.select(F.explode(keys).alias("x")).select("x.k", "x.a", "x.b").distinct()
        name = lambda k, side: F.element_at(F.array(*(F.lit(f"{RELATIONS[p][side]}/") for p in own)), k + 1)
        parts.append(rows.select(F.element_at(F.array(*map(F.lit, own)), F.col("k") + 1).alias("p"), F.concat(name(F.col("k"), 1), F.col("a").cast("string")).alias("s"), F.concat(name(F.col("k"), 3), F.col("b").cast("string")).alias("o")))
    return reduce(DataFrame.unionByName, parts)


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """e, t: the table's class and the subclass that a column names."""
    parts = []
    for c, (table, kind, key, sub) in CLASSES.items():
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        names = F.array(F.lit(c), *([F.concat(F.lit(f"{c}:"), F.col(sub))] if sub else []))
        parts.append(df.select(_key(kind, key).alias("e"), F.explode(names).alias("t")))
    return reduce(DataFrame.unionByName, parts)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = types(spark, sf_dir)
    known = t.select("t").distinct()
    sub = known.filter("t LIKE '%:%'").select(F.col("t").alias("child"), F.split("t", ":")[0].alias("parent"))
    top = known.filter("t NOT LIKE '%:%'").select(F.col("t").alias("child"), F.lit("Thing").alias("parent"))
    ends = [[(p, r[k]) for p, r in RELATIONS.items()] for k in (5, 6)]
    domains, ranges = (spark.createDataFrame(x, "p string, t string") for x in ends)
    return Graph(facts(spark, sf_dir), t, sub.unionByName(top), None, domains, ranges)

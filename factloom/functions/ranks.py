"""Ranks and running sums over whole tables, without a task that sees all rows.

Rows are sorted by range partitions and written with their number in their partition; the sums of the partitions, one row each,
are added up and joined back. Ranges are cut by all columns of the order, so that many rows of one value are spread as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .saved import saved

#: A row's number is its partition's times 2**PLACE, plus its place there.
PLACE = 33


def _sorted(df: DataFrame, by: list) -> DataFrame:
    """A table of df in ascending order, nulls last, with _m (ascending) and _part."""
    order = [F.col(c).asc_nulls_last() for c in by]
    rows = saved(df, "unsorted").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    return saved(rows, "sorted").withColumn("_part", F.shiftright("_m", PLACE))


def _before(sums: DataFrame, values: list[str]) -> DataFrame:
    """_part and, for each value, what the partitions before it and all partitions hold. A row for each partition."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.broadcast(sums.select("_part", *(F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_b_{v}") for v in values), *(F.sum(v).over(every).alias(f"all_{v}") for v in values)))


def running_sums(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """df (one row for each value of order) with cum_<value>: sums up to and with each row in ascending order, nulls last, and
    all_<value>."""
    rows = _sorted(df, [order])
    before = _before(rows.groupBy("_part").agg(*(F.sum(v).alias(v) for v in values)), values)
    inside = Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(before, "_part")
    return out.select(*df.columns, *((F.sum(v).over(inside) + F.col(f"_b_{v}")).alias(f"cum_{v}") for v in values), *(f"all_{v}" for v in values))


def average_ranks(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """df with the mean rank of equal values, ascending from 1; nulls are equal and come last. Counts by value are summed, then
    joined back."""
    df = saved(df, "values")
    n = running_sums(df.groupBy(order).agg(F.count("*").alias("n")), order, ["n"])
    rank = n.select(F.col(order).alias("_v"), (F.col("cum_n") - (F.col("n") - 1) / 2).alias(name))
    return df.join(rank, F.col(order).eqNullSafe(F.col("_v"))).drop("_v")


def ordinal_ranks(df: DataFrame, order: str, ties: list[str], name: str = "rank") -> DataFrame:
    """df with row numbers from 1 by order, nulls last, and, among equals, by the columns of ties."""
    rows = _sorted(df, [order, *ties])
    before = _before(rows.groupBy("_part").agg(F.count("*").alias("n")), ["n"])
    place = F.col("_m").bitwiseAND(F.lit((1 << PLACE) - 1))
    return rows.join(before, "_part").select(*df.columns, (F.col("_b_n") + place + 1).alias(name))


def neighbours(values: DataFrame, asked: DataFrame, column: str = "x") -> DataFrame:
    """x, floor, ceiling for each distinct value that is asked for: the greatest value that is not above it, and the least that is
    not below it; null where there is none. Found inside sorted ranges, with the first and last values of the other ranges."""
    both = values.select(F.col(column).alias("x"), F.lit(1).alias("v"), F.lit(0).alias("a")).unionByName(asked.select(F.col(column).alias("x"), F.lit(0).alias("v"), F.lit(1).alias("a")))
    rows = _sorted(both.filter("x IS NOT NULL").groupBy("x").agg(F.max("v").alias("v"), F.max("a").alias("a")), ["x"])
    own = F.when(F.col("v") == 1, F.col("x"))
    part = rows.groupBy("_part").agg(F.max(own).alias("hi"), F.min(own).alias("lo"))
    w = Window.orderBy("_part")
    part = part.select("_part", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("hi"), F.min("lo").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("lo"))
    inside = Window.partitionBy("_part").orderBy("_m")
    down = F.last(own, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    up = F.first(own, ignorenulls=True).over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = rows.join(F.broadcast(part), "_part")  # a row for each partition
    return out.select("x", F.coalesce(down, "hi").alias("floor"), F.coalesce(up, "lo").alias("ceiling"), "a").filter("a = 1").drop("a")

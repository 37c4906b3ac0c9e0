"""Exact top-k search in binary codes by incremental multi-index hashing.

A 64-bit code is cut into s segments, and each segment indexes the codes. After all segments were searched to radius r, every
code within s * (r + 1) - 1 bits of a query has been met: search radii grow until the kth verified distance lies within that.
A code is taken in the first segment where it is nearest to the query, so it is met once in all. Equal codes are searched
once. Neighbours are ordered by distance and then by id; where fewer than k others exist, all of them are returned.

Vectors that are null, empty, or hold null or non-finite components have no code and take no part. A table without rows gives
no rows; further columns are ignored. Ids are taken as unique.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, EVERY, WIDTH = 10, 20, 64


def sign_code(vector: str) -> Column:
    """Bit i is set where the components at i, i + 64, ... have a positive sum; null without finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    at = lambda i: F.filter(vector, lambda _, k: k % WIDTH == i)
    bit = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.when(F.aggregate(at(i), F.lit(0.0), lambda a, x: a + x) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    plain = F.transform(F.col(vector), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    folded = F.transform(bit, lambda x, i: F.call_function("shiftleft", x, i))
    bits = F.when(F.size(vector) <= WIDTH, plain).otherwise(folded)
    return F.when((F.size(vector) > 0) & finite, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def segments(n: int) -> list[tuple[int, int]]:
    """Start and width of segments of about log2(n) bits."""
    s = min(8, max(2, math.ceil(WIDTH / math.log2(max(n, 4)))))
    ends = [round(WIDTH * i / s) for i in range(s + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]  # noqa: B905


def part(code: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(code, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def search(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """codes: id, code; queries: query_id, code -> query_id, rank, neighbor_id, distance. A query is not its own neighbour."""
    spark, most = codes.sparkSession, k + 1
    codes, queries = codes.filter("code IS NOT NULL"), queries.filter("code IS NOT NULL")
    w = Window.partitionBy("code").orderBy("id")
    kept = codes.select("code", "id").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    kept = common.saved(kept, "codes")
    total = kept.select(F.size("ids").alias("n")).agg(F.sum("n")).first()[0] or 0
    cut = segments(kept.count())
    index = common.saved(kept.select(F.col("code").alias("c"), "ids", F.posexplode(F.array(*(part(F.col("code"), a, b) for a, b in cut))).alias("s", "key")), "index")
    active = common.saved(queries.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(WIDTH)), "queries")
    best = spark.createDataFrame([], "q long, distance int, id long")
    done: list[DataFrame] = []
    gap = lambda a, b: [F.bit_count(part(F.col(a).bitwiseXOR(F.col(b)), x, y)) for x, y in cut]
    for r in range(max(b for _, b in cut) + 1):
        # the flips of r bits within each segment: a table whose size depends on r and the segments' widths only
        masks = spark.createDataFrame([(s, sum(1 << i for i in c)) for s, (_, b) in enumerate(cut) for c in combinations(range(b), r)], "s int, mask long")
        probes = active.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(len(cut) - 1)))).join(F.broadcast(masks), "s").withColumn("key", F.element_at(F.array(*(part(F.col("q"), a, b) for a, b in cut)), F.col("s") + 1).bitwiseXOR(F.col("mask")))
        near = probes.join(index, ["s", "key"]).withColumn("distance", F.bit_count(F.col("q").bitwiseXOR(F.col("c")))).filter("distance <= bound")
        gaps = gap("q", "c")
        first = F.array_position(F.array(*gaps), F.array_min(F.array(*gaps))) - 1
        found = near.filter(F.col("s") == first).select("q", "distance", F.explode("ids").alias("id")).unionByName(best)
        top = Window.partitionBy("q").orderBy("distance", "id")
        best = common.saved(found.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= most).drop("r"), "best")
        reach = len(cut) * (r + 1) - 1
        state = best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        state = common.saved(active.select("q").join(state, "q", "left").select("q", F.when(F.col("n") >= min(most, total), F.col("far")).otherwise(WIDTH).alias("bound")), "state")
        ready = F.col("bound") <= reach
        done.append(best.join(state.filter(ready), "q", "left_semi"))
        active = state.filter(~ready)
        best = best.join(active, "q", "left_semi")
        if active.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    pairs = queries.select("query_id", F.col("code").alias("q")).join(out, "q").filter("id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("neighbor_id"), "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every row whose id is divisible by 20, among all rows."""
    codes = common.saved(common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code")), "signs")
    return search(codes, codes.filter(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
    list_sum(list_transform(range(1, 65), lambda i: (q.b[i] <> v.b[i])::INT))::INT AS distance
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM p
)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""

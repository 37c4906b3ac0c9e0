"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, distributed components.

Vectors of one label (and one number of components) whose signs agree for all hyperplanes of some table are compared exactly,
in double precision; pairs at the threshold or above are linked. Equal vectors are compared once and counted with their
multiplicity. Buckets are compared in blocks, pair by pair of blocks, and give counts and spanning links, never all pairs.

Vectors that are null, zero, or hold null or non-finite components, and those without a label, link with nothing: they have no
links and are their own component. Rows that repeat a vec_id, and rows without one, count as different vectors; a component has
its smallest vec_id, none if all of its rows have none, and keeps one row. A table without rows gives no rows; further columns
are ignored. The number of hyperplanes grows with the largest label, so that a bucket of unlike vectors stays small, and that of
tables with it, for the same recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common
from .components import components

#: Threshold; hyperplanes in each table, at least and at most; the probability that a pair at the threshold shares no bucket.
COSINE, BITS, MOST_BITS, MISS, BLOCK, SEED = 0.98, 16, 30, 0.0002, 512, 7


def usable(vector: str) -> Column:
    """True if a vector is not null, not empty, and all its components are finite numbers, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(col: pa.Array, d: int) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, d)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def tables_for(n: int, least: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Tables and hyperplanes in each, for n vectors with one label."""
    bits = min(MOST_BITS, max(BITS, math.ceil(math.log2(max(n, 1)))))
    together = (1 - math.acos(least) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-together)), bits


def hashed(df: DataFrame, tables: int, bits: int, seed: int = SEED) -> DataFrame:
    """Adds keys: array<int>, the signs in each table. df: rep, label, d, n, vector, label not null and vectors usable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("d").to_numpy()
            keys = np.zeros((len(dims), tables), np.int32)
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, tables * bits))
                rows = np.flatnonzero(dims == d)
                for at in range(0, len(rows), 2048):
                    own = rows[at : at + 2048]
                    sign = matrix(batch.column("vector").take(pa.array(own)), d) @ planes[d] > 0
                    keys[own] = sign.reshape(-1, tables, bits) @ (1 << np.arange(bits, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int32()))], [*batch.schema.names, "keys"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(common.lean(run), f"{schema}, keys array<int>")


def links(unique: DataFrame, least: float = COSINE, block: int = BLOCK) -> DataFrame:
    """rep, links (how many other vectors it links with, in this pair of blocks) and root (a vector it is connected with)."""
    most = unique.groupBy("label", "d").count().agg(F.max("count")).first()[0] or 0
    tables, bits = tables_for(most, least)
    hashes = common.saved(hashed(unique, tables, bits), "hashed")
    keys = hashes.select("rep", "label", "d", F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "d", "t", "key"]
    found = blocks.candidates(keys, bucket).join(hashes.select("rep", "n", "vector", "keys"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in blocks.groups(batches, [*bucket, "i", "j"]):
            d, t, i, j = (g.column(c)[0].as_py() for c in ("d", "t", "i", "j"))
            x = unit(matrix(g.column("vector"), d))
            near = x @ x.T >= least
            np.fill_diagonal(near, False)
            if i != j:
                own = g.column("own").to_numpy()
                near &= own[:, None] != own[None, :]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            keys = matrix(g.column("keys"), tables)[:, :t]
            new = np.concatenate([~(keys[a[s : s + 65536]] == keys[b[s : s + 65536]]).any(axis=1) for s in range(0, len(a), 65536)])  # else an earlier table has the pair
            rep, n = g.column("rep").to_numpy(), g.column("n").to_numpy()
            count = np.bincount(a[new], weights=n[b[new]], minlength=len(rep)).astype(np.int64)
            root = blocks.local_components(near)
            keep = near.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array(count[keep]), pa.array(rep[root[keep]])], ["rep", "links", "root"])

    return blocks.paired(found, bucket, "rep", block).mapInArrow(common.lean(run), "rep long, links long, root long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id, kept."""
    numbered, plain = common.numbered(df.select(key, vector, label), key)
    rows = numbered.select(F.col("_doc").alias("id"), F.col("c1").alias("vector"), F.col("c2").alias("label"))
    good = usable("vector") & F.col("label").isNotNull()
    with common.scratch(df.sparkSession, "unique", "counts", "all_components"):
        unique = common.saved(rows.filter(good).groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.size("vector").alias("d")).select("rep", "label", "d", "n", "vector"), "unique")
        found = common.saved(links(unique), "links")
        count = common.saved(found.groupBy("rep").agg(F.sum("links").alias("links")), "counts")
        of = common.saved(components(found, "rep", "root").withColumnRenamed("v", "rep"), "all_components")
    known = unique.join(count, "rep", "left").join(of, "rep", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    member = rows.filter(good).join(known, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = member.unionByName(alone).withColumn("kept", F.col("id") == F.col("component_id"))
    if not plain:
        keys = numbered.select(F.col("_doc").alias("id"), F.col("c0").alias(key))
        first = keys.select(F.col("id").alias("component_id"), F.col(key).alias("first"))
        return out.join(first, "component_id").join(keys, "id").select(key, "n_links", F.col("first").alias("component_id"), "kept")
    kind = numbered.schema["c0"].dataType
    return out.select(F.col("id").cast(kind).alias(key), "n_links", F.col("component_id").cast(kind), "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))

"""Compares the rows of a bucket with each other in blocks, so that no task holds more than two blocks of a hot bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(rows: DataFrame, bucket: list[str]) -> DataFrame:
    """rows of buckets that hold two rows at least, with the bucket's size as n_bucket."""
    size = rows.groupBy(*bucket).agg(F.count("*").alias("n_bucket")).filter("n_bucket > 1")
    return rows.join(size, bucket)


def paired(rows: DataFrame, bucket: list[str], key: str, block: int) -> DataFrame:
    """Each row once for each pair of blocks (i <= j) that its own block (own) is in, sorted by bucket and pair. A bucket has
    one block for each `block` rows; the hash of key says which."""
    n = F.ceil(F.col("n_bucket") / block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64(key), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "n_bucket")
    return rows.repartition(*bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys in sorted batches, each whole."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if batch.num_rows else held
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(new)
        at = 0
        for cut in cuts.tolist():
            yield batch.slice(at, cut - at)
            at = cut
        held = batch.slice(at)
    if held is not None:
        yield held


def local_components(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row that it reaches."""
    n = len(links)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(links, label[None, :], n).min(axis=1, initial=n))
        low = low[low]
        if (low == label).all():
            return label
        label = low

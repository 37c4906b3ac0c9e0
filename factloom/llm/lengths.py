"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over the histogram then answer totals, quantiles and truncated totals
for every context limit. Null text counts as empty (length 0); a table without rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bytebpe import CHUNK, vocabulary_path
from .pretoken import rank_pieces

WIDTH = 1024


def histogram(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """length and n_docs: how many texts have so many tokens. Counted in each batch, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = rank_pieces(path)
        for batch in batches:
            sizes = [np.zeros(0, np.int64)]
            for part in common.text_chunks(batch, "t", CHUNK):
                sizes.append(np.array([len(x) // 4 for x in pieces.ids([x or "" for x in part.column("t").to_pylist()])], np.int64))
            length, n = np.unique(np.concatenate(sizes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], ["length", "n"])

    return df.select(F.col(text).alias("t")).mapInArrow(common.lean(run), "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L as context limit: documents and tokens at L or more, tokens with documents cut at L, and the share of
    documents that are not cut. Sums run inside bands of WIDTH lengths and over the totals of the bands after them."""
    hist = hist.withColumn("band", F.floor(F.col("length") / WIDTH)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    bands = hist.groupBy("band").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = bands.select("band", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in ("bd", "bt")), *(F.sum(c).over(every).alias(f"all_{c}") for c in ("bd", "bt")))
    inside = Window.partitionBy("band").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = hist.join(bands, "band").withColumn("docs_from", F.sum("n_docs").over(inside) + F.col("later_bd")).withColumn("tokens_from", F.sum("tokens").over(inside) + F.col("later_bt"))
    return out.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        "docs_from",
        "tokens_from",
        F.col("all_bt").alias("total_tokens"),
        (F.col("all_bt") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"),
        ((F.col("all_bd") - F.col("docs_from") + F.col("n_docs")) / F.col("all_bd")).alias("share_whole"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that a share q of the documents does not exceed."""
    return sums.filter(F.col("share_whole") >= q).agg(F.min("context_limit").alias("length"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = common.saved(histogram(common.table(spark, sf_dir, "documents"), vocabulary_path()), "lengths")
    return suffix_sums(hist)

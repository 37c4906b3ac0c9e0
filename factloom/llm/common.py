"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
#: Tables saved within the innermost scratch(): tag and path.
_TABLES: ContextVar[list[tuple[str, str]] | None] = ContextVar("tables", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only in local mode where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="factloom-")
    return _OWN_DIR[app]


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (tables := _TABLES.get()) is not None:
        tables.append((tag, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Deletes the tables that are saved within in the end, but those with a tag in keep, which an outer scratch() gets."""
    own: list[tuple[str, str]] = []
    outer = _TABLES.get()
    token = _TABLES.set(own)
    try:
        yield
    finally:
        _TABLES.reset(token)
        for tag, path in own:
            if tag not in keep:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            elif outer is not None:
                outer.append((tag, path))


def numbered(docs: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """_doc, a number of its own for each row in the order of key, and all columns of docs as c0, c1, ...; and if _doc is the key.

    It is where keys are whole numbers without repeats and nulls. Else rows are sorted by key, nulls last, and by a random number,
    and written with their number: a hot key is spread over many ranges."""
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    own = F.col(f"c{docs.columns.index(key)}")
    if docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        if inner.groupBy(own.alias("k")).agg(F.count("*").alias("n")).filter("n > 1 OR k IS NULL").isEmpty():
            return inner.select(own.cast("long").alias("_doc"), "*"), True
    order = (own.asc_nulls_last(), F.col("_r"))
    rows = inner.withColumn("_r", F.rand(7)).repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(rows.select(F.monotonically_increasing_id().alias("_doc"), *inner.columns), "numbered"), False


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; at the end of a task its worker, which waits for the next one, gives free memory back to the system."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1, offset=8 * col.offset)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def row_chunks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to limit at most; a row over the limit stands alone."""
    ends = np.cumsum(sizes)
    lo, base = 0, 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield lo, hi
        base, lo = int(ends[hi - 1]), hi


def text_chunks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of text bytes each."""
    col = batch.column(column)
    if not len(col):
        return
    _, off = byte_view(col)
    for lo, hi in row_chunks(np.diff(off), limit):
        yield batch.slice(lo, hi - lo)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

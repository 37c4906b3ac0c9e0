"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Spark's setting that the shuffle files of a query go when it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, which may go once the application has ended; one of our own, removed
    at exit, only in local mode where that is not set."""
    app = spark.sparkContext.applicationId
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return f"{shared.rstrip('/')}/factloom-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return _OWN[app]


def saved(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Writes df as a table and reads it again: it is computed once, its lineage ends, its shuffle files go at once, and lost
    executors do not matter."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, "false")
    conf.set(CLEAN, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        conf.set(CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)

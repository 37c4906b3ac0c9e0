"""The data model: a knowledge graph is a set of tables. Keys may be numbers or strings; operators only compare them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Graph:
    """facts(p, s, o), types(e, t), subclass(child, parent), subproperty(child, parent), domains(p, t), ranges(p, t), equiv(t1, t2)."""

    facts: DataFrame
    types: DataFrame
    subclass: DataFrame | None = None
    subproperty: DataFrame | None = None
    domains: DataFrame | None = None
    ranges: DataFrame | None = None
    equiv: DataFrame | None = None

    def write(self, path: str) -> None:
        """One Parquet table each; facts are partitioned by relation, so that a scan of one relation reads it alone."""
        for f in fields(self):
            if (df := getattr(self, f.name)) is not None:
                w = df.write.mode("overwrite")
                (w.partitionBy("p") if f.name == "facts" else w).parquet(f"{path}/{f.name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Graph:
        """What write() left; tables that are absent stay None."""
        from pyspark.errors import AnalysisException

        out = {}
        for f in fields(cls):
            try:
                out[f.name] = spark.read.parquet(f"{path}/{f.name}")
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e) or f.name in ("facts", "types"):
                    raise
        return cls(**out)

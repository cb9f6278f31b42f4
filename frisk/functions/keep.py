"""Materialising an intermediate result where every executor can read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def folder(spark: SparkSession) -> str:
    """A fresh folder under the session's shared one."""
    return f"{_shared(spark)}/frisk-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    global _local
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        _local = _local or tempfile.mkdtemp(prefix="frisk-checkpoint-")
        return _local
    return shared


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: computed once, no lineage, pruned reads."""
    path = path or folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by ``stored`` that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one computation: written like ``stored``, deleted together once the result no longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, folder(spark), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return stored(df, f"{self.path}/{self.n}")

    def clear(self) -> None:
        dropped(self.spark, self.path)

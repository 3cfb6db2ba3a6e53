"""Tables that are computed once: Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in a local session that names none."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed now and written to the shared folder: plans over it stay small and read only the columns they need, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, "kept")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete what kept() wrote, once nothing that will still be computed reads it."""
    for df in frames:
        if path := getattr(df, "_kept_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has no more than so many rows, which are counted first; otherwise as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

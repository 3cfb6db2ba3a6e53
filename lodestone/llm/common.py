"""What the text operators share: word rules, the shared folder, materialised steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: words are runs of anything but space, tab, newline, vertical tab, form feed, return.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in a local session that names none."""
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


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what saved() wrote, once nothing that will still be computed reads it."""
    for df in frames:
        if path := getattr(df, "_saved_at", None):
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(session.sessionState().newHadoopConf()).delete(at, True)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has no more than so many rows, which are counted first; otherwise as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession) -> None:
    """Bound what goes to a Python worker at once to 8 MB for the rest of the session, where it still has Spark's default of 64 MB.

    Workers hold two batches at a time, and many more times their size in what they make of them.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864") in ("67108864", "64MB", "64m"):
        spark.conf.set(name, str(8 << 20))


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system: workers are kept between tasks."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """All of df in one struct, __row, beside what is computed from it: no column of df can clash with it."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("__row"), *more)


def unpacked(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns that packed() took, with some replaced."""
    return df.select(*[changed.get(c, F.col("__row").getField(c)).alias(c) for c in names])


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def count_runs(text: Column, member: str, other: str) -> Column:
    """How many runs of `member` characters a text has; both are bodies of complementary sets.

    Each run, with what stands around it, is replaced by one character: much cheaper than to make strings of the runs.
    """
    t = F.coalesce(text, F.lit(""))
    n = F.length(F.regexp_replace(t, f"[{other}]*+[{member}]++[{other}]*+", "x"))
    return F.when(t.rlike(f"[{member}]"), n).otherwise(0).cast("long")


def count_words(text: Column) -> Column:
    return count_runs(text, r"^\x20\x09-\x0D", r"\x20\x09-\x0D")


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % n

"""Places that survive the loss of an executor: tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors; a temporary one only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lumenlode-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back, so that later jobs neither recompute it nor depend on executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """As ``stash``, laid out by hash of ``key`` so that later joins on it move only the other side.

    ``df`` is the result of an aggregation by ``key``, so its rows lie as the buckets do and one task
    writes each bucket.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._stash_path, out._stash_table = path, name
    return out


def while_read(df: DataFrame) -> DataFrame:
    """The stash ``df``, which goes at the first ``release`` after the last DataFrame that reads it is gone."""
    spark = df.sparkSession
    location = df._jdf.queryExecution().analyzed().relation().location()  # what every plan over the stash holds
    held = spark.sparkContext.__dict__.setdefault("_stashes_read", [])
    held.append((spark._jvm.java.lang.ref.WeakReference(location), df._stash_path))
    return df


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete stashes that no later job reads."""
    for df in tables:
        spark = df.sparkSession
        _delete(spark, df._stash_path)
        if name := getattr(df, "_stash_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner see that finished shuffles are unreferenced, so their files leave the disks."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
    held = spark.sparkContext.__dict__.setdefault("_stashes_read", [])
    for x in [x for x in held if x[0].get() is None]:
        held.remove(x)
        _delete(spark, x[1])


def in_passes(df: DataFrame, key: str, passes: int, f: Callable[[DataFrame], DataFrame], label: str) -> list[DataFrame]:
    """Stashes of ``f`` of the rows of each of so many parts by hash of ``key``, one after the other, so that the shuffles of one part only lie on the disks at a time."""
    parts = []
    for k in range(passes):
        parts.append(stash(f(df.where(F.pmod(F.xxhash64(key), F.lit(passes)) == k)), label))
        release(df.sparkSession)
    return parts


def together(parts: list[DataFrame]) -> DataFrame:
    """All rows of some tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out

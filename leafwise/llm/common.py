"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.session import scratch_dir

ASCII_SPACE = " \t\n\r\x0b\x0c"
#: Groups holding at least 1/HEAVY of all rows are joined by broadcast: there are at most HEAVY of them.
HEAVY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes, NULL as empty: Python gets bytes, without decoding."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def bound_batches(spark: SparkSession, rows: int = 500) -> None:
    """Fewer rows in an Arrow batch, so that a batch of very long texts fits a Python worker.

    Only lowers the session's setting; results do not depend on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Give back the disk of finished steps: ``done``, tables of ``saved`` that nothing reads any more, and shuffle files, which stay until the driver collects its garbage."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in done:
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).getParent()
            folder.getFileSystem(conf).delete(folder, True)
    gc.collect()
    spark._jvm.System.gc()


def fold(column: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a NULL id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_part))


def no_wider(df: DataFrame, rows: int, per_part: int) -> DataFrame:
    """``df`` in no more tasks than its ``rows`` need, 8 or more, where few rows come out of a shuffle of many partitions."""
    return df.coalesce(parts_for(rows, per_part, 8))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left-joined with one row per ``key`` of ``groups``, hot keys without a skewed shuffle.

    ``size`` counts a group's rows, ``total`` all rows. At most ``HEAVY``
    groups hold 1/``HEAVY`` of the rows or more, so those few are broadcast;
    the join of the others is by shuffle.
    """
    bar = total / HEAVY
    heavy = groups.where(F.col(size) >= bar)
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return hot.unionByName(rest.join(groups.where(F.col(size) < bar), key, "left"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finaliser of a public 64-bit hash: fixed values)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x

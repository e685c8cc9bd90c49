"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a table there and reading it back: unlike a block
kept by an executor, it outlives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; unset, a temporary folder, but only where driver and tasks are one process.

    On a cluster a folder of the driver's own would be missing elsewhere, so there the setting is asked for.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; empty tables keep their schema."""
    return materialise_at(df, tag)[0]


#: Makes Spark delete the shuffle files of a query when it ends, instead of when the driver's memory is next cleared of it.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """The table and its path. Nothing reads the shuffles of this write again, so they go with it: loops don't fill the executors' disks."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` to be broadcast, checked to have ``most`` rows at most: for definitions that conditions other than equality join."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} definitions")
    return F.broadcast(df)

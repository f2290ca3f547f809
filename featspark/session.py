"""Session helpers: lineage cuts and local parallelism."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """Directory for checkpoints: the one the cluster names, else (local runs only) a new one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``, for loops that would otherwise grow their plan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Persist a result that several branches of one plan read; spills to disk."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores when a scan yields fewer splits than the session has slots.

    Large inputs already come in many splits and pass through unchanged.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *[F.col(k) for k in keys])


def is_small(df: DataFrame, max_bytes: int = 64 << 20) -> bool:
    """True when the optimizer's size estimate proves ``df`` fits a broadcast."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint only behind a size check; otherwise leave the join to the optimizer."""
    return F.broadcast(df) if is_small(df, max_bytes) else df

"""Shared checkpoints."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def _checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without that setting gets a temporary folder, since
    there driver and executors are one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="nearfold-checkpoint-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder that all executors share and cut its lineage."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints that no table refers to any more.

    Its cleaner learns of them when the driver collects its garbage, which it seldom has cause to do on its own while executors fill their disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()

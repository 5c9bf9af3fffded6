"""What every operator needs from the session: tables, checkpoints, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast after its rows have been counted.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder in spark.checkpoint.dir; a folder of this machine only where none is set and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set")
        folder = tempfile.mkdtemp(prefix="sediment-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def workspace(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/work-{uuid.uuid4().hex}"


def small_or_not(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows; else unchanged, for Spark to shuffle.

    It counts at most max_rows + 1 rows, so the check itself stays cheap.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def spread(df: DataFrame) -> DataFrame:
    """df in enough partitions for work that is bound by Python: shuffled round-robin only if it has fewer than two a core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(3 * cores)

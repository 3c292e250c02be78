"""Session helpers: building a session, cutting lineage, spreading work, size-checked broadcast."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def build_session(app: str = "talentweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on; any of them can be overridden."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # a checkpoint's files go when nothing refers to it any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # call sites of every column expression are only worth their time while debugging
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names.

    Where it names none, a local session works under ``checkpoints`` in its own working folder; on a cluster executors
    could not see each other's files, so that raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("name a folder shared by driver and executors in spark.checkpoint.dir")
        folder = os.path.abspath("checkpoints")
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder every executor can reach, beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there.

    Used between iterations and wherever two branches must see the very same rows; a lost
    executor re-reads the written blocks.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as compressed Parquet to a new shared folder and go on from there: for wide rows that are read twice."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition inputs that come in fewer files than there are cores, so that costly expressions use all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores, *keys)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a lookup side after counting at most ``limit + 1`` of its rows.

    Beyond the limit the side is returned as it is, and Spark joins by shuffle with AQE skew handling.
    """
    if df.select(F.lit(1)).limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df

"""Cutting lineage through the reliable checkpoint folder of the session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only when it was measured and its rows, as JSON text, take at most this much.
BROADCAST_BYTES = 256 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints; a temporary one is made only for a local-mode session."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="wardlog-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def settle(frame: DataFrame) -> DataFrame:
    """Compute a (small) frame once and keep it where lost executors cannot take it away."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def sized(settled: DataFrame, most: int | None = None) -> DataFrame:
    """Mark a settled frame for broadcast if it is small, else for a shuffled hash join.

    With `most`, for frames that grow with the input: broadcast only up to so many bytes, and joins of larger ones are left to
    be sorted, which spills where a hash table would have to fit a task.
    """
    measured = settled.agg(F.sum(F.length(F.to_json(F.struct(*settled.columns))))).first()[0] or 0
    if measured <= (BROADCAST_BYTES if most is None else min(most, BROADCAST_BYTES)):
        return F.broadcast(settled)
    return settled.hint("shuffle_hash") if most is None else settled


def spread(frame: DataFrame) -> DataFrame:
    """Use every core for a scan that has fewer tasks than cores (one small file, one row group).

    Only for a bare scan; large inputs already have enough splits and stay as they are.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame

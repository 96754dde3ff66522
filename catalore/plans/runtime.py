"""Session facts that plans need: the shared folder, lineage cuts, parallelism."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names.

    A folder of our own is made only in local mode, where all executors are
    this machine; on a cluster that names none, a machine's own folder would
    not be readable elsewhere, so that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not named and not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="catalore-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` computed once and kept in the shared folder, safe against lost executors.

    Spark removes such a folder once nothing refers to it if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set at the start.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def few(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no further than one more."""
    return df.limit(rows + 1).count() <= rows

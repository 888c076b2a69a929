"""What the operators need from the session: folders that all executors share, and the parallelism at hand."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or that was set as the checkpoint folder.

    Where neither is set, a session whose executors are on this machine, as in tests, gets a temporary one; a cluster is refused, as its
    executors wouldn't see each other's files.
    """
    context = spark.sparkContext
    set_by_user = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_user:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(set_by_user)
        return set_by_user
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="paperloom-"))
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def parallelism(spark: SparkSession) -> int:
    """Partitions to aim for when rows are spread by hand."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

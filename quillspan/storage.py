"""Shared folders and lineage cuts that survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path below the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset, a local session (a test on one
    machine) gets a folder of our own; on a cluster a machine's own folder would be unreadable elsewhere, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspan-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/quillspan-{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Free the files of tables that ``materialise`` made and that nothing will read again.

    An empty table takes their place: Spark's own writers remove the files, whatever store the folder is in.
    """
    for df in tables:
        df.sparkSession.range(0).write.mode("overwrite").parquet(df.stored_at)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cluster if its scan has fewer tasks than there are cores, as files of few row groups have.

    Where the input is large, it has tasks enough and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df

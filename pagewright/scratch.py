"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``), so a lost executor costs no more than its running tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def leave_no_trace(spark: SparkSession, path: str) -> None:
    """``path`` goes when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder in ``spark.checkpoint.dir``; one of ours only in local mode with none configured.

    Its files go when the driver ends; of a folder that the program set itself only our tables go.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pagewright-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        leave_no_trace(spark, context.getCheckpointDir())
    elif (configured := context.getConf().get("spark.checkpoint.dir")) and configured.rstrip("/") in context.getCheckpointDir():
        leave_no_trace(spark, context.getCheckpointDir())  # made by the context itself, for this application
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder of our own in the shared one; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    leave_no_trace(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder, for loops and for what is read more than once.

    A checkpoint inherits its plan's size estimate, which a loop's joins square in every round.
    """
    path = scratch_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

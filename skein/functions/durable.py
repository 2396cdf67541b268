"""Cutting lineage so that lost executors can't lose the result, and giving up what is used up."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir is the checkpoint folder. Where none is set, a local master (tests) gets a folder of
    its own; on a cluster that is an error, as executors don't share the driver's folders."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="skein-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(frame: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder now and read from there later."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet in the shared checkpoint folder and read again. What went into them is swept."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.parquet(path)
    out.stored_at = path
    del frame
    sweep(spark)
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the folders of ``stored`` tables that nothing reads any more."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark's cleaner find the shuffles and checkpoints that no frame needs any more, without waiting for its half hour."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()

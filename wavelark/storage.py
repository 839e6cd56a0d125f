"""The folder that driver and executors share: durable tables, logs, and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`, which executors share; a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wavelark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def log_folder(spark: SparkSession) -> str:
    """A new folder for logs, beside the checkpoints."""
    return f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate files, wherever Spark reaches it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """`df` made once, in the folder that executors share, for plans that read it several times."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

"""Cutting lineage in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found and given.isDefined():
        found = given.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not given.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once by checkpoint() in the shared folder, so that every later reading sees the same partitions, whatever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def through_files(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` makes of the files that ``write`` has put in a new shared folder, which is deleted once they are read."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        write(path)
        return settled(read(path))
    finally:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

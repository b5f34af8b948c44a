"""Cutting long lineage: rows are written once, in the folder the cluster shares, and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only a local master, as in tests, may do without one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        if not context.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wayfare-")
        context.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def settle(df: DataFrame) -> DataFrame:
    """The rows, read back from files that last until the driver ends or discard() takes them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayfare-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place, files = _file_system(spark, path)
    files.deleteOnExit(place)
    settled = spark.read.schema(df.schema).parquet(path)
    settled.settled_at = path
    return settled


def discard(*settled: DataFrame | None) -> None:
    """Delete what settle() wrote, once nothing that is still to run reads it. Others are left alone."""
    for df in settled:
        if path := getattr(df, "settled_at", None):
            place, files = _file_system(df.sparkSession, path)
            files.delete(place, True)
            files.cancelDeleteOnExit(place)

"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, a folder below the warehouse."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (where or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run has; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, files = _file_system(spark, path)
    files.deleteOnExit(at)
    return path


def cut_at(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """cut, and the path, so that a table that others supersede can be discarded early."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, lost executors cost nothing before it."""
    return cut_at(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table written by cut_at that nothing reads any more."""
    at, files = _file_system(spark, path)
    files.delete(at, True)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

"""Names in shared folders, through the file system that Spark itself uses for them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if there is no such folder."""
    files, at = _place(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote this folder came to its end."""
    files, at = _place(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _place(spark, path)
    files.delete(at, True)

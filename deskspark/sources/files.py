"""File-system checks through Spark's own file system layer."""

from __future__ import annotations

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path as it takes it."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def path_exists(spark: SparkSession, path: str) -> bool:
    files, location = located(spark, path)
    return files.exists(location)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder from one listing; none if it does not exist."""
    files, location = located(spark, path)
    return [s.getPath().getName() for s in files.listStatus(location)] if files.exists(location) else []


def remove(spark: SparkSession, path: str) -> None:
    files, location = located(spark, path)
    files.delete(location, True)

"""Intermediate tables in the shared folder: lineage is cut there, and lost executors cost nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deskspark.session import run_folder


def stored_with_path(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as a table below ``spark.checkpoint.dir`` and read back, and where it lies."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table below ``spark.checkpoint.dir`` and read back."""
    return stored_with_path(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

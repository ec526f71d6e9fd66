"""The audit table: one row per prediction, partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskspark.schemas import AUDIT


def audit_rows(df: DataFrame) -> DataFrame:
    """Exactly the audit columns plus the partition column."""
    return df.select(*AUDIT.names, F.to_date("timestamp").alias("event_date"))


def write_audit(df: DataFrame, path: str) -> None:
    """Append; rows of a model version lie together within each file."""
    rows = audit_rows(df).sortWithinPartitions("event_date", "model_version")
    rows.write.mode("append").partitionBy("event_date").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    fields = [*AUDIT.fields, T.StructField("event_date", T.DateType())]
    return spark.read.schema(T.StructType(fields)).parquet(path)

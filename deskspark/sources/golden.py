"""The locked golden set: written once per version, only read afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deskspark.schemas import MESSAGES
from deskspark.sources.files import path_exists

GOLDEN_VERSION = "v1"


def load_golden(
    spark: SparkSession,
    root: str,
    make: Callable[[], DataFrame],
    version: str = GOLDEN_VERSION,
) -> DataFrame:
    """Golden rows; ``make`` is called only if this version was never written."""
    path = f"{root.rstrip('/')}/version={version}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        make().select(*MESSAGES.names).write.mode("errorifexists").parquet(path)
    return spark.read.schema(MESSAGES).parquet(path)

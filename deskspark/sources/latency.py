"""Load-test latency files and their use in place of in-process timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.schemas import LATENCY_FILE

# Where a latency was measured.
LOAD_TEST = "cloud_run_load_test"
IN_PROCESS = "laptop_dev"


def read_latencies(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per sample: ``model, deployment_run_id, vcpu, memory_gib, sampled_at_utc, latency_ms``.

    Raises on a missing key, a malformed file or an empty sample list.
    """
    reader = spark.read.schema(LATENCY_FILE).option("mode", "FAILFAST")
    files = reader.option("multiLine", multi_line).json(path)
    samples = F.col("per_example_latency_ms")
    checks = files.agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in LATENCY_FILE.names],
        F.count_if(F.size(samples) == 0).alias("_empty"),
    ).first()
    missing = [c for c in LATENCY_FILE.names if checks[c]]
    if missing:
        raise ValueError(f"{path}: no value for {', '.join(missing)}")
    if checks["_empty"]:
        raise ValueError(f"{path}: the list of samples is empty")
    others = [c for c in LATENCY_FILE.names if c != "per_example_latency_ms"]
    return files.select(*others, F.explode(samples).alias("latency_ms"))


def with_latency_source(in_process: DataFrame, load_test: DataFrame) -> DataFrame:
    """``model, latency_ms, latency_source``: load-test samples where a model has any."""
    tested = load_test.select("model").distinct()
    own = in_process.select("model", "latency_ms").join(tested, "model", "left_anti")
    measured = load_test.select("model", "latency_ms").join(
        in_process.select("model").distinct(), "model", "left_semi"
    )
    return own.withColumn("latency_source", F.lit(IN_PROCESS)).unionByName(
        measured.withColumn("latency_source", F.lit(LOAD_TEST))
    )

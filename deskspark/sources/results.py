"""Result documents: class-sized JSON next to the tables they summarise."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.operators.evaluation import nested
from deskspark.operators.thresholds import ESCALATE_ALL

THRESHOLD_DOCUMENT = """
    target_precision double, fitted_at_utc timestamp, n_val_examples bigint,
    escalate_all_threshold double, thresholds map<string,double>,
    per_class_summary array<struct<class_name:string,fitted_threshold:double,
        val_precision:double,val_recall:double,n_accepted:bigint>>
"""


def write_thresholds(
    limits: DataFrame, summary: DataFrame, target: float, n_val: int, path: str
) -> None:
    """Thresholds, their per-class summary and how they were fitted, as one JSON line.

    Both tables have one row per class.
    """
    pairs = F.array_sort(F.collect_list(F.struct("label_id", "threshold")))
    by_id = F.map_from_entries(
        F.transform(
            pairs,
            lambda p: F.struct(p["label_id"].cast("string").alias("k"), p["threshold"].alias("v")),
        )
    )
    columns = ("class_name", "fitted_threshold", "val_precision", "val_recall", "n_accepted")
    rows = F.array_sort(F.collect_list(F.struct("label_id", *columns)))
    listed = summary.agg(
        F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in columns])).alias("rows")
    )
    document = limits.agg(by_id.alias("thresholds")).select(
        F.lit(float(target)).alias("target_precision"),
        F.current_timestamp().alias("fitted_at_utc"),
        F.lit(int(n_val)).alias("n_val_examples"),
        F.lit(ESCALATE_ALL).alias("escalate_all_threshold"),
        "thresholds",
        listed.scalar().alias("per_class_summary"),
    )
    document.write.mode("errorifexists").json(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """``label_id, threshold`` rows of a stored document."""
    document = spark.read.schema(THRESHOLD_DOCUMENT).json(path)
    return document.select(F.explode("thresholds").alias("label_id", "threshold")).select(
        F.col("label_id").cast("int").alias("label_id"), "threshold"
    )


def write_results(
    spark: SparkSession, tables: Mapping[str, DataFrame], lineage: Mapping[str, object], path: str
) -> None:
    """One JSON line holding the given class-sized tables and lineage values."""
    facts = [F.lit(v).alias(k) for k, v in lineage.items()]
    document = spark.range(1).select(
        *facts, F.current_timestamp().alias("generated_at_utc"), nested(tables).alias("tables")
    )
    document.write.mode("errorifexists").json(path)


def settings_column(config: Mapping[str, object]) -> Column:
    """Settings as one map column, in name order."""
    pairs = [F.lit(str(x)) for name in sorted(config) for x in (name, config[name])]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def settings_mark(settings: Column) -> Column:
    """16 hex digits that differ between different settings."""
    return F.substring(F.sha2(F.to_json(settings), 256), 1, 16)


def save_classifier(
    model: LogisticRegressionModel, path: str, lineage: Mapping[str, object], config: Mapping
) -> None:
    """The fitted model and a one-row manifest of where it came from."""
    spark = SparkSession.active()
    model.write().save(f"{path}/model")
    facts = [F.lit(v).alias(k) for k, v in lineage.items()]
    manifest = spark.range(1).select(
        *facts,
        settings_column(config).alias("training_config"),
        settings_mark(settings_column(config)).alias("training_config_hash"),
        F.lit(spark.version).alias("spark_version"),
        F.current_timestamp().alias("bundled_at_utc"),
    )
    manifest.write.mode("errorifexists").json(f"{path}/manifest")


def load_classifier(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(f"{path}/model")

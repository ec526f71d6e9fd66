"""The class list: names and ids, looked up by joins that are as large as the list is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_list(classes: DataFrame) -> DataFrame:
    """``label_id, label_name`` of the list, whatever else it holds."""
    return classes.select(F.col("label_id").cast("int").alias("label_id"), "label_name")


def id_array(classes: DataFrame, most: int | None = None) -> DataFrame:
    """One row, one column: the class ids in order, all of them or the first ``most``."""
    ids = F.array_sort(F.collect_set(F.col("label_id").cast("int")))
    return classes.agg((ids if most is None else F.slice(ids, 1, most)).alias("ids"))


def name_array(classes: DataFrame) -> DataFrame:
    """One row, one column: class names by class id, null where an id is missing."""
    listed = class_list(classes)
    places = listed.agg(F.max("label_id").alias("last")).select(
        F.explode(F.sequence(F.lit(0), F.col("last"))).alias("label_id")
    )
    rows = F.array_sort(F.collect_list(F.struct("label_id", "label_name")))
    return places.join(listed, "label_id", "left").agg(F.transform(rows, lambda r: r["label_name"]).alias("names"))


def each_class(groups: DataFrame, classes: DataFrame, name: str = "label_id") -> DataFrame:
    """Every group with every class id, so that absent classes get a row.

    ``groups`` holds distinct group keys; the result is as large as both say.
    """
    return groups.withColumn(name, F.explode(id_array(classes).scalar()))


def with_class_names(df: DataFrame, classes: DataFrame, **names: str) -> DataFrame:
    """Add ``new_column=id_column`` name look-ups, e.g. ``class_name="label_id"``."""
    listed = class_list(classes)
    for new, id_column in names.items():
        lookup = listed.select(
            F.col("label_id").alias(f"_{new}_id"), F.col("label_name").alias(new)
        )
        df = df.join(lookup, df[id_column] == F.col(f"_{new}_id"), "left").drop(f"_{new}_id")
    return df

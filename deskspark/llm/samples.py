"""Bounded samples of labelled documents, the only rows labels are learned from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm.stored import stored


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents, those with the smallest hashes; stored.

    The ids are broadcast, ``rows`` of them at most; no text is shuffled.
    """
    told = labels.where(F.col(label).isin(0, 1)).select(
        F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")
    )
    few = told.dropna().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    mine = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"))
    # Compared as text, so that ids of another kind than the labels' are no error.
    found = mine.join(F.broadcast(few), F.col("_id").cast("string") == F.col("doc_id").cast("string"))
    return stored(found.select("doc_id", "text", "label"), "labelled-sample")

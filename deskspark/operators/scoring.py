"""Scoring messages and shaping the result for responses and the audit table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskspark.functions import scores as S
from deskspark.operators.classes import name_array
from deskspark.operators.labeling import validate_messages
from deskspark.operators.redaction import redact_messages
from deskspark.schemas import SCORES

#: Name of the column that says where a row was read from.
POSITION = "source_position"
TextScorer = Callable[[Sequence[str]], np.ndarray]


def score_texts(
    df: DataFrame, load_model: Callable[[], TextScorer], text: str = "text"
) -> DataFrame:
    """Add ``logits`` and ``latency_ms`` from a Python model.

    ``load_model`` runs once per task; the scorer it returns maps a batch of
    texts to a (rows, classes) matrix. A row's latency is its batch's time
    divided by the batch's rows.
    """
    extra = [f for f in SCORES.fields]
    schema = T.StructType(df.schema.fields + extra)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load_model()
        for batch in batches:
            started = time.monotonic()
            logits = np.asarray(score(batch[text].tolist()), dtype=np.float64)
            spent = (time.monotonic() - started) * 1000.0
            yield batch.assign(logits=list(logits), latency_ms=spent / max(1, len(batch)))

    return df.mapInPandas(run, schema)


def with_probabilities(
    df: DataFrame, temperature: float = 1.0, logits: str = "logits"
) -> DataFrame:
    return df.withColumn("probs", S.softmax(F.col(logits), temperature))


def top_classes(
    df: DataFrame, classes: DataFrame, k: int = 5, probs: str = "probs"
) -> DataFrame:
    """Add ``predicted_intent, confidence, top_k_intents, top_k_confidences``."""
    ranked = df.withColumn("_names", name_array(classes).scalar())
    ranked = ranked.select("*", S.computed_once(_top=S.top_k(F.col(probs), k)))
    top, names = F.col("_top"), F.col("_names")
    return ranked.withColumns(
        {
            "predicted_intent": F.get(names, F.get(top, F.lit(0))["label_id"]),
            "confidence": F.get(top, F.lit(0))["p"],
            "top_k_intents": F.transform(top, lambda t: F.get(names, t["label_id"])),
            "top_k_confidences": F.transform(top, lambda t: t["p"]),
        }
    ).drop("_top", "_names")


def source_position() -> Column:
    """File and row number of each row as it is read from Parquet, in batch and stream."""
    return F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def request_id(given: Column, position: Column | None = None) -> Column:
    """The caller's id, or a new one if it is missing or empty.

    With ``position`` the new id is a hash of where the row lies in its source,
    in the form of a version 8 UUID: a task or batch that runs again gives the
    same one. Without it, or for a null position, it is random and may change
    when a task runs again.
    """
    fresh = F.uuid()
    if position is not None:
        told = F.sha2(position.cast("binary"), 256)
        parts = [F.substring(told, 1, 8), F.substring(told, 9, 4), F.concat(F.lit("8"), F.substring(told, 13, 3))]
        parts += [F.concat(F.lit("8"), F.substring(told, 16, 3)), F.substring(told, 19, 12)]
        fresh = F.when(position.isNull(), fresh).otherwise(F.concat_ws("-", *parts))
    return F.coalesce(F.nullif(given, F.lit("")), fresh)


def _id_of(df: DataFrame) -> Column:
    position = F.col(POSITION) if POSITION in df.columns else None
    return request_id(F.col("request_id"), position).alias("request_id")


def predict_messages(
    df: DataFrame,
    classes: DataFrame,
    salt: bytes,
    model_version: str,
    score: Callable[[DataFrame, str], DataFrame],
    temperature: float = 1.0,
    k: int = 5,
    redact: Callable[[DataFrame, bytes], DataFrame] = redact_messages,
) -> DataFrame:
    """Validate, redact, score and shape audit rows; for batch and stream alike.

    Messages that fail validation are in ``rejected_messages`` of the same input.
    ``redact`` adds ``redacted_text`` and ``spans``.

    ``df`` has ``request_id, text`` and whatever else should be kept out of the
    audit; a column ``source_position`` makes new ids repeatable. ``score`` adds ``logits`` and ``latency_ms`` from the column it is
    told to read, which is the redacted text: neither the model nor the audit
    sees the original.
    """
    accepted, _ = validate_messages(df)
    redacted = redact(accepted, salt).drop("text", "spans")
    scored = score(redacted, "redacted_text")
    ranked = top_classes(with_probabilities(scored, temperature), classes, k)
    return ranked.select(
        _id_of(ranked),
        F.current_timestamp().alias("timestamp"),
        F.lit(model_version).alias("model_version"),
        F.col("redacted_text").alias("input_text_redacted"),
        "predicted_intent",
        "confidence",
        "top_k_intents",
        "top_k_confidences",
        "latency_ms",
    )


def rejected_messages(df: DataFrame, model_version: str) -> DataFrame:
    """The messages ``predict_messages`` does not score, with a reason and without their text."""
    _, rejected = validate_messages(df)
    return rejected.select(
        _id_of(rejected),
        F.current_timestamp().alias("timestamp"),
        F.lit(model_version).alias("model_version"),
        F.when(F.col("text").isNull(), "no text").when(F.length("text") == 0, "empty").otherwise("too long").alias("reason"),
        F.length("text").alias("n_chars"),
    )

"""Declared schemas; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGES = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("label", T.IntegerType(), False),
        T.StructField("split", T.StringType(), False),
    ]
)

CLASSES = T.StructType(
    [
        T.StructField("label_id", T.IntegerType(), False),
        T.StructField("label_name", T.StringType(), False),
    ]
)

# Unknown or unparsable teacher answers carry this id.
UNKNOWN_ID = -1

TEACHER_LABELS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("teacher_intent_name", T.StringType()),
        T.StructField("teacher_intent_id", T.IntegerType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("error", T.StringType(), True),
        T.StructField("gold_label_id", T.IntegerType()),
        T.StructField("gold_label_name", T.StringType()),
        T.StructField("correct", T.BooleanType()),
        T.StructField("split", T.StringType()),
        T.StructField("prompt_version", T.StringType()),
        T.StructField("prompt_fingerprint", T.StringType()),
    ]
)

# One paid teacher call as the labeler callable returns it.
TEACHER_RESPONSES = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("gold_label_id", T.IntegerType()),
        T.StructField("response", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
    ]
)

# A call that stayed without an answer.
CALL_FAILURES = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("error_class", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

EMBEDDINGS = T.StructType(
    [
        T.StructField("cache_key", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
    ]
)

LATENCY_FILE = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("deployment_run_id", T.StringType()),
        T.StructField("vcpu", T.DoubleType()),
        T.StructField("memory_gib", T.DoubleType()),
        T.StructField("per_example_latency_ms", T.ArrayType(T.DoubleType())),
        T.StructField("sampled_at_utc", T.StringType()),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("input_text_redacted", T.StringType()),
        T.StructField("predicted_intent", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("top_k_intents", T.ArrayType(T.StringType())),
        T.StructField("top_k_confidences", T.ArrayType(T.DoubleType())),
        T.StructField("latency_ms", T.DoubleType()),
    ]
)

REJECTED = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("n_chars", T.IntegerType()),
    ]
)

SCORES = T.StructType(
    [
        T.StructField("logits", T.ArrayType(T.DoubleType())),
        T.StructField("latency_ms", T.DoubleType()),
    ]
)

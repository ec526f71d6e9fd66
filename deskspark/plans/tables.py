"""Message, score and label tables derived from the shared test tables.

The test tables hold no intent classifier, so one is derived from the
embeddings: class centroids over the training rows, and three models that
differ in how they compare an embedding with the centroids. Scores are rounded
to 6 and probabilities to 9 decimals before anything is ranked, because engines
add doubles up in different orders.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.functions import scores as S
from deskspark.functions.teacher import MESSAGE_HEADING, PROMPT_FOOTER
from deskspark.operators.label_job import Answer
from deskspark.operators.labeling import classify_responses, enrich_labels
from deskspark.operators.metrics import flatten_scores
from deskspark.operators.sizes import computed_now, computed_small
from deskspark.schemas import TEACHER_LABELS

STUDENT, BASELINE, TEACHER = "student", "baseline", "teacher"
STUDENT_SHARPNESS, BASELINE_SHARPNESS = 30.0, 40.0
UNTYPED_GAP, MALFORMED_GAP, UNSURE_GAP = 0.003, 0.006, 0.012
SALT = b"desk-salt"
FINGERPRINT = "00c0ffee00c0ffee"
PROMPT_VERSION = "3"
LANGUAGE_WORDS = {
    "english": ("the", "and", "of"),
    "french": ("le", "la", "de"),
    "german": ("der", "die", "und"),
    "spanish": ("el", "los", "que"),
}


#: Declared, so that opening a table starts no job.
SCHEMAS = {
    "embeddings": "vec_id long, embedding array<float>, label int",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "conversations": "conv_id long, turn long, role string, text string",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[table]) if table in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{table}.parquet")


def hashed_split(row_id: str) -> Column:
    """3/16 validation, 3/16 golden, the rest train, by a hash of the id."""
    lead = F.substring(F.md5(F.concat(F.lit("split:"), F.col(row_id).cast("string"))), 1, 1)
    return F.when(lead < "3", "val").when(lead < "6", "golden").otherwise("train")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """``row_id, e, label, split`` for every embedding."""
    return read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("e"),
        "label",
        hashed_split("vec_id").alias("split"),
    )


def label_map(spark: SparkSession, folder: str) -> DataFrame:
    """The class list of the embeddings, written once per call and as small as it is."""
    labels = read(spark, folder, "embeddings").select("label").distinct()
    return computed_small(
        labels.select(F.col("label").alias("label_id"), F.concat(F.lit("class_"), "label").alias("label_name"))
    )


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """One row ``m``: the class centroids in class order (classes x dimensions)."""
    train = items(spark, folder).where("split = 'train'")
    means = train.groupBy("label").agg(
        Summarizer.mean(array_to_vector("e")).alias("mean")
    )
    rounded = F.transform(vector_to_array("mean"), lambda x: F.round(x, 6))
    rows = means.select(F.struct("label", rounded.alias("c")).alias("r"))
    return rows.agg(
        F.transform(F.array_sort(F.collect_list("r")), lambda r: r["c"]).alias("m")
    )


def _compare(e: Column, matrix: Column, term: Callable[[Column, Column], Column]) -> Column:
    """Sum of ``term`` over dimensions, for each centroid."""
    return F.transform(
        matrix,
        lambda c: F.aggregate(F.zip_with(e, c, term), F.lit(0.0), lambda a, x: a + x),
    )


def _rounded(values: Column, factor: float) -> Column:
    return F.transform(values, lambda v: F.round(v * factor, 6))


def _with_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).withColumn("m", centroids(spark, folder).scalar())


def fresh_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Both models in one pass over the embeddings."""
    e, m = F.col("e"), F.col("m")
    dot = _compare(e, m, lambda a, b: a * b)
    apart = _compare(e, m, lambda a, b: (a - b) * (a - b))
    student = F.struct(
        F.lit(STUDENT).alias("model"),
        _rounded(dot, STUDENT_SHARPNESS).alias("logits"),
        F.round(F.abs(F.get(e, F.lit(1))) * 100.0 + 10.0, 3).alias("latency_ms"),
    )
    baseline = F.struct(
        F.lit(BASELINE).alias("model"),
        _rounded(apart, -BASELINE_SHARPNESS).alias("logits"),
        F.round(F.abs(F.get(e, F.lit(2))) * 50.0 + 5.0, 3).alias("latency_ms"),
    )
    return _with_matrix(spark, folder).select(
        "row_id", "split", "label", F.inline(F.array(student, baseline))
    )


def scored(spark: SparkSession, folder: str, models: Sequence[str] = (STUDENT, BASELINE)) -> DataFrame:
    """``model, row_id, split, label, logits, latency_ms`` for each model and row.

    Written for this call only: scores are stored tables in practice, and
    metrics read them several times and prune their columns.
    """
    rows = computed_now(fresh_scores(spark, folder))
    return rows.where(F.col("model").isin(*models))


def rounded_probs(temperature: float = 1.0) -> Column:
    return F.transform(S.softmax(F.col("logits"), temperature), lambda p: F.round(p, 9))


def predictions(spark: SparkSession, folder: str, models: Sequence[str] = (STUDENT, BASELINE)) -> DataFrame:
    """``scored`` with ``probs`` and flat ``pred, conf``."""
    return predicted(scored(spark, folder, models))


def predicted(scores: DataFrame) -> DataFrame:
    return flatten_scores(scores.withColumn("probs", rounded_probs()))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """A third rule in place of the teacher; close calls give unusable answers."""
    e, m = F.col("e"), F.col("m")
    near = F.transform(
        _compare(e, m, lambda a, b: F.abs(a - b)), lambda v, i: F.struct(F.round(v, 6).alias("d"), i.alias("c"))
    )
    ranked = _with_matrix(spark, folder).withColumn("near", F.array_sort(near))
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    gap = F.round(second["d"] - first["d"], 6)
    answer = (
        F.when(gap < UNTYPED_GAP, '{"intent": 42}')
        .when(gap < MALFORMED_GAP, "I am not sure")
        .when(gap < UNSURE_GAP, '{"intent": "other"}')
        .otherwise(F.concat(F.lit('{"intent": "class_'), first["c"], F.lit('", "note": "x"}')))
    )
    return ranked.select(
        "row_id",
        F.concat(F.lit("message "), "row_id").alias("text"),
        F.col("label").alias("gold_label_id"),
        "split",
        answer.alias("response"),
        (F.lit(700) + F.floor(F.abs(F.get(e, F.lit(0))) * 1000)).alias("input_tokens"),
        (F.lit(8) + F.floor(F.abs(F.get(e, F.lit(3))) * 20)).alias("output_tokens"),
        F.round(F.abs(F.get(e, F.lit(4))) * 2000.0 + 800.0, 3).alias("latency_ms"),
        F.lit("teacher-1").alias("model_version"),
    )


def teacher_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Raw JSON answers with token counts and latency, as a labeling run stores them."""
    return computed_now(_answers(spark, folder))


def teacher_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The label table: checked answers with gold labels and lineage."""
    return _labels(teacher_responses(spark, folder), label_map(spark, folder))


def _labels(responses: DataFrame, classes: DataFrame) -> DataFrame:
    checked = classify_responses(responses, classes)
    return enrich_labels(checked, classes, PROMPT_VERSION, FINGERPRINT).select(
        *TEACHER_LABELS.names
    )


def teacher_predictions(spark: SparkSession, folder: str, classes: DataFrame) -> DataFrame:
    """Teacher labels as score vectors, in the shape of ``predictions``; nothing is stored."""
    probs = S.one_hot(F.col("teacher_intent_id"), classes.count())
    rows = _labels(_answers(spark, folder), classes).select(
        F.lit(TEACHER).alias("model"),
        "row_id",
        "split",
        F.col("gold_label_id").alias("label"),
        "latency_ms",
        "input_tokens",
        "output_tokens",
        F.transform(probs, lambda p: F.round(p, 9)).alias("probs"),
    )
    return flatten_scores(rows)


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """``row_id, conv_id, turn, role, text`` with one id per message."""
    rows = read(spark, folder, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), *rows.columns)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", "text")


def language_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(enumerate(LANGUAGE_WORDS)), "label_id int, label_name string"
    )


def word_pattern(words: Sequence[str]) -> str:
    return f"[ \n]({'|'.join(words)})[ ,.\n]"


def language_logits(df: DataFrame, text: str) -> DataFrame:
    """A native scorer: how often each language's marker words occur."""
    low = F.lower(text)
    counts = [
        F.regexp_count(low, F.lit(word_pattern(words))).cast("double")
        for words in LANGUAGE_WORDS.values()
    ]
    return df.withColumns({"logits": F.array(*counts), "latency_ms": F.lit(0.0)})


def load_language_model():
    """The same scorer as a Python model, for the ``mapInPandas`` path."""
    patterns = [re.compile(word_pattern(words)) for words in LANGUAGE_WORDS.values()]

    def score(texts: Sequence[str]):
        lowered = (t.lower() for t in texts)
        return [[float(len(p.findall(t))) for p in patterns] for t in lowered]

    return score


def load_count_encoder():
    """An encoder in place of a sentence model: lengths, words, and two letters."""

    def encode(texts: Sequence[str]):
        return [[float(len(t)), float(t.count(" ")), float(t.count("e")), float(t.count("a"))] for t in texts]

    return encode


LENGTH_CLASSES = {"short": "At most 400 characters.", "long": "More than 400 characters."}


def load_prompt_labeler():
    """The same rule for a whole prompt, billed by the prompt's length."""
    def label(prompt: str) -> Answer:
        message = prompt.split(f"\n\n{MESSAGE_HEADING}\n", 1)[1].removesuffix(f"\n\n{PROMPT_FOOTER}")
        intent = "long" if len(message) > 400 else "short"
        return Answer(f'{{"intent": "{intent}"}}', len(prompt) // 4, 15, 0.0, "rule-2")

    return label


def load_length_labeler():
    """A rule in place of the remote teacher: long or short, by message length."""
    def label(text: str) -> Answer:
        intent = "long" if len(text) > 400 else "short"
        return Answer(f'{{"intent": "{intent}"}}', len(text) // 4 + 80, 15, 0.0, "rule-1")

    return label

"""Teacher labels: answer checking, enrichment, summaries, error analysis, budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskspark.functions.scores import computed_once
from deskspark.functions.teacher import answered_intent, token_cost, valid_length
from deskspark.operators.classes import class_list, with_class_names
from deskspark.operators.cost import TEACHER_RATES
from deskspark.operators.prefix import exact_percentiles, running_totals
from deskspark.schemas import UNKNOWN_ID

PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def validate_messages(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows of 1 to 2000 characters, and the rejected rest."""
    ok = valid_length(F.col(text))
    return df.where(ok), df.where(~ok)


def classify_responses(df: DataFrame, classes: DataFrame, response: str = "response") -> DataFrame:
    """Add ``teacher_intent_name, teacher_intent_id, error`` from a JSON answer.

    An answer outside the class list keeps its name with id -1 and
    ``unknown_intent``; anything that is not an object with a string ``intent``
    has an empty name, id -1 and ``parse_error``.
    """
    names = class_list(classes).select(
        F.col("label_name").alias("_intent"), F.col("label_id").alias("_id")
    )
    parsed = df.select("*", computed_once(_intent=answered_intent(F.col(response))))
    matched = parsed.join(names, "_intent", "left")
    error = F.when(F.col("_intent").isNull(), "parse_error").when(
        F.col("_id").isNull(), "unknown_intent"
    )
    return matched.withColumns(
        {
            "teacher_intent_name": F.coalesce("_intent", F.lit("")),
            "teacher_intent_id": F.coalesce("_id", F.lit(UNKNOWN_ID)),
            "error": error,
        }
    ).drop("_intent", "_id")


def enrich_labels(
    df: DataFrame, classes: DataFrame, prompt_version: str, prompt_fingerprint: str
) -> DataFrame:
    """Add the gold name, correctness and lineage columns."""
    named = with_class_names(df, classes, gold_label_name="gold_label_id")
    return named.withColumns(
        {
            "correct": F.col("teacher_intent_id") == F.col("gold_label_id"),
            "prompt_version": F.lit(prompt_version),
            "prompt_fingerprint": F.lit(prompt_fingerprint),
        }
    )


def drop_unknown(df: DataFrame) -> DataFrame:
    """Rows with a usable teacher label; teacher and gold labels stay separate columns."""
    return df.where(F.col("teacher_intent_id") != UNKNOWN_ID)


def dropped_counts(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    unknown = F.col("teacher_intent_id") == UNKNOWN_ID
    return df.groupBy(*by).agg(
        F.count_if(~unknown).alias("kept"), F.count_if(unknown).alias("dropped")
    )


def _rate(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def labeling_summary(
    df: DataFrame, by: Sequence[str] = (), rates: Mapping[str, float] = TEACHER_RATES
) -> DataFrame:
    """Counts, token totals, cost, latency percentiles and accuracy of a run.

    Accuracy is over all rows, unknown ones included. Values are unrounded.
    """
    by = list(by)
    totals = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count("error").alias("errors"),
        F.count_if(F.col("teacher_intent_id") == F.col("gold_label_id")).alias("_right"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_total"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_total"),
    )
    latency = exact_percentiles(df, "latency_ms", PERCENTILES, by)
    if by:
        of = latency.withColumnsRenamed({c: f"_of_{c}" for c in by})
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
        totals = totals.join(of, same, "left")
    else:
        totals = totals.withColumns(
            {p: latency.select(p).scalar() for p in PERCENTILES}
        )
    return totals.select(
        *by,
        "n_rows",
        "errors",
        _rate(F.col("errors"), F.col("n_rows")).alias("error_rate"),
        _rate(F.col("_right"), F.col("n_rows")).alias("teacher_vs_gold_accuracy"),
        "input_total",
        "output_total",
        token_cost(F.col("input_total"), F.col("output_total"), rates).alias("cost_usd"),
        *[F.coalesce(p, F.lit(0.0)).alias(f"latency_ms_{p}") for p in PERCENTILES],
    )


def label_distribution(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Usable teacher labels by name, most frequent first."""
    return (
        drop_unknown(df)
        .groupBy(*by, "teacher_intent_name")
        .agg(F.count("*").alias("n"))
        .orderBy(*by, F.col("n").desc(), "teacher_intent_name")
    )


def ceiling_accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Teacher accuracy over usable rows only."""
    usable = F.col("teacher_intent_id") != UNKNOWN_ID
    right = F.col("teacher_intent_id") == F.col("gold_label_id")
    return df.groupBy(*by).agg(
        F.count("*").alias("subset_size"),
        F.count_if(usable).alias("n_valid"),
        _rate(F.count_if(usable & right), F.count_if(usable)).alias("ceiling_top1_accuracy"),
        F.count("error").alias("error_count"),
    )


def class_accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Teacher accuracy per gold class; unknown rows count as wrong."""
    right = F.col("teacher_intent_id") == F.col("gold_label_id")
    return df.groupBy(*by, "gold_label_name").agg(
        F.count("*").alias("n"),
        F.count_if(right).alias("correct"),
        _rate(F.count_if(right), F.count("*")).alias("accuracy"),
    )


def worst_classes(df: DataFrame, top_n: int = 10) -> DataFrame:
    """Gold classes by accuracy, larger classes first among equals."""
    return (
        class_accuracy(df)
        .orderBy(F.col("accuracy").asc(), F.col("n").desc(), F.col("gold_label_name").asc())
        .limit(top_n)
    )


def error_overview(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    wrong = ~F.col("correct")
    return df.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("correct").alias("correct"),
        _rate(F.count_if("correct"), F.count("*")).alias("accuracy"),
        F.count_if(wrong).alias("misses"),
        _rate(F.count_if(wrong), F.count("*")).alias("miss_rate"),
        F.count_if(wrong & (F.col("teacher_intent_id") == UNKNOWN_ID)).alias("parse_errors"),
    )


def real_errors(df: DataFrame) -> DataFrame:
    """Wrong answers that are a known class."""
    return drop_unknown(df).where(~F.col("correct"))


def error_pairs(df: DataFrame, top_n: int = 20) -> DataFrame:
    """Most frequent (gold, teacher) mistakes; equal counts in order of first row."""
    return (
        real_errors(df)
        .groupBy("gold_label_name", "teacher_intent_name")
        .agg(F.count("*").alias("n"), F.min("row_id").alias("first_row_id"))
        .orderBy(F.col("n").desc(), F.col("first_row_id").asc())
        .limit(top_n)
    )


def confusion_examples(df: DataFrame, per_pair: int = 3, top_n: int = 20) -> DataFrame:
    """The first rows of each of the most frequent mistakes.

    ``row_number() <= n`` is pushed below the shuffle by Spark, so each task
    sends at most ``per_pair`` rows of a pair, however frequent the pair is.
    """
    pair = ["gold_label_name", "teacher_intent_name"]
    top = F.broadcast(error_pairs(df, top_n).select(*pair))
    place = Window.partitionBy(*pair).orderBy("row_id")
    return (
        real_errors(df)
        .join(top, pair, "left_semi")
        .withColumn("example", F.row_number().over(place))
        .where(F.col("example") <= per_pair)
        .select(*pair, "example", "row_id", "text")
    )


def budget_cutoff(
    df: DataFrame, max_cost_usd: float, rates: Mapping[str, float] = TEACHER_RATES
) -> DataFrame:
    """Rows in ``row_id`` order up to and including the one that crosses the cap.

    Token counts are added up as integers and priced afterwards, so the cut does
    not depend on how the rows are partitioned. Rows in slices that begin beyond
    the cap are dropped before anything moves.
    """

    def paid(before: dict[str, Column]) -> Column:
        return token_cost(before["input_tokens"], before["output_tokens"], rates) <= max_cost_usd

    tokens = ["input_tokens", "output_tokens"]
    totals = running_totals(df, [], ["row_id"], tokens, wanted=paid)
    spent = token_cost(F.col("running_input_tokens"), F.col("running_output_tokens"), rates)
    before = token_cost(
        F.col("running_input_tokens") - F.col("input_tokens"),
        F.col("running_output_tokens") - F.col("output_tokens"),
        rates,
    )
    return (
        totals.where(before <= max_cost_usd)
        .withColumn("spent_usd", spent)
        .drop("running_input_tokens", "running_output_tokens")
    )

"""Token-billed and time-billed cost per thousand requests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.functions.teacher import (
    ANSWER_TOKENS,
    estimated_input_tokens,
    token_cost,
)

# The dated price sheet, in US dollars.
PRICING_DATE = "2026-05"
TEACHER_RATES = {
    "usd_per_million_input_tokens": 0.30,
    "usd_per_million_output_tokens": 2.50,
}
SERVING_RATES = {
    "usd_per_vcpu_second": 0.000024,
    "usd_per_gib_second": 0.0000025,
    "usd_per_million_requests": 0.40,
}
SERVING_VCPU = 1.0
SERVING_MEMORY_GIB = 2.0
SKIPPED_NOTE = "cost summary skipped: teacher or student missing from this run"


def _per_thousand(dollars: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(dollars, n) * 1000.0, F.lit(0.0))


def with_row_cost(df: DataFrame, rates: Mapping[str, float] = TEACHER_RATES) -> DataFrame:
    return df.withColumn("cost_usd", token_cost(F.col("input_tokens"), F.col("output_tokens"), rates))


def estimate_cost(
    df: DataFrame, taxonomy: DataFrame, rates: Mapping[str, float] = TEACHER_RATES
) -> DataFrame:
    """Cost of labeling all rows of ``df``, before any call is made."""
    counted = df.agg(F.count("*").alias("n_rows")).withColumn(
        "avg_input_tokens", estimated_input_tokens(taxonomy.select("taxonomy_block").scalar())
    )
    per_call = token_cost(F.col("avg_input_tokens"), F.lit(ANSWER_TOKENS), rates)
    return counted.select(
        "n_rows",
        "avg_input_tokens",
        F.lit(ANSWER_TOKENS).alias("avg_output_tokens"),
        (per_call * F.col("n_rows")).alias("estimated_usd"),
    )


def teacher_cost_per_1k(
    df: DataFrame, by: Sequence[str] = (), rates: Mapping[str, float] = TEACHER_RATES
) -> DataFrame:
    """Token-billed; no rows cost 0."""
    dollars = token_cost(F.sum("input_tokens"), F.sum("output_tokens"), rates)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), _per_thousand(dollars, F.count("*")).alias("cost_per_1k_usd")
    )


def student_cost_per_1k(
    df: DataFrame,
    by: Sequence[str] = (),
    vcpu: float = SERVING_VCPU,
    memory_gib: float = SERVING_MEMORY_GIB,
    rates: Mapping[str, float] = SERVING_RATES,
    latency: str = "latency_ms",
) -> DataFrame:
    """Billed by wall time of the instance plus a fee per request; no rows cost 0."""
    per_second = vcpu * rates["usd_per_vcpu_second"] + memory_gib * rates["usd_per_gib_second"]
    n = F.count("*")
    fee = n * (rates["usd_per_million_requests"] / 1e6)
    dollars = F.sum(latency) / 1000.0 * per_second + fee
    return df.groupBy(*by).agg(
        n.alias("n"), _per_thousand(dollars, n).alias("cost_per_1k_usd")
    )


def cost_breakdown(
    costs: DataFrame,
    teacher: str = "teacher",
    student: str = "student",
    baseline: str = "baseline",
    pricing_date: str = PRICING_DATE,
) -> DataFrame:
    """One row: costs side by side and how many times cheaper each model is.

    ``costs`` has one row per model (``model, cost_per_1k_usd``), and
    ``pricing_date`` is the date of the rates it was made with. A zero divisor
    gives a null ratio; without teacher or student only the note is filled.
    """

    def of(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col("cost_per_1k_usd")))

    one = costs.agg(
        of(teacher).alias("teacher"), of(student).alias("student"), of(baseline).alias("baseline")
    )
    present = F.col("teacher").isNotNull() & F.col("student").isNotNull()

    def shown(value: Column) -> Column:
        return F.when(present, value)

    def times(model: str) -> Column:
        ratio = F.when(F.col(model) > 0, F.try_divide(F.col("teacher"), F.col(model)))
        return shown(F.round(ratio, 1))

    return one.select(
        F.lit(pricing_date).alias("pricing_date"),
        shown(F.round("teacher", 6)).alias("teacher_cost_per_1k_usd"),
        shown(F.round("student", 6)).alias("student_cost_per_1k_usd"),
        times("student").alias("student_cost_reduction_vs_teacher_x"),
        shown(F.round("baseline", 6)).alias("baseline_cost_per_1k_usd"),
        times("baseline").alias("baseline_cost_reduction_vs_teacher_x"),
        F.when(~present, SKIPPED_NOTE).alias("note"),
    )

"""Calibration: binned error, reliability table, and the temperature fit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskspark.functions import scores as S
from deskspark.operators.sizes import computed_now

# Bins of the calibration error and bounds of the temperature.
DEFAULT_BINS = 15
TEMPERATURE_BOUNDS = (0.05, 100.0)


def bin_edges(n_bins: int) -> list[float]:
    """Equal-width edges from 0 to 1, as ``i * (1 / n_bins)`` in doubles."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def confidence_bin(conf: Column, n_bins: int = DEFAULT_BINS) -> Column:
    """Index of the half-open bin holding ``conf``; the last bin is closed.

    Counts the inner edges at or below ``conf``. ``floor(conf * n)`` is not the
    same: 0.3 * 10 falls below 3 for some values that sit on an edge.
    """
    inner = bin_edges(n_bins)[1:-1]
    if not inner:
        return F.lit(0)
    guess = F.least(F.greatest(F.floor(conf * n_bins), F.lit(0)), F.lit(n_bins - 1)).cast("int")
    # The guess is off by one at most, so only the edges next to it are compared.
    edges = F.array(*[F.lit(e) for e in bin_edges(n_bins)])
    below = F.when(conf < F.get(edges, guess), -1).otherwise(0)
    above = F.when((guess < n_bins - 1) & (conf >= F.get(edges, guess + 1)), 1).otherwise(0)
    return (guess + below + above).cast("int")


def reliability_bins(
    df: DataFrame, by: Sequence[str] = (), n_bins: int = DEFAULT_BINS
) -> DataFrame:
    """Per bin: row count, mean confidence, accuracy. Empty bins are kept with 0."""
    by = list(by)
    hit = (F.col("label") == F.col("pred")).cast("double")
    # The bin is an expression over the flat column, so the group-by combines
    # down to n_bins rows per task before anything is shuffled.
    full = computed_now(
        df.groupBy(*by, confidence_bin(F.col("conf"), n_bins).alias("bin")).agg(
            F.count("*").alias("n"), F.sum("conf").alias("conf_sum"), F.sum(hit).alias("hits")
        )
    )
    groups = full.select(*by).distinct() if by else full.groupBy().agg(F.lit(1).alias("_one"))
    zeros = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1)))).select(
        *by,
        "bin",
        F.lit(0).cast("long").alias("n"),
        F.lit(0.0).alias("conf_sum"),
        F.lit(0.0).alias("hits"),
    )
    summed = (
        full.unionByName(zeros)
        .groupBy(*by, "bin")
        .agg(*[F.sum(c).alias(c) for c in ("n", "conf_sum", "hits")])
    )
    return summed.select(
        *by,
        "bin",
        "n",
        F.coalesce(F.try_divide("conf_sum", "n"), F.lit(0.0)).alias("mean_confidence"),
        F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)).alias("accuracy"),
    )


def expected_calibration_error(
    df: DataFrame, by: Sequence[str] = (), n_bins: int = DEFAULT_BINS
) -> DataFrame:
    """Sum over bins of the bin's share times |mean confidence - accuracy|."""
    gap = F.abs(F.col("mean_confidence") - F.col("accuracy")) * F.col("n")
    return (
        reliability_bins(df, by, n_bins)
        .groupBy(*by)
        .agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
    )


def mean_log_loss(
    df: DataFrame, temperature: float, by: Sequence[str] = (), logits: str = "logits"
) -> DataFrame:
    loss = S.log_loss(F.col(logits), F.col("label"), temperature)
    return df.groupBy(*by).agg(F.avg(loss).alias("nll"))


def _next_beta(state: dict, slope: float, curvature: float, tolerance: float) -> float:
    """One safeguarded Newton step on the inverse temperature."""
    beta = state["beta"]
    state["tried"].add(beta)
    state["high" if slope > 0 else "low"] = beta
    low, high = state["low"], state["high"]
    if low == high:
        return beta
    bound = low if slope > 0 else high
    step = beta - slope / curvature if curvature > 0 else bound
    if abs(step - beta) <= tolerance * beta:
        return beta
    if not low < step < high:
        step = (low * high) ** 0.5 if bound in state["tried"] else bound
    return step


def fit_temperatures(
    df: DataFrame,
    by: Sequence[str] = (),
    logits: str = "logits",
    tolerance: float = 1e-9,
    max_passes: int = 60,
) -> DataFrame:
    """Per group, the temperature in [0.05, 100] with the least mean log loss of ``label``.

    The loss is convex in 1/T. Each pass is one aggregate of its slope and
    curvature for all groups still moving. A Newton step that leaves the bracket
    known to hold the optimum goes to the bound it crosses, or to the geometric
    middle once that bound is known to be too far. Groups are models or splits,
    not data; one number of each is on the driver. A fit that is still moving
    after ``max_passes`` is an error.
    """
    by = list(by)
    spark = df.sparkSession
    low, high = 1.0 / TEMPERATURE_BOUNDS[1], 1.0 / TEMPERATURE_BOUNDS[0]
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    data = rows.select(
        *keys,
        S.shifted_scores(F.col(logits)).alias("z"),
        F.col("label").alias("y"),
    ).persist()
    terms = S.loss_derivatives(F.col("z"), F.col("y"), F.col("beta"))
    slope_and_curvature = [F.avg("t.slope").alias("slope"), F.avg("t.curvature").alias("curvature")]
    try:
        groups = [tuple(r) for r in data.select(*keys).distinct().collect()]
        if not groups:
            raise ValueError("No rows to fit a temperature on")
        renamed = [T.StructField(f"_of_{f.name}", f.dataType) for f in data.select(*keys).schema]
        told = T.StructType([*renamed, T.StructField("beta", T.DoubleType())])
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
        states = {g: {"beta": 1.0, "low": low, "high": high, "tried": set()} for g in groups}
        moving = set(groups)
        for _ in range(max_passes):
            betas = spark.createDataFrame(
                [(*g, states[g]["beta"]) for g in moving], told
            )
            found = (
                data.join(betas, same)
                .select(*keys, terms.alias("t"))
                .groupBy(*keys)
                .agg(*slope_and_curvature)
                .collect()
            )
            for row in found:
                g = tuple(row)[: len(keys)]
                state = states[g]
                step = _next_beta(state, row["slope"], row["curvature"], tolerance)
                if step == state["beta"]:
                    moving.discard(g)
                state["beta"] = step
            if not moving:
                break
    finally:
        data.unpersist()
    if moving:
        raise ValueError(f"{len(moving)} temperatures still move after {max_passes} passes")
    schema = T.StructType([*data.select(*keys).schema.fields, T.StructField("temperature", T.DoubleType())])
    fitted = spark.createDataFrame([(*g, 1.0 / state["beta"]) for g, state in states.items()], schema)
    return fitted.select(*by, "temperature")


def fit_temperature(df: DataFrame, logits: str = "logits") -> float:
    """The temperature of all rows taken together."""
    return fit_temperatures(df, (), logits).first()["temperature"]


def calibration_report(
    df: DataFrame, teacher: DataFrame, n_bins: int = DEFAULT_BINS, logits: str = "logits"
) -> DataFrame:
    """One row: fitted temperature, calibration error before and after, accuracies.

    ``df`` (``row_id, label, logits``) must hold validation rows only; rows whose
    teacher label is unknown are left out, as in training. The join is done once
    and kept for the passes over it; both errors and both accuracies then come
    from one aggregate.
    """
    answers = teacher.where("teacher_intent_id <> -1").select("row_id", "teacher_intent_id")
    usable = (
        df.select("row_id", "label", F.col(logits).alias("logits"))
        .join(answers, "row_id")
        .drop("row_id")
        .persist()
    )
    try:
        temperature = fit_temperature(usable)
        flat = usable.select(
            "label",
            "teacher_intent_id",
            S.argmax(F.col("logits")).alias("pred"),
            S.confidence(S.softmax(F.col("logits"))).alias("pre"),
            S.confidence(S.softmax(F.col("logits"), temperature)).alias("post"),
        )
        staged = flat.select(
            "label",
            "pred",
            "teacher_intent_id",
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(s).alias("stage"), F.col(s).alias("conf"))
                        for s in ("pre", "post")
                    ]
                )
            ),
        )
        right = (F.col("label") == F.col("pred")).cast("long")
        alike = (F.col("teacher_intent_id") == F.col("pred")).cast("long")
        bins = staged.groupBy("stage", confidence_bin(F.col("conf"), n_bins).alias("bin")).agg(
            F.count("*").alias("n"),
            F.sum("conf").alias("conf_sum"),
            F.sum(right).alias("hits"),
            F.sum(alike).alias("alike"),
        )

        def total(column: Column, stage: str) -> Column:
            return F.sum(F.when(F.col("stage") == stage, column))

        gap = F.abs(F.col("conf_sum") - F.col("hits"))
        n = total(F.col("n"), "pre")
        row = bins.agg(
            (total(gap, "pre") / n).alias("ece_pre"),
            (total(gap, "post") / n).alias("ece_post"),
            (total(F.col("hits"), "pre") / n).alias("val_accuracy_vs_truth"),
            (total(F.col("alike"), "pre") / n).alias("val_accuracy_vs_teacher"),
            n.alias("n_val"),
        )
        found = row.collect()
    finally:
        usable.unpersist()
    return df.sparkSession.createDataFrame(found, row.schema).select(
        F.lit(temperature).alias("temperature"),
        "*",
        F.lit(n_bins).alias("n_bins"),
        F.current_timestamp().alias("fitted_at_utc"),
    )

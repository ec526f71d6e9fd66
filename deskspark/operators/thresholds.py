"""Per-class routing thresholds: fit on validation rows, apply anywhere.

Predictions carry ``row_id, label, pred, conf`` plus optional grouping columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskspark.operators.classes import each_class, with_class_names
from deskspark.operators.prefix import running_totals
from deskspark.operators.sizes import computed_now

# Fixed value: a threshold no confidence reaches, so the class is never auto-routed.
ESCALATE_ALL = 1.01
DEFAULT_TARGET_PRECISION = 0.95

_CONFIDENCE_STEPS = 4096


def _check_target(target: float) -> None:
    if not 0.0 < target <= 1.0:
        raise ValueError(f"A precision of {target} cannot be a target: it must lie above 0 and up to 1")


def _renamed(table: DataFrame, by: Sequence[str]) -> DataFrame:
    return table.withColumnsRenamed({c: f"_of_{c}" for c in [*by, "pred"]})


def _same(by: Sequence[str]) -> Column:
    """Same group, a group without a name included, and same predicted class."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, "pred"]])


def running_precision(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision among the rows at or above each row, per predicted class.

    Rows go by falling confidence, then ``row_id``.
    """
    rows = df.select(
        *by,
        "pred",
        "conf",
        "row_id",
        F.lit(1).alias("seen"),
        (F.col("label") == F.col("pred")).cast("int").alias("hit"),
    )
    order = ["-conf", "row_id"]
    totals = running_totals(rows, [*by, "pred"], order, ["seen", "hit"])
    return totals.withColumn(
        "running_precision", F.col("running_hit") / F.col("running_seen")
    ).drop("seen", "hit")


def _undecided(df: DataFrame, target: float, by: list[str]) -> DataFrame:
    """Per predicted class, the confidence steps that can hold the threshold.

    A count per confidence step bounds the running precision inside the step
    from above. Steps that cannot reach the target, and steps above the lowest
    one whose end surely meets it, need no row-level look. ``low`` is null where
    no step can reach it.
    """
    step = F.floor(F.col("conf") * _CONFIDENCE_STEPS).cast("int")
    histogram = df.groupBy(*by, "pred", step.alias("step")).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == F.col("pred")).alias("hits")
    )
    above = (
        Window.partitionBy(*by, "pred")
        .orderBy(F.col("step").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    steps = histogram.select(
        *by,
        "pred",
        "step",
        "n",
        "hits",
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"),
        F.coalesce(F.sum("hits").over(above), F.lit(0)).alias("hits_above"),
    )
    reached = F.col("hits_above") + F.col("hits")
    can = reached / (F.col("n_above") + F.greatest(F.col("hits"), F.lit(1))) >= target
    does = reached / (F.col("n_above") + F.col("n")) >= target
    # Counts above a step only grow as the step falls, so the count above the
    # lowest of several steps is the largest of their counts.
    return steps.groupBy(*by, "pred").agg(
        F.min(F.when(can, F.col("step"))).alias("low"),
        F.coalesce(F.min(F.when(does, F.col("step"))), F.max(F.when(can, F.col("step")))).alias("high"),
        *[
            F.coalesce(F.max(F.when(does, F.col(c))), F.min(F.when(can, F.col(c)))).alias(c)
            for c in ("n_above", "hits_above")
        ],
    )


def fit_thresholds(
    df: DataFrame,
    classes: DataFrame,
    target_precision: float = DEFAULT_TARGET_PRECISION,
    by: Sequence[str] = (),
) -> DataFrame:
    """``label_id, threshold``: the lowest confidence whose running precision meets the target.

    Classes that never meet it, or have no predictions, get ``ESCALATE_ALL``.
    Pass validation rows only. Only rows in undecided confidence steps are
    ordered; everything above them enters as a count.
    """
    _check_target(target_precision)
    by = list(by)
    spans = computed_now(_undecided(df, target_precision, by))
    step = F.floor(F.col("conf") * _CONFIDENCE_STEPS).cast("int")
    open_rows = (
        df.join(_renamed(spans, by), _same(by))
        .where(step.between(F.col("low"), F.col("high")))
        .select(
            *by,
            "pred",
            "conf",
            "row_id",
            F.lit(1).alias("seen"),
            (F.col("label") == F.col("pred")).cast("int").alias("hit"),
            "n_above",
            "hits_above",
        )
    )
    order = ["-conf", "row_id"]
    totals = running_totals(open_rows, [*by, "pred"], order, ["seen", "hit"])
    precision = (F.col("hits_above") + F.col("running_hit")) / (
        F.col("n_above") + F.col("running_seen")
    )
    found = (
        totals.where(precision >= target_precision)
        .groupBy(*by, F.col("pred").alias("label_id"))
        .agg(F.min("conf").alias("threshold"))
    )
    groups = spans.select(*by).distinct() if by else df.sparkSession.range(1)
    absent = each_class(groups, classes).select(
        *by, "label_id", F.lit(None).cast("double").alias("threshold")
    )
    return computed_now(
        found.unionByName(absent)
        .groupBy(*by, "label_id")
        .agg(F.coalesce(F.min("threshold"), F.lit(ESCALATE_ALL)).alias("threshold"))
    )


def apply_thresholds(df: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``threshold`` and ``accepted``; a class without a threshold is never accepted."""
    limits = thresholds.select(*by, F.col("label_id").alias("pred"), "threshold")
    joined = df.join(_renamed(limits, by), _same(by), "left")
    limit = F.coalesce(F.col("threshold"), F.lit(ESCALATE_ALL))
    named = joined.drop(*[f"_of_{c}" for c in [*by, "pred"]])
    return named.withColumn("threshold", limit).withColumn(
        "accepted", F.col("conf") >= F.col("threshold")
    )


def threshold_summary(
    df: DataFrame, thresholds: DataFrame, classes: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Per class: threshold, precision, recall and count among accepted rows."""
    by = list(by)
    cells = (
        apply_thresholds(df, thresholds, by)
        .groupBy(*by, "label", "pred")
        .agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"))
    )
    hit = F.col("label") == F.col("pred")
    none = F.lit(0).cast("long")
    parts = cells.select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.col("pred").alias("label_id"),
                    F.col("n_accepted"),
                    none.alias("n_true"),
                    F.when(hit, F.col("n_accepted")).otherwise(0).alias("n_right"),
                ),
                F.struct(
                    F.col("label").alias("label_id"),
                    none.alias("n_accepted"),
                    F.col("n").alias("n_true"),
                    none.alias("n_right"),
                ),
            )
        ),
    )
    sums = parts.groupBy(*by, "label_id").agg(
        *[F.sum(c).alias(c) for c in ("n_accepted", "n_true", "n_right")]
    )
    of = sums.withColumnsRenamed({c: f"_of_{c}" for c in [*by, "label_id"]})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, "label_id"]])
    joined = thresholds.join(of, same, "left")
    zero = F.lit(0.0)
    return with_class_names(
        joined.select(
            *by,
            "label_id",
            F.col("threshold").alias("fitted_threshold"),
            F.coalesce(F.try_divide("n_right", "n_accepted"), zero).alias("val_precision"),
            F.coalesce(F.try_divide("n_right", "n_true"), zero).alias("val_recall"),
            F.coalesce("n_accepted", none).alias("n_accepted"),
        ),
        classes,
        class_name="label_id",
    )


def routing_stats(df: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Acceptance rate and precision among accepted rows, and classes never routed."""
    by = list(by)
    right = F.col("accepted") & (F.col("label") == F.col("pred"))
    stats = (
        apply_thresholds(df, thresholds, by)
        .groupBy(*by)
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if("accepted").alias("n_accepted"),
            F.count_if(right).alias("n_right"),
        )
    )
    stats = stats.select(
        *by,
        "n_rows",
        "n_accepted",
        F.coalesce(F.try_divide("n_accepted", "n_rows"), F.lit(0.0)).alias("acceptance_rate"),
        F.coalesce(F.try_divide("n_right", "n_accepted"), F.lit(0.0)).alias(
            "precision_among_accepted"
        ),
    )
    never = F.count_if(F.col("threshold") == ESCALATE_ALL)
    closed = thresholds.groupBy(*by).agg(never.alias("n_classes_escalate_all"))
    if by:
        of = closed.withColumnsRenamed({c: f"_of_{c}" for c in by})
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
        return stats.join(of, same).drop(*[f"_of_{c}" for c in by])
    return stats.withColumn("n_classes_escalate_all", closed.scalar())

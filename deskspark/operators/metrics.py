"""Classification metrics.

Input is a predictions table with ``label`` (truth) and ``pred`` columns, plus
any grouping columns such as ``model``. One group-by produces the confusion
counts, whose size is classes x classes whatever the data size; every class
metric is then derived from those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskspark.functions import scores as S
from deskspark.operators.classes import each_class, id_array, with_class_names
from deskspark.operators.sizes import computed_small


def _ratio(top: Column, bottom: Column) -> Column:
    """Division with 0/0 (and anything over 0) taken as 0."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def flatten_scores(df: DataFrame, probs: str = "probs") -> DataFrame:
    """Add flat ``pred`` and ``conf`` columns, the only ones most metrics need."""
    flat = S.computed_once(pred=S.argmax(F.col(probs)), conf=S.confidence(F.col(probs)))
    return df.select("*", flat)


def confusion_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (label, pred), computed at once: every class metric starts here."""
    return computed_small(df.groupBy(*by, "label", "pred").agg(F.count("*").alias("n")))


def top_k_accuracy(
    df: DataFrame, k: int, by: Sequence[str] = (), probs: str = "probs"
) -> DataFrame:
    """Share of rows whose true label is among the k best classes."""
    hit = F.exists(S.top_k(F.col(probs), k), lambda c: c["label_id"] == F.col("label"))
    return df.groupBy(*by).agg(
        F.avg(hit.cast("double")).alias("accuracy"), F.count("*").alias("n")
    )


def class_scores(counts: DataFrame, classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: support, precision, recall, f1, top1_accuracy; 0 where undefined.

    Each confusion cell counts once as a true class and once as a predicted
    class; absent classes are in the result with zeros.
    """
    by = list(by)
    hit = F.col("label") == F.col("pred")
    as_true = F.struct(
        F.col("label").alias("_id"),
        F.col("n").alias("support"),
        F.lit(0).cast("long").alias("predicted"),
        F.when(hit, F.col("n")).otherwise(0).alias("tp"),
    )
    as_pred = F.struct(
        F.col("pred").alias("_id"),
        F.lit(0).cast("long").alias("support"),
        F.col("n").alias("predicted"),
        F.lit(0).cast("long").alias("tp"),
    )
    found = counts.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.inline(F.array(as_true, as_pred)))
    found = found.groupBy(*[f"_of_{c}" for c in by], "_id").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]
    )
    groups = counts.select(*by).distinct() if by else counts.groupBy().agg(F.lit(1).alias("_one"))
    same = F.col("label_id") == F.col("_id")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    # Merged, two tables in one partition need no exchange.
    sums = each_class(groups, classes).join(found.hint("merge"), same, "left").select(
        *by, "label_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "predicted", "tp")]
    )
    precision = _ratio(F.col("tp"), F.col("predicted"))
    recall = _ratio(F.col("tp"), F.col("support"))
    return sums.select(
        *by,
        "label_id",
        "support",
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        recall.alias("top1_accuracy"),
    )


def per_class_metrics(counts: DataFrame, classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return with_class_names(class_scores(counts, classes, by), classes, class_name="label_id")


def macro_f1(counts: DataFrame, classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean F1 over all classes, never-seen ones included with 0."""
    return class_scores(counts, classes, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def confusion_matrix(
    counts: DataFrame, classes: DataFrame, by: Sequence[str] = (), normalize: bool = True
) -> DataFrame:
    """Long form ``label, pred, value`` with every class pair; absent classes are zero rows."""
    by = list(by)
    groups = counts.select(*by).distinct() if by else counts.groupBy().agg(F.lit(1).alias("_one"))
    grid = each_class(each_class(groups, classes, "label"), classes, "pred")
    zeros = grid.select(*by, "label", "pred", F.lit(0).cast("long").alias("n"))
    full = (
        counts.select(*by, "label", "pred", "n")
        .unionByName(zeros)
        .groupBy(*by, "label", "pred")
        .agg(F.sum("n").alias("n"))
    )
    if not normalize:
        return full.withColumn("value", F.col("n").cast("double"))
    row = Window.partitionBy(*by, "label")
    return full.withColumn("value", _ratio(F.col("n"), F.sum("n").over(row)))


def top_confusion_pairs(
    counts: DataFrame, classes: DataFrame, top_n: int = 20, by: Sequence[str] = ()
) -> DataFrame:
    """Worst off-diagonal cells by value, then class ids; zero cells fill the tail.

    Ranks the cells that occur. Zero cells matter only where fewer than
    ``top_n`` occur, and then the first ones in class order are among the first
    ``2 * top_n + 1`` classes, so no other zero cell is made.
    """
    by = list(by)
    row = Window.partitionBy(*by, "label")
    cells = counts.withColumn("value", _ratio(F.col("n"), F.sum("n").over(row)))
    groups = counts.select(*by).distinct() if by else counts.groupBy().agg(F.lit(1).alias("_one"))
    few = id_array(classes, 2 * top_n + 1).scalar()
    grid = groups.withColumn("label", F.explode(few)).withColumn("pred", F.explode(few))
    zeros = grid.select(*by, "label", "pred", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("value"))
    wrong = (
        cells.select(*by, "label", "pred", "n", "value")
        .unionByName(zeros)
        .where("label <> pred")
        .groupBy(*by, "label", "pred")
        .agg(F.max("n").alias("n"), F.max("value").alias("value"))
    )
    order = [F.col("value").desc(), F.col("label").asc(), F.col("pred").asc()]
    if by:
        place = Window.partitionBy(*by).orderBy(*order)
        wrong = wrong.withColumn("_place", F.row_number().over(place))
        wrong = wrong.where(F.col("_place") <= top_n).drop("_place")
    else:
        wrong = wrong.orderBy(*order).limit(top_n)
    return with_class_names(wrong, classes, true_name="label", pred_name="pred")


def worst_classes_by_f1(per_class: DataFrame, top_n: int = 15, by: Sequence[str] = ()) -> DataFrame:
    order = [F.col("f1").asc(), F.col("label_id").asc()]
    if not by:
        return per_class.orderBy(*order).limit(top_n)
    place = Window.partitionBy(*by).orderBy(*order)
    ranked = per_class.withColumn("_place", F.row_number().over(place))
    return ranked.where(F.col("_place") <= top_n).drop("_place")


def agreement(df: DataFrame, teacher: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy against the teacher and against the truth over usable teacher rows.

    ``teacher`` holds ``row_id, teacher_intent_id``; both sides are keyed by the
    unique ``row_id``, so the join spreads evenly.
    """
    usable = teacher.where("teacher_intent_id <> -1").select("row_id", "teacher_intent_id")
    joined = df.join(usable, "row_id")
    return joined.groupBy(*by).agg(
        F.avg((F.col("pred") == F.col("teacher_intent_id")).cast("double")).alias("vs_teacher"),
        F.avg((F.col("pred") == F.col("label")).cast("double")).alias("vs_truth"),
        F.count("*").alias("n"),
    )

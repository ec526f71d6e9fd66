"""Class-balanced multinomial logistic regression on embeddings.

Takes training rows only; evaluation rows are passed to ``predict`` later.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.functions import scores as S
from deskspark.operators.sampling import class_sizes
from deskspark.operators.sizes import computed_now


def _weighted(train: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Labeled rows with ``class_weight``, so that every class weighs the same, and how many they are."""
    labeled = train.where(F.col(label).isNotNull())
    sizes = computed_now(class_sizes(labeled, label))
    n, k = sizes.agg(F.sum("n"), F.count("*")).first()
    weights = sizes.select(label, (F.lit(float(n)) / (F.lit(k) * F.col("n"))).alias("class_weight"))
    return labeled.join(weights, label), n


def train_classifier(
    train: DataFrame,
    embedding: str = "embedding",
    label: str = "label",
    max_iter: int = 1000,
    tolerance: float = 1e-7,
) -> LogisticRegressionModel:
    """L2 penalty of strength 1 on the summed weighted loss, intercept free.

    Spark averages the loss, so the penalty is divided by the total weight,
    which under balanced weights is the row count.
    """
    weighted, n = _weighted(train, label)
    rows = weighted.select(
        F.col(label).cast("double").alias("label"),
        array_to_vector(F.col(embedding).cast("array<double>")).alias("features"),
        "class_weight",
    )
    fit = LogisticRegression(
        family="multinomial",
        weightCol="class_weight",
        regParam=1.0 / n,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tolerance,
    )
    return fit.fit(rows)


def predict_logits(
    model: LogisticRegressionModel, df: DataFrame, embedding: str = "embedding"
) -> DataFrame:
    """Add ``logits``: one decision score per class id."""
    features = df.withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))
    scored = model.transform(features)
    return scored.withColumn("logits", vector_to_array("rawPrediction")).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def penalised_gradient(
    model: LogisticRegressionModel, train: DataFrame, embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """Proof that the fit is the best one: ``label, component, gradient, scale``, component -1 for the intercept.

    The loss that ``train_classifier`` minimises is convex, so the coefficients
    are optimal exactly if its gradient is zero: for each class the weighted sum
    of ``(probability - truth) * x`` over all rows, plus the coefficient. One
    aggregate with a row per class gives it; ``scale`` sums the absolute values
    of the same terms, so ``gradient / scale`` does not grow with the rows. Only
    labels of the model's classes count; a class without rows keeps its line.
    """
    rows, _ = _weighted(train, label)
    scored = predict_logits(model, rows, embedding)
    probs = S.softmax(F.col("logits"))
    residual = F.transform(
        probs, lambda p, i: (p - F.when(i == F.col(label), 1.0).otherwise(0.0)) * F.col("class_weight")
    )
    x = F.concat(F.col(embedding).cast("array<double>"), F.array(F.lit(1.0)))
    each = scored.select(x.alias("_x"), F.posexplode(residual).alias("_class", "_r"))

    def summed(term: Column) -> Column:
        return vector_to_array(Summarizer.sum(array_to_vector(term)))

    sums = each.groupBy("_class").agg(
        summed(F.transform("_x", lambda v: v * F.col("_r"))).alias("_g"),
        summed(F.transform("_x", lambda v: F.abs(v * F.col("_r")))).alias("_s"),
    )
    # One row per class, as large as the model itself.
    fitted = [(k, [*row.tolist(), 0.0]) for k, row in enumerate(model.coefficientMatrix.toArray())]
    weights = train.sparkSession.createDataFrame(fitted, "_class int, _w array<double>")
    joined = weights.join(sums, "_class", "left")
    terms = F.transform(
        F.col("_w"),
        lambda w, i: F.struct(
            F.when(i == F.size("_w") - 1, -1).otherwise(i).alias("component"),
            (F.coalesce(F.get("_g", i), F.lit(0.0)) + w).alias("gradient"),
            (F.coalesce(F.get("_s", i), F.lit(0.0)) + F.abs(w)).alias("scale"),
        ),
    )
    return joined.select(F.col("_class").alias(label), F.inline(terms))


def on_class_list(
    df: DataFrame, seen_ids: list[int], n_classes: int, logits: str = "logits"
) -> DataFrame:
    """Place scores of the classes seen in training on the full class list."""
    seen = F.array(*[F.lit(i) for i in seen_ids])
    return df.withColumn(logits, S.project_classes(F.col(logits), seen, n_classes))

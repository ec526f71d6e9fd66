import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskspark.functions import scores as S


def column(spark, values, expression):
    df = spark.createDataFrame([(v,) for v in values], "z array<double>")
    return [r[0] for r in df.select(expression).collect()]


def test_softmax_matches_numpy(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 50, (20, 6))
    for t in (0.5, 1.0, 3.0):
        e = np.exp(z / t - (z / t).max(1, keepdims=True))
        got = column(spark, z.tolist(), S.softmax(F.col("z"), t))
        np.testing.assert_allclose(got, e / e.sum(1, keepdims=True), atol=1e-14)


def test_softmax_of_minus_infinity_is_zero(spark):
    [p] = column(spark, [[1.0, -math.inf, 1.0]], S.softmax(F.col("z")))
    assert p == [0.5, 0.0, 0.5]


def test_argmax_takes_first_of_ties(spark):
    assert column(spark, [[0.2, 0.4, 0.4], [0.5, 0.1, 0.5]], S.argmax(F.col("z"))) == [1, 0]


def test_top_k_order_ties_and_clamp(spark):
    [r] = column(spark, [[0.1, 0.4, 0.4, 0.1]], S.top_k(F.col("z"), 3))
    assert [x["label_id"] for x in r] == [1, 2, 0] and [x["p"] for x in r] == [0.4, 0.4, 0.1]
    [r] = column(spark, [[0.3, 0.7]], S.top_k(F.col("z"), 9))
    assert [x["label_id"] for x in r] == [1, 0]
    with pytest.raises(ValueError):
        S.top_k(F.col("z"), 0)


def test_one_hot_and_uniform(spark):
    df = spark.createDataFrame([(2,), (-1,)], "c int")
    hot, spread = [r[0] for r in df.select(S.one_hot(F.col("c"), 4)).collect()]
    assert hot == [0.0, 0.0, 1.0, 0.0] and spread == [0.25] * 4


def test_projection_onto_full_class_list(spark):
    ids = F.array(F.lit(3), F.lit(1))
    [full] = column(spark, [[5.0, 7.0]], S.project_classes(F.col("z"), ids, 5))
    assert full == [-math.inf, 7.0, -math.inf, 5.0, -math.inf]


def test_loss_and_derivatives(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(0, 3, (30, 5))
    z[0, 4] = -math.inf
    y = rng.integers(0, 4, 30)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(z, y)], "z array<double>, y int")

    def loss(beta):
        s = z * beta
        return np.log(np.exp(s).sum(1)) - s[np.arange(30), y]

    got = [r[0] for r in df.select(S.log_loss(F.col("z"), F.col("y"), 2.0)).collect()]
    np.testing.assert_allclose(got, loss(0.5), atol=1e-10)
    terms = S.loss_derivatives(S.shifted_scores(F.col("z")), F.col("y"), F.lit(0.7))
    rows = [r[0] for r in df.select(terms).collect()]
    h = 1e-5
    np.testing.assert_allclose([r["slope"] for r in rows], (loss(0.7 + h) - loss(0.7 - h)) / (2 * h), atol=1e-6)
    h = 1e-3
    second = (loss(0.7 + h) - 2 * loss(0.7) + loss(0.7 - h)) / h**2
    np.testing.assert_allclose([r["curvature"] for r in rows], second, rtol=1e-3, atol=1e-4)

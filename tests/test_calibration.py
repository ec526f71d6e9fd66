import numpy as np
import pytest
from pyspark.sql import functions as F

from deskspark.functions import scores as S
from deskspark.operators import calibration as C
from deskspark.operators.metrics import flatten_scores


@pytest.mark.parametrize("n_bins", [1, 2, 7, 10, 15, 20, 100])
def test_bins_match_digitize_on_and_off_edges(spark, n_bins):
    edges = np.linspace(0, 1, n_bins + 1)
    rng = np.random.default_rng(0)
    conf = np.concatenate([edges, np.nextafter(edges, 0), np.nextafter(edges, 2), rng.random(200), np.arange(0, 101) / 100])
    conf = np.clip(conf, 0, 1.0)
    expected = np.clip(np.digitize(conf, edges[1:-1]), 0, n_bins - 1)
    df = spark.createDataFrame([(float(c), int(b)) for c, b in zip(conf, expected)], "conf double, b int")
    wrong = df.where(C.confidence_bin(F.col("conf"), n_bins) != F.col("b")).collect()
    assert wrong == []


def test_ece_of_one_row(spark):
    df = spark.createDataFrame([(0, 0, 0.6)], "label int, pred int, conf double")
    assert C.expected_calibration_error(df, n_bins=10).first()["ece"] == pytest.approx(0.4)


def test_ece_extremes(spark):
    right = spark.createDataFrame([(1, 1, 1.0)] * 5, "label int, pred int, conf double")
    wrong = spark.createDataFrame([(0, 1, 0.99)] * 5, "label int, pred int, conf double")
    assert C.expected_calibration_error(right).first()["ece"] == 0.0
    assert C.expected_calibration_error(wrong).first()["ece"] > 0.9


def test_reliability_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0, 0, 0.95), (1, 0, 0.95), (0, 0, 0.05)], "label int, pred int, conf double")
    rows = C.reliability_bins(df, n_bins=10).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [1] + [0] * 8 + [2]
    assert rows[9]["accuracy"] == 0.5 and rows[9]["mean_confidence"] == pytest.approx(0.95)


def overconfident(n=1500, c=4, factor=8.0, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, c, n)
    z = rng.normal(0, 1, (n, c))
    z[np.arange(n), y] += 1.0
    return z * factor, y


def table(spark, z, y):
    return spark.createDataFrame(
        [(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(z, y))], "row_id long, logits array<double>, label int"
    )


def mean_loss(z, y, t):
    s = z / t
    s = s - s.max(1, keepdims=True)
    return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))


@pytest.mark.parametrize("factor, low, high", [(8.0, 2.0, 100.0), (0.2, 0.05, 1.0)])
def test_temperature_is_the_minimum(spark, factor, low, high):
    z, y = overconfident(factor=factor)
    t = C.fit_temperature(table(spark, z, y))
    assert low < t < high
    best = mean_loss(z, y, t)
    assert all(best <= mean_loss(z, y, u) + 1e-12 for u in np.geomspace(0.05, 100, 400))
    assert all(best <= mean_loss(z, y, t * f) for f in (0.999, 1.001))


def test_temperature_stops_at_its_bounds(spark):
    z, y = overconfident(n=200)
    assert C.fit_temperature(table(spark, z * 0 + np.eye(4)[(y + 1) % 4], y)) == pytest.approx(100.0)
    assert C.fit_temperature(table(spark, np.eye(4)[y], y)) == pytest.approx(0.05)


def test_temperatures_per_group_match_single_fits(spark):
    z, y = overconfident(n=400)
    both = table(spark, z, y).withColumn("part", F.col("row_id") % 2)
    found = {r["part"]: r["temperature"] for r in C.fit_temperatures(both, ["part"]).collect()}
    for part, t in found.items():
        assert t == pytest.approx(C.fit_temperature(both.where(F.col("part") == part)), rel=1e-6)


def test_report_improves_calibration(spark):
    z, y = overconfident()
    df = table(spark, z, y)
    guesses = np.where(np.arange(len(y)) % 10 == 0, -1, y)
    teacher = spark.createDataFrame([(i, int(g)) for i, g in enumerate(guesses)], "row_id long, teacher_intent_id int")
    row = C.calibration_report(df, teacher).first()
    kept = guesses != -1
    assert row["n_val"] == kept.sum() and row["n_bins"] == 15
    assert row["ece_pre"] - row["ece_post"] > 0.05
    accuracy = (z.argmax(1) == y)[kept].mean()
    assert row["val_accuracy_vs_truth"] == pytest.approx(accuracy)
    assert row["val_accuracy_vs_teacher"] == pytest.approx(accuracy)
    flat = flatten_scores(df.join(teacher.where("teacher_intent_id <> -1"), "row_id").withColumn("probs", S.softmax(F.col("logits"))))
    assert row["ece_pre"] == pytest.approx(C.expected_calibration_error(flat).first()["ece"])

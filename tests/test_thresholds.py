import numpy as np
import pytest
from pyspark.sql import functions as F

from deskspark.operators import thresholds as T

SCHEMA = "row_id long, label int, pred int, conf double"


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame([(i, f"c{i}") for i in range(4)], "label_id int, label_name string")


def brute_force(rows, target, n_classes=4):
    """Walk each class by falling confidence, then row id."""
    found = {}
    for c in range(n_classes):
        mine = sorted((r for r in rows if r[2] == c), key=lambda r: (-r[3], r[0]))
        right, best = 0, T.ESCALATE_ALL
        for seen, r in enumerate(mine, 1):
            right += r[1] == c
            if right / seen >= target:
                best = r[3]
        found[c] = best
    return found


def fitted(spark, rows, target, classes):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["label_id"]: r["threshold"] for r in T.fit_thresholds(df, classes, target).collect()}


@pytest.mark.parametrize("seed, steps", [(0, 0), (1, 7), (2, 1), (3, 200)])
def test_fit_matches_brute_force(spark, classes, seed, steps):
    """Distinct confidences, heavy ties, and one hot confidence; class 0 holds most rows."""
    rng = np.random.default_rng(seed)
    n = 900
    conf = rng.random(n) if not steps else rng.integers(0, steps + 1, n) / max(steps, 1)
    pred = np.where(rng.random(n) < 0.6, 0, rng.integers(0, 3, n))
    label = np.where(rng.random(n) < 0.4 + 0.5 * conf, pred, rng.integers(0, 4, n))
    rows = [(i, int(a), int(p), float(c)) for i, (a, p, c) in enumerate(zip(label, pred, conf))]
    for target in (0.3, 0.7, 0.75, 0.9, 1.0):
        assert fitted(spark, rows, target, classes) == brute_force(rows, target), target


def test_known_cases(spark, classes):
    two = [(0, 0, 0, 0.9), (1, 0, 0, 0.8), (2, 1, 0, 0.7)]
    assert fitted(spark, two, 1.0, classes) == {0: 0.8, 1: 1.01, 2: 1.01, 3: 1.01}
    never = [(0, 1, 0, 0.9), (1, 0, 0, 0.8)]
    assert fitted(spark, never, 0.95, classes)[0] == 1.01
    exact = [(i, 0, 0, 0.9 - i / 100) for i in range(19)] + [(19, 1, 0, 0.5)]
    assert fitted(spark, exact, 0.95, classes)[0] == 0.5


@pytest.mark.parametrize("target", [0.0, -0.1, 1.01])
def test_target_must_be_a_share(spark, classes, target):
    with pytest.raises(ValueError):
        fitted(spark, [(0, 0, 0, 0.5)], target, classes)


def test_apply_and_missing_class(spark):
    rows = [(0, 0, 0, 0.9), (1, 1, 0, 0.89), (2, 1, 1, 0.6), (3, 2, 2, 0.79), (4, 3, 3, 1.0)]
    limits = spark.createDataFrame([(0, 0.9), (1, 0.6), (2, 0.8)], "label_id int, threshold double")
    got = T.apply_thresholds(spark.createDataFrame(rows, SCHEMA), limits).orderBy("row_id").collect()
    assert [r["accepted"] for r in got] == [True, False, True, False, False]
    assert got[4]["threshold"] == 1.01


def test_summary_and_routing(spark, classes):
    rows = [(0, 0, 0, 0.9), (1, 1, 0, 0.95), (2, 0, 0, 0.2), (3, 1, 1, 0.7), (4, 2, 1, 0.1)]
    df = spark.createDataFrame(rows, SCHEMA)
    limits = spark.createDataFrame([(0, 0.5), (1, 0.5), (2, 1.01), (3, 1.01)], "label_id int, threshold double")
    found = {r["class_name"]: r for r in T.threshold_summary(df, limits, classes).collect()}
    assert (found["c0"]["n_accepted"], found["c0"]["val_precision"], found["c0"]["val_recall"]) == (2, 0.5, 0.5)
    assert (found["c1"]["n_accepted"], found["c1"]["val_precision"], found["c1"]["val_recall"]) == (1, 1.0, 0.5)
    assert (found["c3"]["n_accepted"], found["c3"]["val_precision"], found["c3"]["val_recall"]) == (0, 0.0, 0.0)
    stats = T.routing_stats(df, limits).first()
    assert (stats["n_rows"], stats["n_accepted"], stats["n_classes_escalate_all"]) == (5, 3, 2)
    assert stats["acceptance_rate"] == 0.6 and stats["precision_among_accepted"] == pytest.approx(2 / 3)


def test_running_precision(spark):
    rows = [(0, 0, 0, 0.5), (1, 1, 0, 0.9), (2, 0, 0, 0.9), (3, 1, 1, 0.1)]
    got = T.running_precision(spark.createDataFrame(rows, SCHEMA)).orderBy("row_id").collect()
    assert [r["running_precision"] for r in got] == [pytest.approx(2 / 3), 0.0, 0.5, 1.0]


def test_only_undecided_rows_are_ordered(spark, classes):
    """All but the rows around the cut are handled as counts."""
    df = spark.range(20000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") < 15000, 0).otherwise(1).alias("label"),
        F.lit(0).alias("pred"),
        (1 - F.col("id") / 20000).alias("conf"),
    )
    spans = T._undecided(df, 0.9, []).collect()
    assert len(spans) == 1 and spans[0]["high"] - spans[0]["low"] <= 3
    assert spans[0]["n_above"] > 16000
    expected = brute_force([tuple(r) for r in df.collect()], 0.9)
    found = {r["label_id"]: r["threshold"] for r in T.fit_thresholds(df, classes, 0.9).collect()}
    assert found == expected

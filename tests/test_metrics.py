import numpy as np
import pytest
from pyspark.sql import functions as F

from deskspark.operators import evaluation, metrics


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "label_id int, label_name string")


def predictions(spark, pairs):
    return spark.createDataFrame([(int(t), int(p)) for t, p in pairs], "label int, pred int")


def test_top_k_accuracy(spark):
    probs = [([0.5, 0.3, 0.2], 0), ([0.5, 0.3, 0.2], 1), ([0.5, 0.3, 0.2], 2), ([0.4, 0.4, 0.2], 1)]
    df = spark.createDataFrame(probs, "probs array<double>, label int")
    found = {k: metrics.top_k_accuracy(df, k).first()["accuracy"] for k in (1, 2, 3, 50)}
    assert found == {1: 0.25, 2: 0.75, 3: 1.0, 50: 1.0}
    with pytest.raises(ValueError):
        metrics.top_k_accuracy(df, 0)


def test_class_scores_keep_absent_classes(spark, classes):
    counts = metrics.confusion_counts(predictions(spark, [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)]))
    rows = {r["class_name"]: r for r in metrics.per_class_metrics(counts, classes).collect()}
    assert [rows[c]["support"] for c in "abcd"] == [2, 2, 1, 0]
    assert rows["a"]["precision"] == 0.5 and rows["a"]["recall"] == 0.5 and rows["a"]["f1"] == 0.5
    assert rows["b"]["precision"] == pytest.approx(2 / 3) and rows["b"]["recall"] == 1.0
    assert rows["c"]["f1"] == 0.0 and rows["d"]["f1"] == 0.0 and rows["d"]["top1_accuracy"] == 0.0
    macro = metrics.macro_f1(counts, classes).first()["macro_f1"]
    assert macro == pytest.approx((0.5 + 0.8 + 0 + 0) / 4)


def test_confusion_rows_sum_to_one_or_zero(spark, classes):
    counts = metrics.confusion_counts(predictions(spark, [(0, 0), (0, 1), (1, 1), (2, 0)]))
    matrix = metrics.confusion_matrix(counts, classes)
    assert matrix.count() == 16
    sums = {r["label"]: r["s"] for r in matrix.groupBy("label").agg(F.sum("value").alias("s")).collect()}
    assert sums == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0}
    plain = metrics.confusion_matrix(counts, classes, normalize=False)
    assert plain.agg(F.sum("value")).first()[0] == 4.0


def test_top_pairs_rank_and_zero_tail(spark, classes):
    pairs = [(2, 1)] * 3 + [(2, 2)] * 2 + [(0, 1)] + [(0, 0)] * 4 + [(1, 1)]
    counts = metrics.confusion_counts(predictions(spark, pairs))
    top = metrics.top_confusion_pairs(counts, classes, 20).orderBy(F.desc("value"), "label", "pred").collect()
    assert len(top) == 12
    assert (top[0]["true_name"], top[0]["pred_name"], top[0]["value"]) == ("c", "b", 0.6)
    assert (top[1]["true_name"], top[1]["pred_name"], top[1]["value"]) == ("a", "b", 0.2)
    assert top[2]["value"] == 0.0
    assert metrics.top_confusion_pairs(counts, classes, 1).count() == 1


def test_worst_classes_are_stable(spark, classes):
    counts = metrics.confusion_counts(predictions(spark, [(0, 0), (1, 0), (2, 2), (2, 2)]))
    worst = metrics.worst_classes_by_f1(metrics.per_class_metrics(counts, classes), 3).collect()
    assert [r["class_name"] for r in worst] == ["b", "d", "a"]


def test_agreement_drops_unknown_teacher_rows(spark):
    rows = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 1)], "row_id long, label int, pred int")
    teacher = spark.createDataFrame([(1, 0), (2, 0), (3, -1)], "row_id long, teacher_intent_id int")
    found = metrics.agreement(rows, teacher).first()
    assert (found["vs_teacher"], found["vs_truth"], found["n"]) == (1.0, 0.5, 2)


def test_evaluation_tables_agree_with_single_metrics(spark, classes):
    rng = np.random.default_rng(4)
    rows = [
        (m, int(i), int(rng.integers(4)), int(rng.integers(3)), float(rng.random()), float(rng.gamma(2, 30)))
        for m in ("x", "y")
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "model string, row_id long, label int, pred int, conf double, latency_ms double")
    tables = evaluation.evaluation_tables(df, classes)
    from deskspark.operators import calibration, cost

    whole = {r["model"]: r for r in tables["metrics"].collect()}
    errors = {r["model"]: r["ece"] for r in calibration.expected_calibration_error(df, ["model"]).collect()}
    costs = {r["model"]: r["cost_per_1k_usd"] for r in cost.student_cost_per_1k(df, ["model"]).collect()}
    f1 = {r["model"]: r["macro_f1"] for r in metrics.macro_f1(metrics.confusion_counts(df, ["model"]), classes, ["model"]).collect()}
    for m in ("x", "y"):
        mine = [r for r in rows if r[0] == m]
        assert whole[m]["n"] == 300
        assert whole[m]["top_1_accuracy"] == pytest.approx(np.mean([r[2] == r[3] for r in mine]))
        assert whole[m]["ece"] == pytest.approx(errors[m])
        assert whole[m]["macro_f1"] == pytest.approx(f1[m])
        assert whole[m]["cost_per_1k_usd"] == pytest.approx(costs[m])
        assert whole[m]["latency_ms_p95"] == pytest.approx(np.percentile([r[5] for r in mine], 95))
    assert tables["per_class"].count() == 8


def test_twenty_thousand_classes(spark):
    n = 20_000
    many = spark.range(n).select(F.col("id").cast("int").alias("label_id"), F.concat(F.lit("c"), "id").alias("label_name"))
    rows = spark.range(3 * n).select((F.col("id") % n).cast("int").alias("label"), (F.col("id") * 7 % n).cast("int").alias("pred"))
    counts = metrics.confusion_counts(rows)
    per_class = metrics.per_class_metrics(counts, many)
    assert per_class.count() == n and per_class.where("class_name IS NULL").count() == 0
    top = metrics.top_confusion_pairs(counts, many, 20).collect()
    assert len(top) == 20 and all(r["value"] > 0 for r in top)
    few = metrics.top_confusion_pairs(counts.where("label = pred"), many, 5).orderBy("label", "pred").collect()
    assert [(r["label"], r["pred"]) for r in few] == [(0, i) for i in range(1, 6)]


def test_names_of_many_classes(spark):
    from deskspark.operators import scoring

    n = 20_000
    many = spark.range(n).select(F.col("id").cast("int").alias("label_id"), F.concat(F.lit("c"), "id").alias("label_name"))
    probs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == 19_998, 0.9).otherwise(0.0))
    row = scoring.top_classes(spark.range(1).select(probs.alias("probs")), many, 2).first()
    assert (row["predicted_intent"], row["top_k_intents"]) == ("c19998", ["c19998", "c0"])

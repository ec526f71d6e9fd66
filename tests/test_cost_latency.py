import json

import pytest
from pyspark.sql import functions as F

from deskspark.operators import cost as C
from deskspark.session import run_folder
from deskspark.sources import latency as S


def tokens(spark, rows):
    return spark.createDataFrame(rows, "input_tokens long, output_tokens long")


def test_teacher_cost(spark):
    assert C.teacher_cost_per_1k(tokens(spark, [(1000, 10)])).first()["cost_per_1k_usd"] == pytest.approx(0.325)
    assert C.teacher_cost_per_1k(tokens(spark, [(2000, 20)] * 7)).first()["cost_per_1k_usd"] == pytest.approx(0.65)
    assert C.teacher_cost_per_1k(tokens(spark, [])).first()["cost_per_1k_usd"] == 0.0


def test_student_cost(spark):
    def of(values, **shape):
        df = spark.createDataFrame([(v,) for v in values], "latency_ms double")
        return C.student_cost_per_1k(df, **shape).first()["cost_per_1k_usd"]

    assert of([100.0]) == pytest.approx(0.0033)
    assert of([100.0] * 9) == pytest.approx(0.0033)
    fee = 0.40 / 1000
    assert of([200.0]) - fee == pytest.approx(2 * (of([100.0]) - fee))
    assert of([100.0], vcpu=2.0, memory_gib=4.0) - fee == pytest.approx(2 * (of([100.0]) - fee))
    assert of([0.0]) == pytest.approx(fee) and of([]) == 0.0


def breakdown(spark, **costs):
    df = spark.createDataFrame(list(costs.items()), "model string, cost_per_1k_usd double")
    return C.cost_breakdown(df).first()


def test_breakdown(spark):
    row = breakdown(spark, teacher=0.325, student=0.0033, baseline=0.001)
    assert row["pricing_date"] == "2026-05" and row["note"] is None
    assert row["student_cost_reduction_vs_teacher_x"] == 98.5
    assert row["baseline_cost_reduction_vs_teacher_x"] == 325.0
    assert breakdown(spark, teacher=0.3, student=0.0)["student_cost_reduction_vs_teacher_x"] is None
    assert breakdown(spark, teacher=0.3, student=0.1)["baseline_cost_per_1k_usd"] is None
    skipped = breakdown(spark, student=0.1, baseline=0.1)
    assert skipped["note"] == C.SKIPPED_NOTE and skipped["student_cost_per_1k_usd"] is None


def test_estimate(spark):
    block = spark.createDataFrame([("x" * 403,)], "taxonomy_block string")
    row = C.estimate_cost(spark.range(50), block).first()
    assert (row["n_rows"], row["avg_input_tokens"], row["avg_output_tokens"]) == (50, 180, 15)
    assert row["estimated_usd"] == pytest.approx(50 * (180 * 0.30 + 15 * 2.50) / 1e6)


LOAD_TEST = {
    "model": "student",
    "deployment_run_id": "r1",
    "vcpu": 1.0,
    "memory_gib": 2.0,
    "per_example_latency_ms": [120.5, 130.0, 99.5],
    "sampled_at_utc": "2026-05-15T00:00:00Z",
}


@pytest.fixture
def written(tmp_path):
    def write(**changes):
        data = {k: v for k, v in {**LOAD_TEST, **changes}.items() if v is not ...}
        path = tmp_path / "latency.json"
        path.write_text(json.dumps(data, indent=2))
        return str(path)

    return write


def test_latency_file(spark, written):
    rows = S.read_latencies(spark, written()).collect()
    assert sorted(r["latency_ms"] for r in rows) == [99.5, 120.5, 130.0]
    assert {(r["model"], r["vcpu"], r["memory_gib"]) for r in rows} == {("student", 1.0, 2.0)}


@pytest.mark.parametrize("missing", sorted(LOAD_TEST))
def test_latency_file_needs_every_key(spark, written, missing):
    with pytest.raises(ValueError, match=missing):
        S.read_latencies(spark, written(**{missing: ...}))


def test_latency_file_without_samples(spark, written):
    with pytest.raises(ValueError, match="list of samples is empty"):
        S.read_latencies(spark, written(per_example_latency_ms=[]))


def test_latency_source(spark, written):
    own = spark.createDataFrame([("student", 5.0), ("baseline", 7.0)], "model string, latency_ms double")
    chosen = S.with_latency_source(own, S.read_latencies(spark, written()))
    got = sorted(tuple(r) for r in chosen.collect())
    assert got == [
        ("baseline", 7.0, "laptop_dev"),
        ("student", 99.5, "cloud_run_load_test"),
        ("student", 120.5, "cloud_run_load_test"),
        ("student", 130.0, "cloud_run_load_test"),
    ]
    other = S.with_latency_source(own.where(F.col("model") == "baseline"), S.read_latencies(spark, written()))
    assert [tuple(r) for r in other.collect()] == [("baseline", 7.0, "laptop_dev")]


def test_result_documents(spark):
    from deskspark.sources import results as R

    limits = spark.createDataFrame([(0, 0.8), (1, 1.01)], "label_id int, threshold double")
    summary = spark.createDataFrame(
        [(0, "a", 0.8, 0.9, 0.5, 10), (1, "b", 1.01, 0.0, 0.0, 0)],
        "label_id int, class_name string, fitted_threshold double, val_precision double, val_recall double, n_accepted long",
    )
    path = run_folder(spark, "thresholds")
    R.write_thresholds(limits, summary, 0.9, 40, path)
    assert sorted(map(tuple, R.read_thresholds(spark, path).collect())) == [(0, 0.8), (1, 1.01)]
    row = spark.read.schema(R.THRESHOLD_DOCUMENT).json(path).first()
    assert (row["target_precision"], row["n_val_examples"], row["escalate_all_threshold"]) == (0.9, 40, 1.01)
    assert [r["class_name"] for r in row["per_class_summary"]] == ["a", "b"]
    marks = [R.settings_mark(R.settings_column(c)) for c in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 1, "b": 3})]
    first, second, third = spark.range(1).select(*marks).first()
    assert first == second != third


def test_price_sheet(spark, tmp_path):
    from deskspark.sources.prices import DEFAULT_PRICES, read_prices

    told = {"pricing_date": "2027-01", **{k: 1.5 for k in [*DEFAULT_PRICES.teacher, *DEFAULT_PRICES.serving]}}
    path = tmp_path / "sheet.json"
    path.write_text(json.dumps(told))
    sheet = read_prices(spark, str(path))
    assert (sheet.pricing_date, set(sheet.teacher.values()), len(sheet.serving)) == ("2027-01", {1.5}, 3)
    path.write_text(json.dumps({**told, "pricing_date": None}))
    with pytest.raises(ValueError, match="pricing_date"):
        read_prices(spark, str(path))

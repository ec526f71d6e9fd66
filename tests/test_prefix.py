import numpy as np
import pytest
from pyspark.sql import functions as F

from deskspark.operators import prefix, sizes
from deskspark.operators.prefix import exact_percentiles, running_totals


@pytest.mark.parametrize("slices", [1, 3, 7])
def test_running_totals_with_a_hot_key(spark, slices):
    rng = np.random.default_rng(2)
    keys = np.where(rng.random(600) < 0.6, 0, rng.integers(1, 5, 600))
    rows = [(int(k), int(i), int(v)) for i, (k, v) in enumerate(zip(keys, rng.integers(0, 9, 600)))]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    got = running_totals(df, ["k"], ["-i"], ["v"], slices).collect()
    assert len(got) == 600
    seen, expected = {}, {}
    for k, i, v in sorted(rows, key=lambda r: -r[1]):
        seen[k] = expected[i] = seen.get(k, 0) + v
    assert {r["i"]: r["running_v"] for r in got} == expected


def test_hot_key_is_spread_over_slices(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.lit(1).alias("v"))
    placed = running_totals(df, ["k"], ["i"], ["v"], 8)
    sizes = placed.select(F.floor(F.col("running_v") / 500).alias("part")).groupBy("part").count()
    assert sizes.count() >= 8
    assert placed.agg(F.max("running_v")).first()[0] == 4000


def test_running_totals_without_key_and_with_null_key(spark):
    df = spark.createDataFrame([(None, 2, 1), (None, 1, 5), (3, 1, 7)], "k int, i int, v int")
    got = running_totals(df, ["k"], ["i"], ["v"]).collect()
    assert sorted((str(r["k"]), r["i"], r["running_v"]) for r in got) == [("3", 1, 7), ("None", 1, 5), ("None", 2, 6)]
    whole = running_totals(df.where("k IS NULL"), [], ["i"], ["v"]).orderBy("i").collect()
    assert [r["running_v"] for r in whole] == [5, 6]


@pytest.mark.parametrize("steps, small", [(4096, 1 << 25), (8, 1 << 25), (1, 0), (4096, 0)])
def test_percentiles_match_numpy(spark, monkeypatch, steps, small):
    """With fine and coarse codes, and with counts in one partition or spread."""
    monkeypatch.setattr(prefix, "CODE_STEPS", steps)
    monkeypatch.setattr(sizes, "SMALL_BYTES", small)
    rng = np.random.default_rng(3)
    data = {"a": rng.gamma(2, 50, 501), "b": np.repeat([7.0, 9.0], [90, 10]), "c": np.array([4.5])}
    data["d"] = np.concatenate([-rng.gamma(2, 50, 200), [0.0, -0.0, 1e-320, -1e300, 1e300], rng.normal(0, 1e-9, 200)])
    rows = [(m, float(v)) for m, vs in data.items() for v in vs] + [("a", None), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "m string, v double")
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r["m"]: r for r in exact_percentiles(df, "v", wanted, ["m"]).collect()}
    for m, vs in [*data.items(), (None, np.array([3.0, 4.0]))]:
        for name, q in wanted.items():
            assert got[m][name] == pytest.approx(np.percentile(vs, 100 * q), rel=1e-12, abs=1e-300)
    [row] = exact_percentiles(df, "v", wanted).collect()
    everything = np.concatenate([*data.values(), [3.0, 4.0]])
    assert row["p95"] == pytest.approx(np.percentile(everything, 95), abs=1e-9)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    [row] = exact_percentiles(df, "v", {"p50": 0.5}).collect()
    assert row["p50"] is None


def test_codes_never_fall_where_values_rise(spark):
    rng = np.random.default_rng(8)
    tiny, huge = np.finfo(float).smallest_subnormal, np.finfo(float).max
    values = np.concatenate([10.0 ** rng.uniform(-320, 308, 3000), 5.0 + rng.uniform(0, 1e-9, 500), [tiny, huge, 0.0, 1.0, np.inf]])
    ordered = np.sort(np.concatenate([values, -values, np.nextafter(values[:2000], np.inf)])).tolist()
    rows = spark.createDataFrame(list(enumerate([*ordered, float("nan")])), "i int, v double").repartition(4)
    codes = [r[0] for r in rows.orderBy("i").select(prefix.value_code(F.col("v"))).collect()]
    assert codes == sorted(codes) and len(set(codes)) > 5000


def test_percentiles_with_infinite_values(spark):
    df = spark.createDataFrame([(float(v),) for v in ("-inf", "1", "2", "inf", "nan")], "v double")
    row = exact_percentiles(df, "v", {"p25": 0.25, "p50": 0.5, "p0": 0.0}).first()
    assert (row["p25"], row["p50"]) == (1.0, 2.0)


def test_only_values_near_the_percentiles_are_ranked(spark, monkeypatch):
    seen = []
    whole = prefix.computed_small
    monkeypatch.setattr(prefix, "computed_small", lambda df: seen.append(whole(df)) or seen[-1])
    df = spark.range(1, 100_001).select(F.col("id").cast("double").alias("v"))
    assert exact_percentiles(df, "v", {"p50": 0.5, "p99": 0.99}).first()["p99"] == pytest.approx(99000.01)
    assert seen[1].count() < 200


def test_few_jobs(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("m"), F.col("id").cast("double").alias("v"))
    spark.sparkContext.setJobGroup("percentiles", "few")
    exact_percentiles(df, "v", {"p50": 0.5, "p99": 0.99}, ["m"]).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("percentiles")
    spark.sparkContext.setJobGroup("other", "after")
    assert len(jobs) <= 6

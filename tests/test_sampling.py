import pytest
from pyspark.sql import functions as F

from deskspark.operators import sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    """Class 0 holds a third of the rows, 5 is rare."""
    label = (
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") >= 2990, 5).otherwise(1 + F.col("id") % 4)
    ).cast("int")
    return spark.range(3000).select(F.col("id").alias("row_id"), label.alias("label")).cache()


def sizes(df):
    return {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}


def ids(df):
    return {r["row_id"] for r in df.select("row_id").collect()}


def quotas(spark, sizes, n):
    kind = "string" if isinstance(next(iter(sizes)), str) else "int"
    table = spark.createDataFrame(list(sizes.items()), f"label {kind}, n long")
    return {r["label"]: r["quota"] for r in S.quotas(table, n).collect()}


def test_quotas_use_largest_remainders(spark):
    assert quotas(spark, {"a": 50, "b": 30, "c": 20}, 10) == {"a": 5, "b": 3, "c": 2}
    assert quotas(spark, {"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}
    assert sum(quotas(spark, {i: 7 + i for i in range(77)}, 300).values()) == 300


@pytest.mark.parametrize("rows_per_bucket", [100_000, 50, 3])
def test_subsample_size_and_proportions(spark, rows, rows_per_bucket):
    """Any number of ticket buckets picks the same rows: the lowest tickets of each class."""
    picked = S.stratified_subsample(rows, 301, rows_per_bucket=rows_per_bucket)
    whole = sizes(rows)
    assert sizes(picked) == {c: q for c, q in quotas(spark, whole, 301).items() if q}
    for label, quota in quotas(spark, whole, 301).items():
        lowest = rows.where(F.col("label") == label).orderBy(S.ticket(42), "row_id").limit(quota)
        assert ids(picked.where(F.col("label") == label)) == ids(lowest)


def test_subsample_edges(rows):
    assert S.stratified_subsample(rows, 3000).count() == 3000
    assert S.stratified_subsample(rows, 9999).count() == 3000
    assert S.stratified_subsample(rows, 4).count() == 4
    assert S.stratified_subsample(rows, 0).count() == 0


def test_seed_decides(rows):
    a, b, c = (ids(S.stratified_subsample(rows, 200, seed)) for seed in (1, 1, 2))
    assert a == b != c


def test_split_shares(rows):
    split = S.stratified_split(rows, 0.1, rows_per_bucket=20).cache()
    parts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert parts == {"val": 300, "train": 2700}
    assert S.class_drift(split, "train", "val").first()[0] < 0.02
    again = S.stratified_split(rows.repartition(7), 0.1)
    assert ids(split.where("split = 'val'")) == ids(again.where("split = 'val'"))


def test_sample_moves_no_rows_of_the_result(rows):
    plan = S.stratified_subsample(rows, 300)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Window" not in plan


def test_shared_texts(spark):
    data = [("train", "a"), ("train", "a"), ("val", "a"), ("golden", "b"), ("val", "b"), ("train", "c")]
    df = spark.createDataFrame(data, "split string, text string")
    found = {(r[0], r[1]): r[2] for r in S.shared_texts(df, ["train", "val", "golden"]).collect()}
    assert found == {("train", "val"): 1, ("train", "golden"): 0, ("val", "golden"): 1}


def test_quality(spark):
    df = spark.createDataFrame([("a", "x", 0), ("a", None, 1), ("b", "y", None)], "split string, text string, label int")
    got = {r["split"]: tuple(r)[1:] for r in S.dataset_quality(df).collect()}
    assert got == {"a": (2, 1, 0, 2, 0, 1), "b": (1, 0, 1, 0, None, None)}


def test_many_classes_and_rows_without_a_label(spark):
    many = spark.range(60_000).select(F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id") % 20_000).alias("label"))
    split = S.stratified_split(many, 0.5)
    assert split.where("split = 'val'").count() == 30_000
    odd = many.limit(100).withColumn("label", F.when(F.col("row_id") >= 40, F.col("row_id") % 2))
    parts = {(r["label"], r["split"]): r["count"] for r in S.stratified_split(odd, 0.5).groupBy("label", "split").count().collect()}
    assert parts == {(None, "val"): 20, (None, "train"): 20, (0, "val"): 15, (0, "train"): 15, (1, "val"): 15, (1, "train"): 15}

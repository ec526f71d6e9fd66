import uuid

import pytest
from pyspark.sql import functions as F

from deskspark.operators import metrics
from deskspark.session import run_folder
from deskspark.sources.bucketed import open_bucketed, write_bucketed


def named(name):
    return f"{name}_{uuid.uuid4().hex}"


@pytest.fixture
def no_broadcast(spark):
    """Small tables would be broadcast otherwise, which tells nothing about large ones."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    yield
    spark.conf.set(setting, before)


def test_agreement_moves_no_rows(spark, no_broadcast):
    rows = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("label"))
    scores = rows.select(F.lit("m").alias("model"), "row_id", "label", F.lit(1).alias("pred"))
    teacher = rows.select("row_id", (F.col("row_id") % 4 - 1).cast("int").alias("teacher_intent_id"))
    plain = metrics.agreement(scores, teacher, ["model"]).collect()
    path, names = run_folder(spark, "by-row"), [named("scores"), named("labels")]
    stored = [write_bucketed(t, n, f"{path}/{n}", ["row_id"], 4) for t, n in zip((scores, teacher), names)]
    found = metrics.agreement(*stored, ["model"])
    assert found.collect() == plain
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert "hashpartitioning(row_id" not in plan and plan.count("Exchange") <= 1 + plan.count("== Initial Plan ==")
    # Known again after the catalog forgot them, as in another session.
    for n, t in zip(names, stored):
        spark.sql(f"DROP TABLE {n}")
    again = [open_bucketed(spark, n, f"{path}/{n}", t.schema, ["row_id"], 4) for n, t in zip(names, stored)]
    found = metrics.agreement(*again, ["model"])
    assert found.collect() == plain
    assert "hashpartitioning(row_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_odd_names_and_empty_tables(spark):
    path, name = run_folder(spark, "by-row"), named("odd")
    rows = spark.createDataFrame([(None, 1), ("x", 2), ("x", 2)], "`a key` string, `n n` int")
    table = write_bucketed(rows, name, f"{path}/full", ["a key"], 3)
    spark.sql(f"DROP TABLE {name}")
    again = open_bucketed(spark, name, f"{path}/full", table.schema, ["a key"], 3)
    assert sorted(again.collect(), key=repr) == sorted(rows.collect(), key=repr)
    assert write_bucketed(rows.limit(0), named("empty"), f"{path}/none", ["a key"], 3).count() == 0

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from deskspark.operators import scoring
from deskspark.plans import tables as P
from deskspark.plans.queries import QUERIES
from deskspark.schemas import AUDIT, REJECTED
from deskspark.session import run_folder
from deskspark.sources.files import located
from deskspark.streaming import scoring as streaming

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SMALL = "/root/testdata/sf0.001"
SCHEMA = "request_id string, text string"
ROWS = [("r1", " the and of "), ("", " le la de "), (None, " der die und "), ("r4", ""), (None, None), (None, "x" * 2001)]


def predict(spark):
    return lambda df: scoring.predict_messages(df, P.language_classes(spark), P.SALT, "v1", P.language_logits)


def written(spark, rows=ROWS):
    source = run_folder(spark, "in")
    for some in (rows[:3], rows[3:]):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    return source


def tables(spark, path):
    return [
        streaming.read_output(spark, path, name, schema).collect()
        for name, schema in (("scored", AUDIT), ("rejected", REJECTED))
    ]


def start(spark, source, path, state):
    messages = streaming.stream_files(spark, source, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1, positions=True)
    return streaming.start_scoring_and_rejecting(messages, predict(spark), "v1", path, state, once=True)


def test_one_read_gives_both_tables(spark):
    source, path, state = written(spark), run_folder(spark, "out"), run_folder(spark, "state")
    assert tables(spark, path) == [[], []]
    job = start(spark, source, path, state)
    job.awaitTermination()
    scored, rejected = tables(spark, path)
    assert sorted(r.predicted_intent for r in scored) == ["english", "french", "german"]
    assert sorted(r.reason for r in rejected) == ["empty", "no text", "too long"]
    # Every row of the source was read once for the two tables.
    assert sum(p["numInputRows"] for p in job.recentProgress) == len(ROWS)
    ids = [r.request_id for r in scored + rejected]
    assert len(set(ids)) == len(ROWS) and {"r1", "r4"} < set(ids) and "" not in ids
    start(spark, source, path, state).awaitTermination()
    assert [len(t) for t in tables(spark, path)] == [3, 3]


def test_a_batch_that_runs_again_adds_nothing(spark):
    path, batch = run_folder(spark, "out"), spark.createDataFrame(ROWS, SCHEMA)
    fail = [True]

    def outputs(df):
        yielded = {"scored": streaming.audit_rows(predict(spark)(df))}
        if fail[0]:
            bad = F.raise_error(F.lit("the second table failed")).cast("string")
            return {**yielded, "rejected": scoring.rejected_messages(df, "v1").withColumn("reason", bad)}
        return {**yielded, "rejected": scoring.rejected_messages(df, "v1")}

    def run(number):
        streaming.write_outputs(batch, number, outputs, path, "s", {"scored": ["event_date"]})

    with pytest.raises(Exception, match="second table failed"):
        run(0)
    # The first table was written, but the batch did not finish.
    assert tables(spark, path) == [[], []] and streaming.finished_batch(spark, path, "s") == -1
    fail[0] = False
    run(0)
    once = [len(t) for t in tables(spark, path)]
    run(0)
    assert once == [3, 3] == [len(t) for t in tables(spark, path)]
    run(1)
    assert [len(t) for t in tables(spark, path)] == [6, 6]
    assert streaming.finished_batch(spark, path, "s") == 1


def test_another_checkpoint_keeps_what_is_there(spark):
    source, path = written(spark), run_folder(spark, "out")
    for _ in range(2):
        start(spark, source, path, run_folder(spark, "state")).awaitTermination()
    assert [len(t) for t in tables(spark, path)] == [6, 6]


def test_ids_do_not_change_when_a_task_runs_again(spark):
    source = written(spark, [(None, f"text {i}") for i in range(40)])

    def ids():
        rows = spark.read.schema(SCHEMA).parquet(source).withColumn(scoring.POSITION, scoring.source_position())
        return rows.select("text", scoring.request_id(F.col("request_id"), F.col(scoring.POSITION)).alias("id"))

    first = {r.text: r.id for r in ids().collect()}
    assert {r.text: r.id for r in ids().repartition(7).collect()} == first and len(set(first.values())) == 40
    assert all(len(i) == 36 and i[14] == i[19] == "8" for i in first.values())
    # Without a position the id is random.
    loose = spark.read.schema(SCHEMA).parquet(source).select("text", scoring.request_id(F.col("request_id")).alias("id"))
    assert not {r.id for r in loose.collect()} & set(first.values())


@pytest.mark.parametrize("name", ["own_redactor_and_writer", "stream_outputs", "stream_scoring"])
def test_streamed_tables_may_be_folders(spark, name):
    found = []
    for folder in (SMALL, run_folder(spark, "sf")):
        if folder != SMALL:
            P.read(spark, SMALL, "conversations").repartition(3).write.parquet(f"{folder}/conversations.parquet")
        found.append(sorted(QUERIES[name](spark, folder).collect(), key=str))
    assert found[0] and found[0] == found[1]


def test_a_table_without_files_gives_no_audit_rows(spark):
    folder = run_folder(spark, "sf")
    files, place = located(spark, f"{folder}/conversations.parquet")
    files.mkdirs(place)
    assert QUERIES["own_redactor_and_writer"](spark, folder).collect() == []

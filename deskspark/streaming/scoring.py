"""Streaming scoring: messages in, audit rows out, with the batch transform."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from deskspark.operators.scoring import POSITION, rejected_messages, source_position
from deskspark.sources.audit import audit_rows
from deskspark.sources.files import located, names_in, path_exists, remove

#: Folders beside the outputs: finished batches, and the name of a checkpoint's stream.
LEDGER, STREAM_NAME = "_finished", "outputs-of"


def stream_files(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    file_glob: str = "*.parquet",
    files_per_batch: int | None = 1_000,
    positions: bool = False,
) -> DataFrame:
    """New Parquet files of a folder as a stream, with a declared schema.

    ``files_per_batch`` bounds a micro-batch, so that a long backlog commits in
    steps. ``positions`` adds where each row lies, from which requests without an
    id get one that does not change when a batch runs again.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(folder)
    return rows.withColumn(POSITION, source_position()) if positions else rows


def stream_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One Parquet table as a stream: a folder of files, or a single file among others."""
    files, place = located(spark, path)
    if files.getFileStatus(place).isDirectory():
        return stream_files(spark, path, schema, "*")
    return stream_files(spark, place.getParent().toString(), schema, place.getName())


def start_scoring(
    messages: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    audit_path: str,
    checkpoint: str,
    once: bool = False,
    interval: str = "10 seconds",
    write: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Append the audit rows of a message stream, partitioned by day.

    ``write`` replaces the file sink: it gets each batch of audit rows with the
    batch's number, and may see a batch again after a failure.

    ``predict`` is the batch transform. The checkpoint and the file sink's log
    make each message's row appear once, also after a restart.
    """
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    rows = audit_rows(predict(messages))
    if write is not None:
        writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return writer.trigger(**trigger).start()
    return (
        rows.writeStream.format("parquet")
        .option("path", audit_path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("event_date")
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def start_rejecting(
    messages: DataFrame,
    model_version: str,
    path: str,
    checkpoint: str,
    once: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Append the messages of a stream that are not scored, so that every request leaves a row."""
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return (
        rejected_messages(messages, model_version)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def _stream_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that belongs to a checkpoint: batch numbers begin anew with another one."""
    folder = f"{checkpoint}/{STREAM_NAME}"
    found = names_in(spark, folder)
    if not found:
        files, place = located(spark, f"{folder}/{uuid.uuid4().hex}")
        files.mkdirs(place)
        found = names_in(spark, folder)
    return found[0]


def finished_batch(spark: SparkSession, path: str, stream: str) -> int:
    """The last batch of a stream whose outputs are all there; -1 before the first."""
    return max((int(n) for n in names_in(spark, f"{path}/{LEDGER}/{stream}") if n.isdecimal()), default=-1)


def _finish(spark: SparkSession, path: str, stream: str, batch: int) -> None:
    folder = f"{path}/{LEDGER}/{stream}"
    files, place = located(spark, f"{folder}/{batch}")
    files.mkdirs(place)
    for name in names_in(spark, folder):
        if name.isdecimal() and int(name) < batch:
            remove(spark, f"{folder}/{name}")


def start_outputs(
    messages: DataFrame,
    outputs: Callable[[DataFrame], Mapping[str, DataFrame]],
    path: str,
    checkpoint: str,
    once: bool = False,
    interval: str = "10 seconds",
    partition_by: Mapping[str, Sequence[str]] | None = None,
) -> StreamingQuery:
    """One stream, several tables: every table that ``outputs`` makes of a batch goes to ``<path>/<name>``.

    The source is read once per batch, whatever the number of tables. Each batch
    writes into folders of its own and is entered as finished when all of them
    are there. A batch that runs again after a failure replaces what it left
    behind, and adds nothing if it had finished; ``read_output`` shows finished
    batches only, so the tables always agree with each other.
    """
    spark = messages.sparkSession
    stream = _stream_name(spark, checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": interval}

    def write(batch: DataFrame, number: int) -> None:
        write_outputs(batch, number, outputs, path, stream, partition_by or {})

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def write_outputs(
    batch: DataFrame,
    number: int,
    outputs: Callable[[DataFrame], Mapping[str, DataFrame]],
    path: str,
    stream: str,
    partition_by: Mapping[str, Sequence[str]],
) -> None:
    """One batch of ``start_outputs``."""
    spark = batch.sparkSession
    if number <= finished_batch(spark, path, stream):
        return
    batch = batch.persist()
    try:
        for name, rows in outputs(batch).items():
            writer = rows.write.mode("overwrite").partitionBy(*partition_by.get(name, ()))
            writer.parquet(f"{path}/{name}/stream={stream}/batch={number}")
    finally:
        batch.unpersist()
    _finish(spark, path, stream, number)


def read_output(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    """Rows of one output from finished batches, without the columns that name stream and batch."""
    streams = names_in(spark, f"{path}/{LEDGER}")
    if not streams or not path_exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    named = [T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())]
    rows = spark.read.schema(StructType([*schema.fields, *named])).parquet(f"{path}/{name}")
    done = [(F.col("stream") == s) & (F.col("batch") <= finished_batch(spark, path, s)) for s in streams]
    return rows.where(reduce(Column.__or__, done)).select(*schema.names)


def start_scoring_and_rejecting(
    messages: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    model_version: str,
    path: str,
    checkpoint: str,
    once: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Scored and rejected messages from one read of the source, as ``scored`` and ``rejected`` below ``path``."""

    def outputs(batch: DataFrame) -> dict[str, DataFrame]:
        return {"scored": audit_rows(predict(batch)), "rejected": rejected_messages(batch, model_version)}

    return start_outputs(messages, outputs, path, checkpoint, once, interval, {"scored": ["event_date"]})

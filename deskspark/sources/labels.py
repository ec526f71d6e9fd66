"""Label tables: guarded reads, partitioned writes, run look-up, checkpoints."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskspark.operators.labeling import drop_unknown
from deskspark.schemas import CALL_FAILURES, TEACHER_LABELS, TEACHER_RESPONSES, UNKNOWN_ID
from deskspark.session import run_folder
from deskspark.sources.files import names_in, path_exists, remove

#: Folder name of a null in a partitioned table.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
SPLITS = ("val", "golden", "train")


def split_guard(df: DataFrame, expected: str) -> DataFrame:
    """One row: which splits a table spans, and whether it is only ``expected``.

    Least and greatest value decide it, so the check stays one row per task
    even for a column full of junk.
    """
    return df.agg(
        F.count("*").alias("n_rows"),
        F.min("split").alias("first_split"),
        F.max("split").alias("last_split"),
        F.count_if(F.col("split").isNull()).alias("null_splits"),
    ).withColumns(
        {
            "expected_split": F.lit(expected),
            "ok": F.coalesce(
                (F.col("n_rows") > 0)
                & (F.col("first_split") == expected)
                & (F.col("last_split") == expected)
                & (F.col("null_splits") == 0),
                F.lit(False),
            ),
        }
    )


def _assert_split(df: DataFrame, expected: str, where: str) -> None:
    row = split_guard(df, expected).first()
    if not row["ok"]:
        raise ValueError(_wrong_split(expected, where, row["first_split"], row["last_split"], row["null_splits"]))


def _wrong_split(expected: str, where: str, first: str, last: str, nulls: int) -> str:
    return f"{where} should hold split={expected!r} alone; it holds {first!r} to {last!r} and {nulls} without a split"


def read_labels(spark: SparkSession, path: str, expected_split: str) -> DataFrame:
    """A label table that must hold ``expected_split`` and nothing else."""
    df = spark.read.schema(_with_run(TEACHER_LABELS)).parquet(path)
    _assert_split(df, expected_split, path)
    return df


def lineage_check(df: DataFrame) -> DataFrame:
    """Per split: the prompt fingerprints and versions it was labeled with.

    Counting the combinations first keeps the pass over the rows a hash
    aggregate; least and greatest strings would make it sort them.
    """
    prompts = df.groupBy("split", "prompt_fingerprint", "prompt_version").agg(
        F.count("*").alias("n")
    )
    unknown = F.when(F.col("prompt_fingerprint").isNull(), F.col("n")).otherwise(0)
    return prompts.groupBy("split").agg(
        F.sum("n").alias("n_rows"),
        F.min("prompt_fingerprint").alias("fingerprint"),
        (F.min("prompt_fingerprint") == F.max("prompt_fingerprint")).alias("one_fingerprint"),
        F.min("prompt_version").alias("version"),
        (F.min("prompt_version") == F.max("prompt_version")).alias("one_version"),
        F.sum(unknown).alias("null_fingerprints"),
    )


@dataclass(frozen=True)
class TrainingTables:
    """Usable training and validation rows of one labeling run."""

    train: DataFrame
    val: DataFrame
    prompt_version: str
    prompt_fingerprint: str
    dropped: dict[str, int]


def _observed(df: DataFrame, table: str) -> tuple[DataFrame, Observation]:
    """``df`` with all that its guards look at, counted while something else reads the rows."""
    seen = Observation(f"{table}-labels")
    unknown = F.col("teacher_intent_id") == UNKNOWN_ID
    metrics = [F.count(F.lit(1)).alias("n_rows"), F.count_if(unknown).alias("dropped")]
    for column in ("split", "prompt_fingerprint", "prompt_version"):
        metrics += [
            F.min(column).alias(f"first_{column}"),
            F.max(column).alias(f"last_{column}"),
            F.count_if(F.col(column).isNull()).alias(f"null_{column}"),
        ]
    return df.observe(seen, *metrics), seen


def _assert_observed(seen: dict, table: str, path: str) -> None:
    first, last = seen["first_split"], seen["last_split"]
    if not seen["n_rows"] or first != table or last != table or seen["null_split"]:
        raise ValueError(_wrong_split(table, path, first, last, seen["null_split"]))
    if seen["first_prompt_fingerprint"] != seen["last_prompt_fingerprint"] or seen["null_prompt_fingerprint"]:
        raise ValueError(f"The {table} labels in {path} were not all made with one known prompt")


def load_training_tables(spark: SparkSession, train_path: str, val_path: str) -> TrainingTables:
    """Train and validation labels of one run, unknown rows dropped.

    Raises if a table holds another split, mixes fingerprints, or if the two
    come from different prompts. Both tables are read once: what the guards need
    is observed while the usable rows are written to the shared folder, and
    looked at before anyone gets them. Rows of tables that fail are removed.
    """
    schema = _with_run(TEACHER_LABELS)
    parts, observed = [], {}
    for table, path in (("train", train_path), ("val", val_path)):
        rows, observed[table] = _observed(spark.read.schema(schema).parquet(path), table)
        parts.append(drop_unknown(rows).select(F.lit(table).alias("_table"), *schema.names))
    usable = run_folder(spark, "training")
    parts[0].unionByName(parts[1]).write.partitionBy("_table").parquet(usable)
    seen = {table: observation.get for table, observation in observed.items()}
    try:
        for table, path in (("train", train_path), ("val", val_path)):
            _assert_observed(seen[table], table, path)
        for what in ("prompt_fingerprint", "prompt_version"):
            ours, theirs = seen["train"][f"first_{what}"], seen["val"][f"first_{what}"]
            if ours != theirs:
                raise ValueError(f"Train and val labels differ in {what}: {ours!r} and {theirs!r}")
    except ValueError:
        remove(spark, usable)
        raise

    def kept(table: str) -> DataFrame:
        # A table without usable rows has no folder.
        path = f"{usable}/_table={table}"
        return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)

    return TrainingTables(
        kept("train"),
        kept("val"),
        seen["train"]["first_prompt_version"],
        seen["train"]["first_prompt_fingerprint"],
        {table: seen[table]["dropped"] for table in seen},
    )


def load_split(messages: DataFrame, split: str, n: int | None = None) -> DataFrame:
    """Messages of one split, or its first ``n`` rows by id."""
    if split not in SPLITS:
        raise ValueError(f"No split is called {split!r}; there are {', '.join(SPLITS)}")
    rows = messages.where(F.col("split") == split)
    return rows if n is None else rows.orderBy("row_id").limit(n)


def _with_run(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("run_id", T.StringType())])


def write_labels(df: DataFrame, path: str) -> None:
    """Append a run, one folder per split and run; no shuffle is needed for it."""
    df.write.mode("append").partitionBy("split", "run_id").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_with_run(TEACHER_LABELS)).parquet(path)


def write_run_snapshot(prompt: DataFrame, summary: DataFrame, path: str) -> None:
    """The prompt a run was asked with and its summary, one JSON line each."""
    prompt.write.mode("errorifexists").json(f"{path}/prompt")
    summary.write.mode("errorifexists").json(f"{path}/summary")


def run_id_at(moment: Column) -> Column:
    """Name of a run started at a timestamp, sorting as time does, in the session's zone (UTC)."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH-mm-ss'Z'")


def listed_runs(spark: SparkSession, path: str) -> list[str]:
    """Names of all runs below ``path`` in time's order, from folder listings: one per split, no file is opened."""
    runs = set()
    for split in names_in(spark, path):
        if split.startswith("split="):
            runs |= {n.removeprefix("run_id=") for n in names_in(spark, f"{path}/{split}") if n.startswith("run_id=")}
    return sorted(unquote(n) for n in runs if n != NO_VALUE)


def read_latest_run(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the last run by name; only that run's folders are read."""
    runs = listed_runs(spark, path)
    if not runs:
        raise ValueError(f"There are no runs in {path}")
    return read_runs(spark, path).where(F.col("run_id") == runs[-1])


def run_id_from_path(path: Column) -> Column:
    """Name of the folder that holds ``labels.parquet``, itself a file or a folder."""
    return F.regexp_extract(path, r"([^/]+)/labels\.parquet(?:/|$)", 1)


def with_run_id(df: DataFrame) -> DataFrame:
    """Add ``run_id`` from the path of the file each row was read from."""
    return df.select("*", run_id_from_path(F.col("_metadata.file_path")).alias("run_id"))


def _read_calls(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Answers and failures below ``path``; none if the checkpoint does not exist yet."""
    schema = T.StructType([*TEACHER_RESPONSES.fields, *CALL_FAILURES.fields[1:]])
    if not path_exists(spark, checkpoint):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_responses(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All stored answers."""
    calls = _read_calls(spark, checkpoint, checkpoint)
    return calls.where("error_class IS NULL").select(*TEACHER_RESPONSES.names)


def read_failures(spark: SparkSession, checkpoint: str, run: str) -> DataFrame:
    """The failed calls of one run."""
    folder = f"{checkpoint}/run={run}"
    calls = _read_calls(spark, folder, folder)
    return calls.where("error_class IS NOT NULL").select(*CALL_FAILURES.names)


def append_responses(df: DataFrame, checkpoint: str, run: str, turn: int) -> DataFrame:
    """Store the answers and failures of one turn and return what was stored."""
    path = f"{checkpoint}/run={run}/turn={turn}"
    df.write.mode("errorifexists").parquet(path)
    return _read_calls(df.sparkSession, path, path)

"""The labeling job: prompts, teacher calls, stored answers and failures, a spend cap, resume."""

from __future__ import annotations

import random
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deskspark.functions.teacher import build_prompt, token_cost
from deskspark.operators.cost import TEACHER_RATES
from deskspark.operators.labeling import classify_responses, enrich_labels, labeling_summary
from deskspark.operators.prefix import running_totals
from deskspark.operators.sizes import computed_now
from deskspark.operators.taxonomy import fingerprint_table, taxonomy_block
from deskspark.schemas import CALL_FAILURES, TEACHER_RESPONSES
from deskspark.session import run_folder
from deskspark.sources.labels import (
    append_responses,
    read_failures,
    read_responses,
    write_labels,
    write_run_snapshot,
)


@dataclass
class RetryPolicy:
    """Which failed calls are tried again, how often and after how long.

    The defaults are fixed values. An error is a failed call if it carries a
    status code or is one of ``call_errors``; any other error ends the job.
    """

    tries: int = 3
    first_wait_s: float = 1.0
    longest_wait_s: float = 30.0
    codes: tuple[int, ...] = (408, 429, 500, 502, 503, 504)
    words: str = "rate limit|timeout|deadline|unavailable|service unavailable|internal error"
    call_errors: tuple[type[Exception], ...] = (ValueError, RuntimeError, OSError)

    def status(self, error: Exception) -> int | None:
        found = (getattr(error, name, None) for name in ("code", "status_code"))
        return next((c for c in found if isinstance(c, int)), None)

    def is_call_error(self, error: Exception) -> bool:
        return self.status(error) is not None or isinstance(error, self.call_errors)

    def worth_a_retry(self, error: Exception) -> bool:
        spoken = re.search(self.words, str(error), re.IGNORECASE)
        return spoken is not None or self.status(error) in self.codes


@dataclass(frozen=True)
class Answer:
    """What a labeler returns for one prompt."""

    response: str
    input_tokens: int
    output_tokens: int
    latency_ms: float
    model_version: str


Labeler = Callable[[str], Answer]


def call_with_retry(
    labeler: Labeler,
    prompt: str,
    sleep: Callable[[float], None] = time.sleep,
    policy: RetryPolicy = RetryPolicy(),
) -> Answer:
    """Waits between tries double and carry up to half as much again at random."""
    wait = policy.first_wait_s
    for left in range(policy.tries - 1, -1, -1):
        try:
            return labeler(prompt)
        except Exception as error:
            if left == 0 or not policy.worth_a_retry(error):
                raise
        sleep(wait * random.uniform(1.0, 1.5))
        wait = min(2 * wait, policy.longest_wait_s)
    raise AssertionError("every try returns or raises")


def label_messages(
    df: DataFrame,
    load_labeler: Callable[[], Labeler],
    max_task_usd: float = float("inf"),
    rates: dict = TEACHER_RATES,
    policy: RetryPolicy = RetryPolicy(),
) -> DataFrame:
    """One teacher call per ``row_id, text, gold_label_id, prompt`` row; answers and failures as rows.

    ``error_class`` is null for an answer. A task stops after the call that takes
    its spend over ``max_task_usd``; the rows it does not reach give no row.
    Concurrency is the number of partitions.
    """
    schema = T.StructType([*TEACHER_RESPONSES.fields, *CALL_FAILURES.fields[1:]])
    columns = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeler, spent = load_labeler(), 0.0
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if spent > max_task_usd:
                    break
                prompt = row.pop("prompt")
                try:
                    answer = call_with_retry(labeler, prompt, policy=policy)
                except Exception as error:
                    if not policy.is_call_error(error):
                        raise
                    done.append({**row, "error_class": type(error).__name__, "message": str(error)})
                    continue
                spent += token_cost(answer.input_tokens, answer.output_tokens, rates)
                done.append({**row, **asdict(answer)})
            yield pa.RecordBatch.from_pylist(done, schema=columns)

    return df.select("row_id", "text", "gold_label_id", "prompt").mapInArrow(run, schema)


def resume_pending(messages: DataFrame, done: DataFrame) -> DataFrame:
    """Messages without a stored answer."""
    return messages.join(done.select("row_id"), "row_id", "left_anti")


def resume_union(done: DataFrame, fresh: DataFrame) -> DataFrame:
    return done.unionByName(fresh)


@dataclass(frozen=True)
class JobResult:
    """All stored answers, this run's failed calls, and how the run ended."""

    answers: DataFrame
    failures: DataFrame
    n_failed: int
    spent_usd: float
    over_budget: bool


def with_prompts(messages: DataFrame, classes: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Adds the ``prompt`` of each message over the described class list."""
    block = taxonomy_block(classes, descriptions).scalar()
    return messages.withColumn("prompt", build_prompt(F.col("text"), block))


def _stepped(pending: DataFrame, step_rows: int) -> DataFrame:
    """Pending rows in steps of ``step_rows`` by ``row_id``, written once with the step as partition."""
    counted = running_totals(pending.withColumn("_one", F.lit(1)), [], ["row_id"], ["_one"])
    step = F.floor((F.col("running__one") - 1) / step_rows).cast("int")
    path = run_folder(pending.sparkSession, "label-steps")
    told = counted.withColumn("step", step).drop("_one", "running__one")
    told.repartition("step").write.partitionBy("step").parquet(path)
    return pending.sparkSession.read.schema(told.schema).parquet(path)


def run_label_job(
    messages: DataFrame,
    checkpoint: str,
    load_labeler: Callable[[], Labeler],
    max_cost_usd: float = 5.0,
    concurrency: int = 5,
    step_rows: int = 10_000,
    rates: dict = TEACHER_RATES,
    policy: RetryPolicy = RetryPolicy(),
) -> JobResult:
    """Ask for all messages without a stored answer, step by step in ``row_id`` order.

    ``messages`` may have a ``prompt``; without one the text is asked. A step's
    rows are dealt to ``concurrency`` tasks, each with an equal share of what is
    left of the cap, and its answers and failures are stored before the next
    step starts. A task stops after the call that crosses its share, and fewer
    tasks run once the rest would not pay for one call each, so the cap is
    overshot by ``concurrency`` calls at most and by one if that is 1. The input
    is compared with the stored answers once; after that only new answers are
    read. Every paid answer is kept. Failed calls are returned, and asked again
    by the next run.
    """
    spark = messages.sparkSession
    run = uuid.uuid4().hex
    asked = messages if "prompt" in messages.columns else messages.withColumn("prompt", F.col("text"))
    pending = resume_pending(asked, read_responses(spark, checkpoint))
    steps = _stepped(pending.select("row_id", "text", "gold_label_id", "prompt"), step_rows)
    sizes = {r["step"]: r["count"] for r in steps.groupBy("step").count().collect()}
    spent, n_failed, call_usd, turn = 0.0, 0, 0.0, 0
    for step in sorted(sizes):
        left, waiting = steps.where(F.col("step") == step).drop("step"), sizes[step]
        while spent <= max_cost_usd:
            rest = max_cost_usd - spent
            tasks = concurrency if call_usd == 0 else max(1, int(min(concurrency, rest / call_usd + 1)))
            dealt = left.repartitionByRange(tasks, "row_id").sortWithinPartitions("row_id")
            told = label_messages(dealt, load_labeler, rest / tasks, rates, policy)
            stored = append_responses(told, checkpoint, run, turn)
            turn += 1
            failed = F.col("error_class").isNotNull()
            paid = F.coalesce(token_cost(F.sum("input_tokens"), F.sum("output_tokens"), rates), F.lit(0.0))
            row = stored.agg(F.count("*").alias("n"), F.count_if(failed).alias("bad"), paid.alias("paid")).first()
            spent, n_failed = spent + row["paid"], n_failed + row["bad"]
            if row["n"] > row["bad"]:
                call_usd = row["paid"] / (row["n"] - row["bad"])
            waiting -= row["n"]
            if waiting == 0:
                break
            left = computed_now(left.join(stored.select("row_id"), "row_id", "left_anti"))
            if left.isEmpty():
                break
        if spent > max_cost_usd:
            break
    answers = read_responses(spark, checkpoint)
    return JobResult(answers, read_failures(spark, checkpoint, run), n_failed, spent, spent > max_cost_usd)


def store_run(
    answers: DataFrame,
    classes: DataFrame,
    descriptions: DataFrame,
    path: str,
    split: str,
    run_id: str,
    prompt_version: str,
) -> DataFrame:
    """Check and enrich answers, append them as a run, and keep its prompt and summary next to them.

    Returns the labels as written.
    """
    spark: SparkSession = answers.sparkSession
    print_ = fingerprint_table(classes, descriptions).first()["taxonomy_fingerprint"]
    checked = classify_responses(answers, classes)
    labels = enrich_labels(checked, classes, prompt_version, print_).drop("response", "prompt")
    told = computed_now(labels.withColumns({"split": F.lit(split), "run_id": F.lit(run_id)}))
    write_labels(told, f"{path}/labels")
    block = taxonomy_block(classes, descriptions).scalar()
    prompt = spark.range(1).select(
        F.lit(prompt_version).alias("prompt_version"),
        F.lit(print_).alias("prompt_fingerprint"),
        build_prompt(F.lit("{message}"), block).alias("prompt"),
    )
    write_run_snapshot(prompt, labeling_summary(told), f"{path}/runs/{split}/{run_id}")
    return told

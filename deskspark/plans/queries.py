"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.functions import scores as S
from deskspark.functions import teacher as T
from deskspark.operators import calibration, cost, evaluation, labeling, metrics, ml
from deskspark.operators import label_job as jobs
from deskspark.operators import redaction, sampling, scoring, taxonomy, thresholds
from deskspark.operators.prefix import exact_percentiles
from deskspark.operators.cost import SERVING_RATES, TEACHER_RATES
from deskspark.operators.sizes import computed_now
from deskspark.plans import tables as P
from deskspark.schemas import AUDIT, REJECTED
from deskspark.session import run_folder
from deskspark.sources import audit, embeddings, golden, labels, latency, results
from deskspark.sources.bucketed import write_bucketed
from deskspark.sources.files import path_exists
from deskspark.sources.prices import read_prices
from deskspark.streaming.scoring import read_output, start_scoring, start_scoring_and_rejecting, stream_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BY = ["model"]
TARGET = 0.5
ENCODER = "encoder-a"
BUDGET_USD = 0.02
JOB_CAP_USD = 0.02


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions without the arrays."""
    return P.predictions(spark, folder).select(
        "model", "row_id", "split", "label", "pred", "conf", "latency_ms"
    )


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_counts(_flat(spark, folder), BY)


def _fitted(spark: SparkSession, folder: str, flat: DataFrame) -> DataFrame:
    val = flat.where("split = 'val'")
    return thresholds.fit_thresholds(val, P.label_map(spark, folder), TARGET, BY)


# --- redaction ---------------------------------------------------------------


@query
def redact_email(spark, folder):
    return redaction.candidate_spans(P.documents(spark, folder), "email", P.SALT)


@query
def redact_phone(spark, folder):
    return redaction.candidate_spans(P.documents(spark, folder), "phone", P.SALT)


@query
def redact_card(spark, folder):
    return redaction.candidate_spans(P.documents(spark, folder), "card", P.SALT)


@query
def redact_account(spark, folder):
    """Documents name no accounts, so each order is told as a sentence that does."""
    orders = P.read(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(
            F.lit("Account no. "),
            F.lpad(F.col("o_orderkey").cast("string"), 9, "7"),
            F.lit(" paid "),
            F.col("o_custkey").cast("string"),
            F.lit(" via a/c "),
            F.lpad(F.col("o_custkey").cast("string"), 7, "5"),
        ).alias("text"),
    )
    return redaction.candidate_spans(orders, "account", P.SALT)


@query
def redact_spans(spark, folder):
    return redaction.redaction_spans(P.documents(spark, folder), P.SALT)


@query
def redact_text(spark, folder):
    docs = P.documents(spark, folder)
    return redaction.redact_messages(docs, P.SALT).select("doc_id", "redacted_text")


@query
def pii_profile(spark, folder):
    return redaction.pii_profile(P.documents(spark, folder), P.SALT)


# --- messages, prompts, answers ----------------------------------------------


@query
def validate_messages(spark, folder):
    docs = P.documents(spark, folder).withColumn("n_chars", F.length("text"))
    accepted, rejected = labeling.validate_messages(docs)
    both = accepted.withColumn("accepted", F.lit(1)).unionByName(rejected.withColumn("accepted", F.lit(0)))
    return both.groupBy("accepted").agg(F.count("*").alias("n_rows"), F.max("n_chars").alias("longest"))


@query
def rejected_messages(spark, folder):
    docs = P.documents(spark, folder).select(F.col("doc_id").cast("string").alias("request_id"), "text")
    return scoring.rejected_messages(docs, "lang-1").select("request_id", "reason", "n_chars")


@query
def taxonomy_block(spark, folder):
    """Class list of the label map; its size is the number of classes."""
    classes = P.label_map(spark, folder)
    described = _described(spark, folder)
    return taxonomy.taxonomy_block(classes, described)


def _described(spark, folder) -> DataFrame:
    """A description per class, told from the rows that carry it."""
    return (
        P.items(spark, folder)
        .groupBy("label")
        .agg(F.count("*").alias("n"))
        .select(
            F.concat(F.lit("class_"), "label").alias("label_name"),
            F.concat(F.lit("seen "), F.col("n").cast("string"), F.lit(" times")).alias(
                "description"
            ),
        )
    )


@query
def taxonomy_fingerprint(spark, folder):
    return taxonomy.fingerprint_table(P.label_map(spark, folder), _described(spark, folder))


@query
def taxonomy_missing(spark, folder):
    """Classes that no training row carries stand in for undescribed ones."""
    classes = P.read(spark, folder, "documents").select(
        F.lit(0).alias("label_id"), F.concat("lang", F.lit("_"), "source").alias("label_name")
    )
    labeled = P.read(spark, folder, "labels").where("quality = 0").select("doc_id")
    described = (
        P.read(spark, folder, "documents")
        .join(labeled, "doc_id")
        .select(F.concat("lang", F.lit("_"), "source").alias("label_name"))
        .distinct()
    )
    return taxonomy.missing_descriptions(classes, described)


@query
def build_prompt(spark, folder):
    block = taxonomy.taxonomy_block(P.label_map(spark, folder), _described(spark, folder))
    return P.conversations(spark, folder).select(
        "row_id", T.build_prompt(F.col("text"), block.scalar()).alias("prompt")
    )


@query
def parse_response(spark, folder):
    answers = P.teacher_responses(spark, folder)
    checked = labeling.classify_responses(answers, P.label_map(spark, folder))
    return checked.select("row_id", "teacher_intent_name", "teacher_intent_id", "error")


@query
def enriched_labels(spark, folder):
    return P.teacher_labels(spark, folder).select(
        "row_id",
        "teacher_intent_id",
        "gold_label_id",
        "gold_label_name",
        F.col("correct").cast("int").alias("correct"),
        "split",
        "prompt_version",
        "prompt_fingerprint",
    )


@query
def drop_unknown(spark, folder):
    rows = P.teacher_labels(spark, folder)
    return labeling.dropped_counts(rows)


@query
def row_cost(spark, folder):
    priced = cost.with_row_cost(P.teacher_labels(spark, folder))
    return _round(priced.select("row_id", "cost_usd"), "cost_usd", digits=9)


@query
def estimate_cost(spark, folder):
    block = taxonomy.taxonomy_block(P.label_map(spark, folder), _described(spark, folder))
    return _round(cost.estimate_cost(P.conversations(spark, folder), block), "estimated_usd")


# --- label tables ------------------------------------------------------------


@query
def split_guard(spark, folder):
    rows = P.teacher_labels(spark, folder).select("split")
    checks = [labels.split_guard(rows.where(F.col("split") == s), s) for s in labels.SPLITS]
    checks.append(labels.split_guard(rows, "train"))
    both = reduce(DataFrame.unionByName, checks)
    return both.withColumn("ok", F.col("ok").cast("int"))


@query
def lineage_check(spark, folder):
    """Validation rows of two prompts, training rows of two versions, golden rows without a print."""
    split, row = F.col("split"), F.col("row_id")
    print_ = F.when((split == "val") & (row % 7 == 0), "00c0ffee00c0ffef").when(
        (split != "golden") | (row % 11 != 0), F.col("prompt_fingerprint")
    )
    version = F.when((split == "train") & (row % 13 == 0), "2").otherwise(F.col("prompt_version"))
    rows = P.teacher_labels(spark, folder).withColumns({"prompt_fingerprint": print_, "prompt_version": version})
    found = labels.lineage_check(rows)
    return found.withColumns(
        {c: F.col(c).cast("int") for c in ("one_fingerprint", "one_version")}
    )


@query
def training_tables(spark, folder):
    """Usable rows, dropped rows and lineage of a train and a val table, read back after their guards."""
    path, rows = run_folder(spark, "labeled"), P.teacher_labels(spark, folder)
    paths = [f"{path}/{split}/labels.parquet" for split in ("train", "val")]
    for split, where in zip(("train", "val"), paths):
        rows.where(F.col("split") == split).write.parquet(where)
    found = labels.load_training_tables(spark, *paths)
    parts = [
        usable.groupBy("split").agg(
            F.count("*").alias("kept"),
            F.sum("row_id").alias("id_total"),
            F.lit(found.dropped[split]).cast("long").alias("dropped"),
            F.lit(found.prompt_version).alias("prompt_version"),
            F.lit(found.prompt_fingerprint).alias("prompt_fingerprint"),
        )
        for split, usable in (("train", found.train), ("val", found.val))
    ]
    return parts[0].unionByName(parts[1])


@query
def split_head(spark, folder):
    messages = P.teacher_labels(spark, folder).select("row_id", "text", "split")
    return labels.load_split(messages, "val", 25)


def _two_runs(spark, folder) -> DataFrame:
    runs = F.array(F.lit("2026-05-01T08-00-00Z"), F.lit("2026-05-02T08-00-00Z"))
    return P.teacher_labels(spark, folder).withColumn("run_id", F.explode(runs))


@query
def labels_sink(spark, folder):
    path = run_folder(spark, "labels")
    labels.write_labels(_two_runs(spark, folder), path)
    return (
        labels.read_runs(spark, path)
        .groupBy("split", "run_id")
        .agg(
            F.count("*").alias("n_rows"),
            F.sum("input_tokens").alias("input_total"),
            F.count("error").alias("errors"),
        )
    )


@query
def latest_run(spark, folder):
    path = run_folder(spark, "runs")
    labels.write_labels(_two_runs(spark, folder), path)
    last = labels.read_latest_run(spark, path)
    return last.groupBy("run_id", "split").agg(F.count("*").alias("n_rows"))


@query
def run_id_from_path(spark, folder):
    root = run_folder(spark, "by-path")
    rows = P.teacher_labels(spark, folder)
    paths = []
    for split in labels.SPLITS:
        paths.append(f"{root}/{split}/run-{split}/labels.parquet")
        rows.where(F.col("split") == split).write.parquet(paths[-1])
    found = labels.with_run_id(spark.read.schema(rows.schema).parquet(*paths))
    return found.groupBy("run_id", "split").agg(F.count("*").alias("n_rows"))


@query
def golden_snapshot(spark, folder):
    root = run_folder(spark, "golden")
    rows = P.items(spark, folder).select(
        "row_id", F.concat(F.lit("message "), "row_id").alias("text"), "label", "split"
    )
    first = golden.load_golden(spark, root, lambda: rows.where("split = 'golden'"))
    again = golden.load_golden(spark, root, lambda: rows)
    return again.unionByName(first).groupBy("label").agg(
        F.count("*").alias("n_reads"), F.count_distinct("row_id").alias("n_rows")
    )


@query
def resume_pending(spark, folder):
    messages = P.conversations(spark, folder).select("row_id", "text")
    done = messages.where(F.length("text") < 300)
    return jobs.resume_pending(messages, done).select(
        "row_id", F.length("text").alias("n_chars")
    )


@query
def resume_union(spark, folder):
    messages = P.conversations(spark, folder).select("row_id", "text")
    done = messages.where(F.length("text") < 300)
    fresh = jobs.resume_pending(messages, done)
    return jobs.resume_union(done, fresh).select("row_id", F.length("text").alias("n_chars"))


@query
def label_job(spark, folder):
    messages = P.conversations(spark, folder).select(
        "row_id", "text", F.lit(0).alias("gold_label_id")
    )
    result = jobs.run_label_job(
        messages,
        run_folder(spark, "label-job"),
        P.load_length_labeler,
        max_cost_usd=JOB_CAP_USD,
        concurrency=1,
    )
    return result.answers.select("row_id", "response", "input_tokens", "output_tokens")


@query
def label_job_full(spark, folder):
    """A job over all messages, from prompts to stored labels, read back."""
    classes = spark.createDataFrame([(0, "short"), (1, "long")], "label_id int, label_name string")
    described = spark.createDataFrame(list(P.LENGTH_CLASSES.items()), "label_name string, description string")
    messages = P.conversations(spark, folder).select("row_id", "text", F.lit(0).alias("gold_label_id"))
    path = run_folder(spark, "label-job-full")
    result = jobs.run_label_job(
        jobs.with_prompts(messages, classes, described),
        f"{path}/calls",
        P.load_prompt_labeler,
        max_cost_usd=float("inf"),
        concurrency=8,
    )
    jobs.store_run(result.answers, classes, described, path, "train", "2026-05-01T08-00-00Z", P.PROMPT_VERSION)
    told = labels.read_latest_run(spark, f"{path}/labels")
    return told.select(
        "row_id", "teacher_intent_name", "teacher_intent_id", "input_tokens", "split", "run_id",
        F.col("correct").cast("int").alias("correct"),
    )


@query
def budget_cutoff(spark, folder):
    rows = P.teacher_labels(spark, folder).select("row_id", "input_tokens", "output_tokens")
    kept = labeling.budget_cutoff(rows, BUDGET_USD)
    return _round(kept.select("row_id", "spent_usd"), "spent_usd", digits=9)


@query
def labeling_summary(spark, folder):
    found = labeling.labeling_summary(P.teacher_labels(spark, folder), ["split"])
    return _round(
        found,
        *("error_rate", "teacher_vs_gold_accuracy", "cost_usd"),
        *("latency_ms_p50", "latency_ms_p95", "latency_ms_p99"),
    )


@query
def label_distribution(spark, folder):
    return labeling.label_distribution(P.teacher_labels(spark, folder))


@query
def ceiling_accuracy(spark, folder):
    found = labeling.ceiling_accuracy(P.teacher_labels(spark, folder), ["split"])
    return _round(found, "ceiling_top1_accuracy")


@query
def class_accuracy(spark, folder):
    return _round(labeling.class_accuracy(P.teacher_labels(spark, folder)), "accuracy")


@query
def worst_classes(spark, folder):
    return _round(labeling.worst_classes(P.teacher_labels(spark, folder), 5), "accuracy")


@query
def error_overview(spark, folder):
    found = labeling.error_overview(P.teacher_labels(spark, folder), ["split"])
    return _round(found, "accuracy", "miss_rate")


@query
def error_pairs(spark, folder):
    return labeling.error_pairs(P.teacher_labels(spark, folder))


@query
def confusion_examples(spark, folder):
    return labeling.confusion_examples(P.teacher_labels(spark, folder))


# --- scores ------------------------------------------------------------------


def _long(df: DataFrame, probs: Column) -> DataFrame:
    keys = [c for c in ("model", "row_id") if c in df.columns]
    long = df.select(*keys, F.posexplode(probs).alias("label_id", "p"))
    return _round(long, "p", digits=9)


@query
def softmax_temperature(spark, folder):
    return _long(P.scored(spark, folder), S.softmax(F.col("logits"), 2.5))


@query
def class_projection(spark, folder):
    """Scores of the more frequent half of the classes, on the full list."""
    sizes = {r["label"]: r["n"] for r in sampling.class_sizes(P.items(spark, folder)).collect()}
    middle = sum(sizes.values()) / len(sizes)
    seen = sorted(c for c, n in sizes.items() if n >= middle)
    ids = F.array(*[F.lit(c) for c in seen])
    known = P.scored(spark, folder).withColumn(
        "logits", F.transform(ids, lambda c: F.get("logits", c))
    )
    full = ml.on_class_list(known, seen, len(sizes))
    return _long(full, S.softmax(F.col("logits")))


@query
def teacher_one_hot(spark, folder):
    n = P.label_map(spark, folder).count()
    rows = P.teacher_labels(spark, folder)
    return _long(rows.select("row_id", "teacher_intent_id"), S.one_hot(F.col("teacher_intent_id"), n))


@query
def top_k_intents(spark, folder):
    ranked = scoring.top_classes(P.predictions(spark, folder), P.label_map(spark, folder), 3)
    both = F.arrays_zip("top_k_intents", "top_k_confidences")
    return ranked.select("model", "row_id", F.posexplode(both).alias("place", "t")).select(
        "model",
        "row_id",
        "place",
        F.col("t.top_k_intents").alias("intent"),
        F.col("t.top_k_confidences").alias("p"),
    )


@query
def argmax_confidence(spark, folder):
    return _flat(spark, folder).select("model", "row_id", "pred", "conf")


# --- metrics -----------------------------------------------------------------


@query
def top_k_accuracy(spark, folder):
    rows = P.predictions(spark, folder).select("model", "label", "probs")
    parts = [
        metrics.top_k_accuracy(rows, k, BY).withColumn("k", F.lit(k)) for k in (1, 3, 5)
    ]
    return _round(reduce(DataFrame.unionByName, parts), "accuracy")


@query
def macro_f1(spark, folder):
    return _round(
        metrics.macro_f1(_counts(spark, folder), P.label_map(spark, folder), BY), "macro_f1"
    )


@query
def per_class_metrics(spark, folder):
    found = metrics.per_class_metrics(_counts(spark, folder), P.label_map(spark, folder), BY)
    return _round(found, "precision", "recall", "f1", "top1_accuracy")


@query
def confusion_matrix(spark, folder):
    found = metrics.confusion_matrix(_counts(spark, folder), P.label_map(spark, folder), BY)
    return _round(found, "value")


@query
def top_confusion_pairs(spark, folder):
    classes = P.label_map(spark, folder)
    found = metrics.top_confusion_pairs(_counts(spark, folder), classes, 20, BY).drop("n")
    return _round(found, "value", digits=9)


@query
def worst_classes_f1(spark, folder):
    found = metrics.per_class_metrics(_counts(spark, folder), P.label_map(spark, folder), BY)
    found = _round(found.select("model", "label_id", "class_name", "f1"), "f1")
    return metrics.worst_classes_by_f1(found, 4, BY)


@query
def ece(spark, folder):
    return _round(calibration.expected_calibration_error(_flat(spark, folder), BY), "ece")


@query
def reliability_bins(spark, folder):
    found = calibration.reliability_bins(_flat(spark, folder), BY)
    return _round(found, "mean_confidence", "accuracy")


@query
def nll_at_t(spark, folder):
    rows = P.scored(spark, folder).select("model", "label", "logits")
    parts = [
        calibration.mean_log_loss(rows, t, BY).withColumn("temperature", F.lit(t))
        for t in (0.5, 1.0, 2.0)
    ]
    return _round(reduce(DataFrame.unionByName, parts), "nll")


@query
def agreement(spark, folder):
    teacher = P.teacher_labels(spark, folder)
    return _round(
        metrics.agreement(_flat(spark, folder), teacher, BY), "vs_teacher", "vs_truth"
    )


@query
def agreement_bucketed(spark, folder):
    """Agreement over scores and labels that are stored by hash of ``row_id``: no row moves for the join."""
    path, tables = run_folder(spark, "by-row"), []
    for name, rows in (("scores", _flat(spark, folder)), ("labels", P.teacher_labels(spark, folder))):
        table = f"{name}_{path.rsplit('-', 1)[-1]}"
        tables.append(write_bucketed(rows, table, f"{path}/{name}", ["row_id"], 8))
    return _round(metrics.agreement(*tables, BY), "vs_teacher", "vs_truth")


@query
def fit_temperature(spark, folder):
    found = calibration.fit_temperatures(P.scored(spark, folder), ["model", "split"])
    return _round(found, "temperature")


@query
def calibration_report(spark, folder):
    """One row per model."""
    val, taught, parts = P.scored(spark, folder).where("split = 'val'"), P.teacher_labels(spark, folder), []
    for model in (P.BASELINE, P.STUDENT):
        found = calibration.calibration_report(val.where(F.col("model") == model), taught)
        parts.append(found.drop("fitted_at_utc").withColumn("model", F.lit(model)))
    shown = "temperature ece_pre ece_post val_accuracy_vs_truth val_accuracy_vs_teacher".split()
    return _round(reduce(DataFrame.unionByName, parts), *shown)


# --- thresholds --------------------------------------------------------------


@query
def running_precision(spark, folder):
    found = thresholds.running_precision(_flat(spark, folder), BY)
    return _round(
        found.select("model", "pred", "row_id", "running_precision"), "running_precision"
    )


@query
def fit_thresholds(spark, folder):
    return _fitted(spark, folder, _flat(spark, folder))


@query
def apply_thresholds(spark, folder):
    flat = _flat(spark, folder)
    found = thresholds.apply_thresholds(flat, _fitted(spark, folder, flat), BY)
    return found.select(
        "model", "row_id", "pred", "threshold", F.col("accepted").cast("int").alias("accepted")
    )


@query
def threshold_summary(spark, folder):
    flat = _flat(spark, folder)
    found = thresholds.threshold_summary(
        flat.where("split = 'val'"),
        _fitted(spark, folder, flat),
        P.label_map(spark, folder),
        BY,
    )
    return _round(found, "val_precision", "val_recall")


@query
def threshold_store(spark, folder):
    """The stored thresholds of each model, read back."""
    classes, flat, parts = P.label_map(spark, folder), _flat(spark, folder), []
    for model in (P.BASELINE, P.STUDENT):
        path = run_folder(spark, "thresholds")
        val = flat.where((F.col("model") == model) & (F.col("split") == "val"))
        limits = thresholds.fit_thresholds(val, classes, TARGET)
        summary = thresholds.threshold_summary(val, limits, classes)
        results.write_thresholds(limits, summary, TARGET, val.count(), path)
        parts.append(results.read_thresholds(spark, path).withColumn("model", F.lit(model)))
    return reduce(DataFrame.unionByName, parts)


@query
def routing_stats(spark, folder):
    flat = _flat(spark, folder)
    found = thresholds.routing_stats(
        flat.where("split = 'golden'"), _fitted(spark, folder, flat), BY
    )
    return _round(found, "acceptance_rate", "precision_among_accepted")


# --- cost and latency --------------------------------------------------------


def _events(spark, folder) -> DataFrame:
    return P.read(spark, folder, "events").select(
        F.col("event_type").alias("model"), F.col("value").alias("latency_ms")
    )


@query
def latency_percentiles(spark, folder):
    found = exact_percentiles(
        _events(spark, folder), "latency_ms", labeling.PERCENTILES, BY
    )
    return _round(found, "p50", "p95", "p99")


@query
def latency_source(spark, folder):
    """Load-test files for one model, in-process timings for the others."""
    path = run_folder(spark, "latency")
    events = P.read(spark, folder, "events")
    in_process = _events(spark, folder)
    files = (
        events.where("event_type = 'purchase'")
        .groupBy(F.floor(F.col("event_id") / 1000).alias("sample"))
        .agg(F.collect_list("value").alias("per_example_latency_ms"))
        .select(
            F.lit("purchase").alias("model"),
            F.concat(F.lit("run-"), F.col("sample").cast("string")).alias("deployment_run_id"),
            F.lit(cost.SERVING_VCPU).alias("vcpu"),
            F.lit(cost.SERVING_MEMORY_GIB).alias("memory_gib"),
            "per_example_latency_ms",
            F.lit("2026-05-15T00:00:00Z").alias("sampled_at_utc"),
        )
    )
    files.write.json(path)
    load_test = latency.read_latencies(spark, path, multi_line=False)
    chosen = latency.with_latency_source(in_process, load_test)
    found = chosen.groupBy("model", "latency_source").agg(
        F.count("*").alias("n"), F.avg("latency_ms").alias("mean_ms")
    )
    return _round(found, "mean_ms")


@query
def cost_teacher_per_1k(spark, folder):
    found = cost.teacher_cost_per_1k(P.teacher_labels(spark, folder), ["split"])
    return _round(found, "cost_per_1k_usd")


@query
def cost_student_per_1k(spark, folder):
    return _round(cost.student_cost_per_1k(_events(spark, folder), BY), "cost_per_1k_usd", digits=9)


@query
def price_sheet_cost(spark, folder):
    """Serving costs at the rates of a stored price sheet, twice those of the default one."""
    path = run_folder(spark, "prices")
    doubled = {n: 2 * rate for n, rate in SERVING_RATES.items()}
    rates = {**TEACHER_RATES, **doubled}
    sheet = spark.range(1).select(F.lit("2026-06").alias("pricing_date"), *[F.lit(r).alias(n) for n, r in rates.items()])
    sheet.write.json(path)
    prices = read_prices(spark, path)
    found = cost.student_cost_per_1k(_events(spark, folder), BY, rates=prices.serving)
    return _round(found.withColumn("pricing_date", F.lit(prices.pricing_date)), "cost_per_1k_usd", digits=8)


def _model_costs(spark, folder) -> DataFrame:
    teacher = cost.teacher_cost_per_1k(P.teacher_labels(spark, folder))
    others = cost.student_cost_per_1k(P.scored(spark, folder).select("model", "latency_ms"), BY)
    return others.unionByName(teacher.withColumn("model", F.lit(P.TEACHER)))


@query
def cost_breakdown(spark, folder):
    return cost.cost_breakdown(_model_costs(spark, folder))


def _golden_rows(spark, folder, classes: DataFrame) -> DataFrame:
    """Golden predictions of all models, stored for this call; only the teacher is billed by tokens."""
    columns = ["model", "row_id", "label", "pred", "conf", "latency_ms"]
    tokens = ["input_tokens", "output_tokens"]
    taught = P.teacher_predictions(spark, folder, classes)
    among = F.exists(S.top_k(F.col("probs"), 5), lambda c: c["label_id"] == F.col("label"))
    own = P.predicted(P.fresh_scores(spark, folder)).where("split = 'golden'")
    own = own.select(*columns, among.cast("long").alias("top_5_hit"))
    taught = taught.where("split = 'golden'").select(*columns, *tokens)
    return computed_now(own.unionByName(taught, allowMissingColumns=True))


@query
def headline_metrics(spark, folder):
    """One row per model over the golden rows."""
    classes = P.label_map(spark, folder)
    found = evaluation.headline(_golden_rows(spark, folder, classes), classes, BY)
    return _round(
        found.drop("n", "top_5_accuracy"), "top_1_accuracy", "macro_f1", "ece", "latency_ms_p95", "cost_per_1k_usd"
    )


@query
def results_document(spark, folder):
    """The stored document's metrics and threshold block, read back.

    The baseline's latencies come from a load test of twice its own.
    """
    path = run_folder(spark, "results")
    classes = P.label_map(spark, folder)
    rows = _golden_rows(spark, folder, classes)
    tested = rows.where(F.col("model") == P.BASELINE).select("model", (F.col("latency_ms") * 2).alias("latency_ms"))
    limits = _fitted(spark, folder, _flat(spark, folder))
    found = evaluation.evaluation_tables(
        rows, classes, BY, load_test=tested, limits=limits, target=TARGET
    )
    results.write_results(spark, found, {"target_precision": TARGET}, path)
    reals = "top_1_accuracy top_5_accuracy macro_f1 ece latency_ms_p50 latency_ms_p95 latency_ms_p99 cost_per_1k_usd".split()
    told = ", ".join(f"{c}: double" for c in reals)
    block = "model: string, n_accepted: bigint, acceptance_rate: double, precision_among_accepted: double"
    schema = f"tables struct<metrics: array<struct<model: string, latency_source: string, n: bigint, n_classes: bigint, {told}>>,"
    schema += f" thresholds: array<struct<{block}, n_classes_escalate_all: bigint, target_precision: double>>>"
    stored = spark.read.schema(schema).json(path)
    scores = stored.select(F.inline("tables.metrics"))
    routed = stored.select(F.inline("tables.thresholds"))
    whole = scores.join(routed, "model", "left")
    return _round(whole, *reals, "acceptance_rate", "precision_among_accepted")


# --- sampling and data checks ------------------------------------------------


def _labeled_events(spark, folder) -> DataFrame:
    return P.read(spark, folder, "events").select(
        F.col("event_id").alias("row_id"), F.col("event_type").alias("label")
    )


@query
def stratified_split(spark, folder):
    return sampling.stratified_split(_labeled_events(spark, folder))


@query
def stratified_subsample(spark, folder):
    docs = P.read(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("label")
    )
    return sampling.stratified_subsample(docs, 150, seed=7)


@query
def split_class_drift(spark, folder):
    split = sampling.stratified_split(_labeled_events(spark, folder))
    return _round(sampling.class_drift(split, "train", "val"), "max_share_difference", digits=9)


@query
def split_leakage(spark, folder):
    docs = P.documents(spark, folder).withColumn("split", P.hashed_split("doc_id"))
    return sampling.shared_texts(docs, sorted(labels.SPLITS))


@query
def dataset_quality(spark, folder):
    docs = P.read(spark, folder, "documents").select(
        F.col("source").alias("split"), "text", F.col("lang").alias("label")
    )
    return sampling.dataset_quality(docs)


@query
def embed_cache_misses(spark, folder):
    docs = P.documents(spark, folder).withColumn("split", P.hashed_split("doc_id"))
    cache = embeddings.keyed_texts(docs.where("split = 'train'"), ENCODER).select("cache_key").distinct()
    missing = embeddings.cache_misses(docs, cache, ENCODER)
    return missing.select("cache_key", F.length("text").alias("n_chars"))


@query
def embed_cache_fill(spark, folder):
    """Training texts first, then all, then all again; every document gets its vector from the cache."""
    path = run_folder(spark, "embeddings")
    docs = P.documents(spark, folder).withColumn("split", P.hashed_split("doc_id"))
    added = [
        embeddings.fill_cache(some, path, ENCODER, P.load_count_encoder)
        for some in (docs.where("split = 'train'"), docs, docs)
    ]
    found = embeddings.with_embeddings(docs, embeddings.read_cache(spark, path), ENCODER)
    counts = {f"added_{i}": F.lit(n).cast("long") for i, n in enumerate(added, 1)}
    vector = {f"e{i}": F.get("embedding", F.lit(i)) for i in range(4)}
    return found.select("doc_id", *[c.alias(n) for n, c in {**vector, **counts}.items()])


# --- models, batch and stream scoring ----------------------------------------


@query
def lr_train_predict(spark, folder):
    rows = P.items(spark, folder)
    model = ml.train_classifier(rows.where("split = 'train'"), embedding="e")
    scored = ml.predict_logits(model, rows, embedding="e")
    flat = metrics.flatten_scores(scored.withColumn("probs", S.softmax(F.col("logits"))))
    return _round(flat.select("row_id", "split", "label", "pred", "conf"), "conf", digits=4)


@query
def lr_certificate(spark, folder):
    """The gradient of the penalised loss at stored coefficients, as a share of what it sums up: 0 at the optimum."""
    train, path = P.items(spark, folder).where("split = 'train'"), run_folder(spark, "classifier")
    results.save_classifier(ml.train_classifier(train, embedding="e"), path, {}, {})
    found = ml.penalised_gradient(results.load_classifier(path), train, embedding="e")
    share = F.round(F.try_divide("gradient", "scale"), 3)
    # A rounded share may be a negative zero.
    return found.select("label", "component", (F.coalesce(share, F.lit(0.0)) + F.lit(0.0)).alias("gradient_share"))


def _requests(df: DataFrame) -> DataFrame:
    return df.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias(
            "request_id"
        ),
        "text",
    )


def _stream(spark, folder, table: str) -> DataFrame:
    return stream_table(spark, f"{folder}/{table}.parquet", P.read(spark, folder, table).schema)


def _stable(audit_table: DataFrame) -> DataFrame:
    """Audit rows without the columns that change from run to run."""
    return audit_table.select(
        "request_id",
        "model_version",
        "input_text_redacted",
        "predicted_intent",
        F.round("confidence", 6).alias("confidence"),
        F.array_join("top_k_intents", ",").alias("top_k_intents"),
        F.size("top_k_confidences").alias("k"),
    )


def _predict(spark, score, version: str):
    classes = P.language_classes(spark)

    def run(messages: DataFrame) -> DataFrame:
        return scoring.predict_messages(messages, classes, P.SALT, version, score, 2.0, 3)

    return run


def _python_score(df: DataFrame, text: str) -> DataFrame:
    return scoring.score_texts(df, P.load_language_model, text)


@query
def batch_scoring(spark, folder):
    requests = _requests(P.read(spark, folder, "conversations"))
    return _stable(_predict(spark, _python_score, "lang-1")(requests))


@query
def audit_log(spark, folder):
    path = run_folder(spark, "audit")
    requests = _requests(P.read(spark, folder, "conversations"))
    audit.write_audit(_predict(spark, P.language_logits, "lang-1")(requests), path)
    stored = audit.read_audit(spark, path)
    whole = F.col("event_date").isNotNull() & F.col("timestamp").isNotNull()
    return _stable(stored).withColumn(
        "n_dated", stored.agg(F.count_if(whole).alias("n")).scalar()
    )


@query
def stream_scoring(spark, folder):
    path = run_folder(spark, "stream")
    messages = _requests(_stream(spark, folder, "conversations"))
    predict = _predict(spark, P.language_logits, "lang-1")
    job = start_scoring(messages, predict, path, run_folder(spark, "stream-state"), once=True)
    job.awaitTermination()
    return _stable(audit.read_audit(spark, path))


@query
def stream_outputs(spark, folder):
    """Scored and rejected messages of one stream; some texts are emptied or lengthened, so that both occur."""
    path, state = run_folder(spark, "outputs"), run_folder(spark, "stream-state")
    rows = _stream(spark, folder, "conversations")
    turn, text = F.col("turn"), F.col("text")
    odd = F.when(turn % 5 == 0, "").when(turn % 7 == 0, F.repeat(text, F.lit(99))).otherwise(text)
    messages = _requests(rows.withColumn("text", odd))
    predict = _predict(spark, P.language_logits, "lang-1")
    start_scoring_and_rejecting(messages, predict, "lang-1", path, state, once=True).awaitTermination()
    scored = read_output(spark, path, "scored", AUDIT).select(
        "request_id", "predicted_intent", F.lit(None).cast("string").alias("reason")
    )
    rejected = read_output(spark, path, "rejected", REJECTED).select(
        "request_id", F.lit(None).cast("string").alias("predicted_intent"), "reason"
    )
    return scored.unionByName(rejected)


@query
def own_redactor_and_writer(spark, folder):
    """A stream with another redactor, which hides digits alone, and another audit writer, one folder per batch."""
    path = run_folder(spark, "own-audit")
    messages = _requests(_stream(spark, folder, "conversations"))

    def hide_digits(df: DataFrame, salt: bytes) -> DataFrame:
        hidden = F.regexp_replace("text", "[0-9]", "#")
        return df.withColumns({"redacted_text": hidden, "spans": F.lit(None)})

    def predict(df: DataFrame) -> DataFrame:
        classes = P.language_classes(spark)
        return scoring.predict_messages(df, classes, P.SALT, "lang-1", P.language_logits, redact=hide_digits)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    start_scoring(messages, predict, "", run_folder(spark, "stream-state"), once=True, write=write).awaitTermination()
    # A table without files makes no batch.
    stored = spark.read.parquet(path) if path_exists(spark, path) else spark.createDataFrame([], AUDIT)
    return stored.select("request_id", "input_text_redacted")

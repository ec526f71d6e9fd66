import pytest
from pyspark.sql import functions as F

from deskspark.functions import teacher as teach
from deskspark.operators import label_job as jobs
from deskspark.operators import labeling as L
from deskspark.operators import taxonomy
from deskspark.session import run_folder
from deskspark.sources import labels as S


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame([(0, "card_arrival"), (1, "age_limit"), (2, "exchange_rate")], "label_id int, label_name string")


@pytest.mark.parametrize(
    "response, name, label_id, error",
    [
        ('{"intent": "card_arrival"}', "card_arrival", 0, None),
        ('{"intent": "age_limit", "confidence": 0.9}', "age_limit", 1, None),
        ('"card_arrival"', "", -1, "parse_error"),
        ("{}", "", -1, "parse_error"),
        ('{"intent": 42}', "", -1, "parse_error"),
        ('{"intent": null}', "", -1, "parse_error"),
        ('{"intent": ["card_arrival"]}', "", -1, "parse_error"),
        ('[{"intent": "card_arrival"}]', "", -1, "parse_error"),
        ("not json", "", -1, "parse_error"),
        (None, "", -1, "parse_error"),
        ('{"intent": "made_up"}', "made_up", -1, "unknown_intent"),
        ('{"intent": "CARD_ARRIVAL"}', "CARD_ARRIVAL", -1, "unknown_intent"),
        ('{"intent": ""}', "", -1, "unknown_intent"),
        ('{"intent": "42"}', "42", -1, "unknown_intent"),
    ],
)
def test_answers_are_checked_strictly(spark, classes, response, name, label_id, error):
    df = spark.createDataFrame([(response,)], "response string")
    row = L.classify_responses(df, classes).first()
    assert (row["teacher_intent_name"], row["teacher_intent_id"], row["error"]) == (name, label_id, error)


def test_message_length_limits(spark):
    texts = ["", "x", "é" * 2000, "x" * 2001, None]
    ok, rejected = L.validate_messages(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert (ok.count(), rejected.count()) == (2, 3)


def test_prompt_layout(spark, classes):
    described = taxonomy.description_table(spark)
    block = taxonomy.taxonomy_block(classes, described)
    text = block.first()[0]
    assert text.split("\n")[0] == f"- card_arrival: {taxonomy.DESCRIPTIONS['card_arrival']}"
    assert [line.split(":")[0] for line in text.split("\n")] == ["- card_arrival", "- age_limit", "- exchange_rate"]
    df = spark.createDataFrame([("Where is my card?",)], "text string")
    prompt = df.select(teach.build_prompt(F.col("text"), block.scalar())).first()[0]
    assert prompt == (
        f"{teach.PROMPT_HEADER}\n\n# Intent classes\n{text}\n\n# Customer message\nWhere is my card?\n\n{teach.PROMPT_FOOTER}"
    )


def test_descriptions_cover_the_class_list(spark, classes):
    assert len(taxonomy.DESCRIPTIONS) == 77
    described = taxonomy.description_table(spark)
    taxonomy.assert_described(classes, described)
    more = classes.union(spark.createDataFrame([(3, "nobody_knows")], "a int, b string"))
    with pytest.raises(ValueError, match="nobody_knows"):
        taxonomy.assert_described(more, described)


def test_fingerprints(spark, classes):
    changed = {**taxonomy.DESCRIPTIONS, "age_limit": "something else"}
    one = spark.range(1)

    def mark(block="a", model="m-1", **more):
        return one.select(teach.run_fingerprint(F.lit(block), model, **more)).first()[0]

    assert mark() == mark() and len(mark()) == 16
    assert len({mark(), mark("b"), mark(model="m-2"), mark(temperature=0.5), mark(prompt_version="4")}) == 5

    def of(descriptions, order):
        table = taxonomy.description_table(spark, descriptions).orderBy(order)
        return taxonomy.fingerprint_table(classes, table).first()[0]

    same = of(taxonomy.DESCRIPTIONS, F.asc("label_name"))
    assert same == of(taxonomy.DESCRIPTIONS, F.desc("label_name")) != of(changed, F.asc("label_name"))


LABELS = "row_id long, text string, teacher_intent_name string, teacher_intent_id int, error string, gold_label_id int, gold_label_name string, correct boolean, input_tokens long, output_tokens long, latency_ms double, split string, prompt_version string, prompt_fingerprint string"


def label_rows(spark, answers, **fixed):
    """``answers``: (teacher id, gold id) pairs; id -1 is an unknown intent."""
    base = {"split": "val", "prompt_version": "3", "prompt_fingerprint": "f", **fixed}
    rows = [
        (
            i, f"t{i}", f"n{t}" if t >= 0 else "odd", t, None if t >= 0 else "unknown_intent", g, f"n{g}", t == g,
            1000, 10, 100.0 * (i + 1), base["split"], base["prompt_version"], base["prompt_fingerprint"],
        )
        for i, (t, g) in enumerate(answers)
    ]
    return spark.createDataFrame(rows, LABELS)


ANSWERS = [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (-1, 0), (1, 1), (2, 1), (2, 1), (2, 2)]


def test_summary_and_its_denominators(spark):
    df = label_rows(spark, ANSWERS)
    s = L.labeling_summary(df).first()
    assert (s["n_rows"], s["errors"], s["error_rate"], s["teacher_vs_gold_accuracy"]) == (10, 1, 0.1, 0.4)
    assert (s["input_total"], s["output_total"]) == (10000, 100)
    assert s["cost_usd"] == pytest.approx(0.00325)
    assert s["latency_ms_p50"] == 550.0 and s["latency_ms_p95"] == pytest.approx(955.0)
    c = L.ceiling_accuracy(df).first()
    assert c["ceiling_top1_accuracy"] == pytest.approx(4 / 9) and c["n_valid"] == 9
    per = {r["gold_label_name"]: (r["n"], r["correct"]) for r in L.class_accuracy(df).collect()}
    assert per == {"n0": (6, 2), "n1": (3, 1), "n2": (1, 1)}
    o = L.error_overview(df).first()
    assert (o["total"], o["correct"], o["misses"], o["parse_errors"]) == (10, 4, 6, 1)
    empty = L.labeling_summary(df.where("false")).first()
    assert (empty["n_rows"], empty["error_rate"], empty["latency_ms_p99"]) == (0, 0.0, 0.0)


def test_distribution_pairs_and_examples(spark):
    df = label_rows(spark, ANSWERS)
    assert [tuple(r) for r in L.label_distribution(df).collect()] == [("n2", 4), ("n1", 3), ("n0", 2)]
    pairs = [(r[0], r[1], r["n"]) for r in L.error_pairs(df).collect()]
    assert pairs == [("n0", "n1", 2), ("n1", "n2", 2), ("n0", "n2", 1)]
    shown = L.confusion_examples(df, per_pair=1, top_n=2).collect()
    assert sorted((r["gold_label_name"], r["row_id"]) for r in shown) == [("n0", 2), ("n1", 7)]
    # n0 and n1 both have accuracy 1/3; the larger class comes first.
    assert [r["gold_label_name"] for r in L.worst_classes(df, 2).collect()] == ["n0", "n1"]


def test_examples_are_limited_before_the_shuffle(spark):
    plan = L.confusion_examples(label_rows(spark, ANSWERS))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("cap, kept", [(0.0, 1), (0.55, 2), (1.0, 2), (1.1, 3), (99, 10)])
def test_budget_keeps_the_crossing_row(spark, cap, kept):
    df = spark.createDataFrame([(i, 1_000_000, 100_000) for i in range(10)], "row_id long, input_tokens long, output_tokens long")
    rows = L.budget_cutoff(df, cap).orderBy("row_id").collect()  # 0.55 dollars a row
    assert [r["row_id"] for r in rows] == list(range(kept))
    assert rows[-1]["spent_usd"] == pytest.approx(0.55 * kept)


# --- guards --------------------------------------------------------------------


def stored(spark, name, df):
    path = f"{run_folder(spark, name)}/labels.parquet"
    df.write.parquet(path)
    return path


def test_training_tables(spark):
    train = stored(spark, "train", label_rows(spark, [(0, 0), (1, 0), (-1, 0), (2, 2), (-1, 1)], split="train"))
    val = stored(spark, "val", label_rows(spark, [(0, 1), (-1, 1)]))
    tables = S.load_training_tables(spark, train, val)
    assert (tables.train.count(), tables.val.count(), tables.dropped) == (3, 1, {"train": 2, "val": 1})
    row = tables.val.first()
    assert (row["teacher_intent_id"], row["gold_label_id"]) == (0, 1)
    assert (tables.prompt_version, tables.prompt_fingerprint) == ("3", "f")


def test_guards_refuse_wrong_tables(spark):
    good = label_rows(spark, [(0, 0)], split="train")
    train = stored(spark, "train", good)
    val = stored(spark, "val", label_rows(spark, [(0, 0)]))
    mixed_split = stored(spark, "mixed", good.union(label_rows(spark, [(0, 0)])))
    mixed_prints = stored(spark, "mixed", label_rows(spark, [(0, 0)]).union(label_rows(spark, [(0, 0)], prompt_fingerprint="g")))
    other_print = stored(spark, "other", label_rows(spark, [(0, 0)], prompt_fingerprint="g"))
    other_version = stored(spark, "other", label_rows(spark, [(0, 0)], prompt_version="2"))
    for a, b, told in [
        (val, val, "split='train'"),
        (mixed_split, val, "split='train'"),
        (train, mixed_prints, "val labels .* not all made with one known prompt"),
        (train, other_print, "differ in prompt_fingerprint"),
        (train, other_version, "differ in prompt_version"),
    ]:
        with pytest.raises(ValueError, match=told):
            S.load_training_tables(spark, a, b)
    null_split = stored(spark, "null", good.union(good.withColumn("split", F.lit(None).cast("string"))))
    unnamed = stored(spark, "unnamed", good.union(good.withColumn("prompt_fingerprint", F.lit(None).cast("string"))))
    empty = stored(spark, "empty", good.limit(0))
    for a, told in [(null_split, "1 without a split"), (unnamed, "one known prompt"), (empty, "None to None")]:
        with pytest.raises(ValueError, match=told):
            S.load_training_tables(spark, a, val)
    with pytest.raises(ValueError, match="No split is called"):
        S.load_split(good, "test")


def test_guards_read_each_table_once(spark):
    """Guards, dropped counts and the copy of the usable rows come from one scan."""
    counted = spark.sparkContext.statusTracker()
    train = stored(spark, "train", label_rows(spark, [(0, 0), (-1, 0)], split="train"))
    val = stored(spark, "val", label_rows(spark, [(-1, 1)]))
    spark.sparkContext.setJobGroup("guarded", "one scan")
    tables = S.load_training_tables(spark, train, val)
    jobs = counted.getJobIdsForGroup("guarded")
    spark.sparkContext.setJobGroup("other", "after")
    assert len(jobs) == 1 and tables.dropped == {"train": 1, "val": 1}
    assert tables.val.count() == 0 and tables.val.columns == tables.train.columns
    assert tables.train.first()["split"] == "train"


def test_latest_run_comes_from_listings(spark):
    path = run_folder(spark, "runs")
    assert S.listed_runs(spark, path) == []
    with pytest.raises(ValueError, match="no runs"):
        S.read_latest_run(spark, path)
    rows = label_rows(spark, [(0, 0)])
    for run, split in (("2026-01-02T00-00-00Z", "val"), ("2026-01-03T00-00-00Z", "train"), ("a run: 1", "val")):
        S.write_labels(rows.withColumns({"run_id": F.lit(run), "split": F.lit(split)}), path)
    assert S.listed_runs(spark, path) == ["2026-01-02T00-00-00Z", "2026-01-03T00-00-00Z", "a run: 1"]
    spark.sparkContext.setJobGroup("listing", "no job")
    assert S.listed_runs(spark, path)[-1] == "a run: 1"
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("listing")
    assert [r["run_id"] for r in S.read_latest_run(spark, path).collect()] == ["a run: 1"]


def test_run_ids(spark):
    paths = ["s3a://b/v1/train/2026-05-12T10-00-00Z/labels.parquet", "/x/val/r1/labels.parquet/part-0.parquet", "/x/part-0.parquet"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(S.run_id_from_path(F.col("p"))).collect()] == ["2026-05-12T10-00-00Z", "r1", ""]


# --- the labeling job ------------------------------------------------------------


def messages(spark, n):
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.concat(F.lit("m"), "id").alias("text"), F.lit(0).alias("gold_label_id")
    )


@pytest.fixture
def paid_labeler():
    """A labeler of 0.55 dollars a call; made here, so that tasks need not import this file."""

    def load():
        def label(text):
            if text == "m3":
                raise ValueError("malformed message")
            return jobs.Answer('{"intent": "age_limit"}', 1_000_000, 100_000, 5.0, "rule")

        return label

    return load


def test_job_stops_at_the_cap_and_resumes(spark, paid_labeler):
    path = run_folder(spark, "job")
    first = jobs.run_label_job(messages(spark, 10), path, paid_labeler, max_cost_usd=1.0, concurrency=1, step_rows=4)
    # 0.55 dollars a call: the second crosses the cap.
    assert sorted(r["row_id"] for r in first.answers.collect()) == [0, 1]
    assert first.over_budget and first.spent_usd == pytest.approx(1.1)
    rest = jobs.run_label_job(messages(spark, 10), path, paid_labeler, max_cost_usd=100.0, concurrency=3, step_rows=4)
    assert sorted(r["row_id"] for r in rest.answers.collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    assert [tuple(r) for r in rest.failures.collect()] == [(3, "ValueError", "malformed message")]
    assert rest.n_failed == 1 and not rest.over_budget

    def free_labeler():
        return lambda text: jobs.Answer("{}", 0, 0, 1.0, "rule-2")

    # The failed row has no answer, so a later run asks for it again and for nothing else.
    done = jobs.run_label_job(messages(spark, 10), path, free_labeler).answers.orderBy("row_id").collect()
    assert [r["row_id"] for r in done] == list(range(10))
    assert [r["row_id"] for r in done if r["model_version"] == "rule-2"] == [3]
    nothing = jobs.run_label_job(messages(spark, 10), path, paid_labeler)
    assert nothing.answers.count() == 10 and nothing.spent_usd == 0


@pytest.mark.parametrize("concurrency", [1, 4])
def test_cap_is_overshot_by_one_call_per_task(spark, paid_labeler, concurrency):
    path = run_folder(spark, "job")
    rows = messages(spark, 400).where("row_id <> 3")
    got = jobs.run_label_job(rows, path, paid_labeler, max_cost_usd=11.0, concurrency=concurrency)
    assert 20 < got.answers.count() <= 20 + 1 + concurrency


def test_job_without_a_cap_goes_on_after_its_first_step(spark, paid_labeler):
    path = run_folder(spark, "job")
    got = jobs.run_label_job(messages(spark, 10), path, paid_labeler, float("inf"), concurrency=2, step_rows=4)
    assert sorted(r["row_id"] for r in got.answers.collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    assert got.n_failed == 1 and got.spent_usd == pytest.approx(4.95) and not got.over_budget


def test_steps_that_are_answered_at_once_are_not_looked_through_again(spark, paid_labeler, monkeypatch):
    looked = []
    monkeypatch.setattr(jobs, "computed_now", lambda df: looked.append(df) or df.localCheckpoint())
    got = jobs.run_label_job(messages(spark, 10), run_folder(spark, "job"), paid_labeler, 99.0, 2, step_rows=4)
    assert got.answers.count() == 9 and got.n_failed == 1 and looked == []


def test_failing_labeler_is_seen(spark):
    def always():
        def label(text):
            raise RuntimeError("no quota")

        return label

    def broken():
        return lambda text: undefined_name  # noqa: F821

    got = jobs.run_label_job(messages(spark, 6), run_folder(spark, "job"), always, concurrency=2)
    assert (got.answers.count(), got.n_failed, got.failures.count()) == (0, 6, 6)
    with pytest.raises(Exception, match="undefined_name"):
        jobs.run_label_job(messages(spark, 6), run_folder(spark, "job"), broken)


def test_calls_are_dealt_to_as_many_tasks_as_asked_for(spark):
    rows = messages(spark, 2000).withColumn("prompt", F.col("text"))
    dealt = rows.coalesce(1).repartitionByRange(6, "row_id")
    assert dealt.groupBy(F.spark_partition_id()).count().count() == 6


def test_a_run_with_its_prompt_and_summary(spark, paid_labeler, classes):
    described = taxonomy.description_table(spark)
    asked = jobs.with_prompts(messages(spark, 5).where("row_id <> 3"), classes, described)
    assert asked.first()["prompt"].startswith(teach.PROMPT_HEADER)
    path = run_folder(spark, "run")
    result = jobs.run_label_job(asked, f"{path}/calls", paid_labeler, max_cost_usd=99.0)
    run_id = spark.range(1).select(S.run_id_at(F.timestamp_seconds(F.lit(0)))).first()[0]
    assert run_id == "1970-01-01T00-00-00Z"
    jobs.store_run(result.answers, classes, described, path, "val", run_id, "3")
    stored_rows = S.read_latest_run(spark, f"{path}/labels").collect()
    assert [(r["teacher_intent_id"], r["gold_label_name"], r["correct"], r["split"]) for r in stored_rows] == [
        (1, "card_arrival", False, "val")
    ] * 4
    summary = spark.read.json(f"{path}/runs/val/{run_id}/summary").first()
    prompt = spark.read.json(f"{path}/runs/val/{run_id}/prompt").first()
    assert summary["n_rows"] == 4 and "{message}" in prompt["prompt"]
    assert prompt["prompt_fingerprint"] == stored_rows[0]["prompt_fingerprint"]


def test_undescribed_classes_are_an_error(spark, classes):
    few = taxonomy.description_table(spark, {"age_limit": "x", "card_arrival": "y"})
    for table in (taxonomy.taxonomy_block(classes, few), taxonomy.fingerprint_table(classes, few)):
        with pytest.raises(Exception, match="exchange_rate"):
            table.collect()


def test_null_groups_keep_their_numbers(spark):
    rows = label_rows(spark, ANSWERS).withColumn("split", F.when(F.col("row_id") < 5, F.col("split")))
    found = {r["split"]: r for r in L.labeling_summary(rows, ["split"]).collect()}
    assert found[None]["latency_ms_p50"] == 800.0 and found["val"]["n_rows"] == 5


class Flaky(Exception):
    def __init__(self, message, code=None):
        super().__init__(message)
        self.code = code


def test_retries():
    def labeler(errors):
        left = list(errors)

        def label(text):
            if left:
                raise left.pop(0)
            return jobs.Answer("{}", 1, 1, 0.0, "m")

        return label

    waits, policy = [], jobs.RetryPolicy()
    assert jobs.call_with_retry(labeler([Flaky("x", 429), Flaky("Deadline exceeded")]), "t", waits.append)
    assert 1.0 <= waits[0] <= 1.5 and 2.0 <= waits[1] <= 3.0
    with pytest.raises(Flaky):
        jobs.call_with_retry(labeler([Flaky("timeout")] * 3), "t", waits.append)
    with pytest.raises(ValueError):
        jobs.call_with_retry(labeler([ValueError("bad"), Flaky("x", 503)]), "t", waits.append)
    assert not policy.worth_a_retry(Flaky("nope", 400)) and policy.worth_a_retry(Flaky("nope", 502))
    assert policy.is_call_error(Flaky("x", 400)) and not policy.is_call_error(Flaky("x")) and not policy.is_call_error(NameError())

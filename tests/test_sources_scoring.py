import ast
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskspark.operators import ml, scoring
from deskspark.plans import tables as P
from deskspark.session import run_folder, shared_folder
from deskspark.sources import audit, embeddings, golden
from deskspark.sources.results import load_classifier, save_classifier
from deskspark.streaming.scoring import start_scoring, stream_files

SALT = b"s"


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir", shared_folder(spark))
    assert run_folder(spark, "a") != run_folder(spark, "a")


def test_golden_is_written_once(spark):
    root = run_folder(spark, "golden")
    rows = spark.createDataFrame([(1, "a", 0, "test"), (2, "b", 1, "test")], "row_id long, text string, label int, split string")
    first = golden.load_golden(spark, root, lambda: rows).orderBy("row_id").collect()

    def never():
        raise AssertionError("golden rows were made twice")

    assert golden.load_golden(spark, root, never).orderBy("row_id").collect() == first
    assert golden.load_golden(spark, root, lambda: rows.limit(0), version="v2").count() == 0


def test_training_code_cannot_reach_golden_rows():
    package = Path(ml.__file__).resolve().parents[1]
    for name in ("operators/ml.py", "operators/calibration.py"):
        tree = ast.parse((package / name).read_text())
        imported = [n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)]
        assert not any(m and ("golden" in m or "evaluation" in m) for m in imported)


def test_embedding_cache(spark):
    messages = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "b", "c"])], "row_id long, text string")
    key = embeddings.cache_key("enc", F.col("text"))
    cache = messages.where("text = 'a'").select(key.alias("cache_key"), F.array(F.lit(1.0)).alias("embedding"))
    missing = embeddings.cache_misses(messages, cache, "enc")
    assert sorted(r["text"] for r in missing.collect()) == ["b", "c"]
    assert embeddings.cache_misses(messages, cache, "other").count() == 3
    found = embeddings.with_embeddings(messages, cache, "enc").orderBy("row_id").collect()
    assert [r["embedding"] for r in found] == [[1.0], None, None, None]


@pytest.fixture
def requests(spark):
    rows = [
        ("r1", "the cat of the house and user@example.com said the end "),
        ("", "le chat de la maison et le chien "),
        (None, "x" * 2001),
        (None, " der Hund und die Katze "),
    ]
    return spark.createDataFrame(rows, "request_id string, text string")


def predict(spark, score, df):
    return scoring.predict_messages(df, P.language_classes(spark), SALT, "v1", score, 2.0, 3)


def test_only_redacted_text_reaches_model_and_audit(spark, requests):
    def load():
        def score(texts):
            assert not any("@" in t for t in texts)
            return np.zeros((len(texts), 4))

        return score

    rows = predict(spark, lambda df, text: scoring.score_texts(df, load, text), requests).collect()
    assert len(rows) == 3
    assert all("@" not in r["input_text_redacted"] for r in rows)
    assert any("[EMAIL]" in r["input_text_redacted"] for r in rows)
    assert all(r["latency_ms"] >= 0 and r["confidence"] == 0.25 for r in rows)


def test_audit_rows(spark, requests):
    path = run_folder(spark, "audit")
    audit.write_audit(predict(spark, P.language_logits, requests), path)
    rows = audit.read_audit(spark, path).collect()
    assert len(rows) == 3 and len({r["request_id"] for r in rows}) == 3
    assert "r1" in {r["request_id"] for r in rows} and "" not in {r["request_id"] for r in rows}
    assert {r["predicted_intent"] for r in rows} == {"english", "french", "german"}
    for r in rows:
        assert len(r["top_k_intents"]) == 3 and r["top_k_intents"][0] == r["predicted_intent"]
        assert r["top_k_confidences"][0] == r["confidence"] == max(r["top_k_confidences"])
        assert r["timestamp"].date() == r["event_date"]


def test_rejects_leave_a_row(spark, requests):
    from deskspark.streaming.scoring import start_rejecting

    odd = requests.union(spark.createDataFrame([("a", ""), ("b", None), ("c", "x" * 2001)], requests.schema))
    rows = scoring.rejected_messages(odd, "v1").collect()
    reasons = {r["request_id"]: r["reason"] for r in rows}
    assert [reasons[c] for c in "abc"] == ["empty", "no text", "too long"]
    assert len(rows) + predict(spark, P.language_logits, odd).count() == odd.count()
    source, out, state = (run_folder(spark, n) for n in ("in", "rejects", "state"))
    odd.write.parquet(source)
    start_rejecting(stream_files(spark, source, odd.schema), "v1", out, state, once=True).awaitTermination()
    assert spark.read.parquet(out).count() == len(rows)


def test_own_audit_writer_and_redactor(spark, requests):
    seen, source, state = [], run_folder(spark, "in"), run_folder(spark, "state")
    requests.write.parquet(source)

    def hide(df, salt):
        return df.withColumns({"redacted_text": F.lit("hidden"), "spans": F.lit(None)})

    def hidden(df):
        return scoring.predict_messages(df, P.language_classes(spark), SALT, "v1", P.language_logits, redact=hide)

    stream = stream_files(spark, source, requests.schema)
    job = start_scoring(stream, hidden, "", state, once=True, write=lambda df, i: seen.extend(df.collect()))
    job.awaitTermination()
    assert len(seen) == 3 and {r["input_text_redacted"] for r in seen} == {"hidden"}


def test_python_and_native_scorers_agree(spark, requests):
    texts = requests.select("text")
    native = P.language_logits(texts, "text").orderBy("text").collect()
    python = scoring.score_texts(texts, P.load_language_model).orderBy("text").collect()
    assert [r["logits"] for r in native] == [r["logits"] for r in python]


def test_stream_equals_batch_and_resumes(spark, requests):
    source, out, state = (run_folder(spark, n) for n in ("in", "out", "state"))

    def drain():
        messages = stream_files(spark, source, requests.schema, files_per_batch=1)
        job = start_scoring(messages, lambda df: predict(spark, P.language_logits, df), out, state, once=True)
        job.awaitTermination()
        return audit.read_audit(spark, out)

    requests.where("request_id = 'r1'").write.mode("append").parquet(source)
    assert drain().count() == 1
    requests.where("request_id IS DISTINCT FROM 'r1'").write.mode("append").parquet(source)
    both = drain().select("input_text_redacted", "predicted_intent", "confidence")
    batch = predict(spark, P.language_logits, requests).select(*both.columns)
    assert sorted(both.collect()) == sorted(batch.collect())
    assert drain().count() == 3


def test_classifier_solves_the_penalised_problem(spark):
    rng = np.random.default_rng(0)
    n, d, k = 240, 5, 3
    y = rng.choice(k, n, p=[0.6, 0.3, 0.1])
    x = rng.normal(0, 1, (n, d)) + np.eye(k, d)[y]
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "embedding array<double>, label int")
    model = ml.train_classifier(df)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weight = n / (k * np.bincount(y))[y]
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    residual = (p - np.eye(k)[y]) * weight[:, None]
    # Gradient of sum(weight * loss) + |w|^2 / 2 is zero at the solution.
    assert np.abs(residual.T @ x + w).max() < 1e-3
    assert np.abs(residual.sum(0)).max() < 1e-3
    told = {(r["label"], r["component"]): r for r in ml.penalised_gradient(model, df).collect()}
    assert len(told) == k * (d + 1)
    for c in range(k):
        for j in range(d):
            assert told[c, j]["gradient"] == pytest.approx((residual.T @ x + w)[c, j], abs=1e-9)
            assert told[c, j]["scale"] == pytest.approx((np.abs(residual.T) @ np.abs(x) + np.abs(w))[c, j])
        assert told[c, -1]["gradient"] == pytest.approx(residual.sum(0)[c], abs=1e-9)
    stopped = ml.penalised_gradient(ml.train_classifier(df, max_iter=1), df).collect()
    assert max(abs(r["gradient"]) / r["scale"] for r in stopped) > 0.01
    got = np.array([r["logits"] for r in ml.predict_logits(model, df).collect()])
    np.testing.assert_allclose(np.sort(got, 0), np.sort(z, 0), atol=1e-9)
    path = run_folder(spark, "model")
    save_classifier(model, path, {"train_run_id": "r1"}, {"max_iter": 1000})
    assert np.allclose(load_classifier(path).coefficientMatrix.toArray(), w)
    manifest = spark.read.json(f"{path}/manifest").first()
    assert manifest["train_run_id"] == "r1" and len(manifest["training_config_hash"]) == 16


def test_scores_of_unseen_classes(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "logits array<double>")
    row = scoring.with_probabilities(ml.on_class_list(df, [0, 2], 3)).first()
    assert row["probs"][1] == 0.0 and sum(row["probs"]) == pytest.approx(1.0)

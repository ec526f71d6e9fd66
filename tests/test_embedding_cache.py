import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from deskspark.sources import commits, embeddings

# The encoders below run in tasks, which cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "row_id long, text string"


def messages(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)


def load():
    return lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts]


def broken():
    def encode(texts):
        raise RuntimeError("the encoder went away")

    return encode


def keys(spark, path):
    return [r.cache_key for r in embeddings.read_cache(spark, path).collect()]


def test_only_misses_are_encoded(spark, tmp_path):
    path = str(tmp_path / "cache")
    first = messages(spark, ["a", "bb", "a", None, ""])
    assert embeddings.read_cache(spark, path).count() == 0
    assert embeddings.fill_cache(first, path, "enc", load) == 3
    more = messages(spark, ["a", "bb", "aaa", "aaa"])
    assert embeddings.fill_cache(more, path, "enc", load) == 1
    # Nothing is missing now, so an encoder that would fail is never called.
    assert embeddings.fill_cache(more.union(first), path, "enc", broken) == 0
    assert len(keys(spark, path)) == len(set(keys(spark, path))) == 4
    assert commits.latest(spark, path).number == 2
    found = embeddings.embed_messages(first, path, "enc", broken).orderBy("row_id").collect()
    assert [r.embedding for r in found] == [[1.0, 1.0], [2.0, 0.0], [1.0, 1.0], None, [0.0, 0.0]]
    # Another encoder shares nothing with this one.
    assert embeddings.fill_cache(first, path, "other", load) == 3


def test_a_killed_fill_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    texts = messages(spark, ["a", "b"])
    with pytest.raises(Exception, match="went away"):
        embeddings.fill_cache(texts, path, "enc", broken)
    # Killed after its rows were written and before they were published.
    missing = embeddings.cache_misses(texts, embeddings.read_cache(spark, path), "enc")
    commits.new_part(embeddings.encode_texts(missing, load), path)
    assert keys(spark, path) == [] and commits.latest(spark, path) == commits.Version(0, ())
    assert embeddings.fill_cache(texts, path, "enc", load) == 2 and len(keys(spark, path)) == 2
    assert commits.remove_unlisted(spark, path, 3_600_000) == 0
    assert commits.remove_unlisted(spark, path, 0) >= 1 and len(keys(spark, path)) == 2


def test_fills_at_the_same_time_add_each_key_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    ours, theirs = messages(spark, ["a", "b", "c"]), messages(spark, ["b", "c", "d"])
    plain, met = commits.publish, []

    def late(spark_, path_, after, parts):
        if not met:
            met.append(plain(spark_, path_, after, (*after.parts, other)))
        return plain(spark_, path_, after, parts)

    missing = embeddings.cache_misses(theirs, embeddings.read_cache(spark, path), "enc")
    other = commits.new_part(embeddings.encode_texts(missing, load), path)
    monkeypatch.setattr(commits, "publish", late)
    assert embeddings.fill_cache(ours, path, "enc", load) == 1
    assert met[0].number == 1 and commits.latest(spark, path).number == 2
    assert len(keys(spark, path)) == len(set(keys(spark, path))) == 4


def test_a_number_is_published_once(spark, tmp_path):
    path = str(tmp_path / "t")
    none = commits.latest(spark, path)
    assert commits.publish(spark, path, none, ("x",)) == commits.Version(1, ("x",))
    assert commits.publish(spark, path, none, ("y",)) is None
    assert commits.latest(spark, path) == commits.Version(1, ("x",))


def test_compaction_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "cache")
    for texts in (["a", "b"], ["c"], ["d", "e", "f"]):
        embeddings.fill_cache(messages(spark, texts), path, "enc", load)
    before = sorted(keys(spark, path))
    assert embeddings.compact_cache(spark, path, 2)
    assert sorted(keys(spark, path)) == before and len(commits.latest(spark, path).parts) == 1
    assert not embeddings.compact_cache(spark, path, 2)
    assert embeddings.fill_cache(messages(spark, ["f", "g"]), path, "enc", load) == 1


@pytest.mark.parametrize(
    "wrong", [lambda: lambda t: np.zeros((len(t) + 1, 2)), lambda: lambda t: [[float("nan")]] * len(t), lambda: lambda t: [1.0] * len(t)]
)
def test_unusable_vectors_are_refused(spark, tmp_path, wrong):
    path = str(tmp_path / "cache")
    with pytest.raises(Exception, match="no usable vectors"):
        embeddings.fill_cache(messages(spark, ["a", "b"]), path, "enc", wrong)
    assert embeddings.read_cache(spark, path).count() == 0


def test_small_batches(spark):
    texts = messages(spark, [str(i) for i in range(50)]).select(
        embeddings.cache_key("e", F.col("text")).alias("cache_key"), "text"
    )
    rows = embeddings.encode_texts(texts, load, rows=7).collect()
    assert len(rows) == 50 and {r.embedding[0] for r in rows} == {1.0, 2.0}


def test_only_missing_texts_move_and_copies_collapse_before(spark, capsys):
    texts = [f"text {i % 2000}" for i in range(6000)]
    asked, old = messages(spark, [*texts, None]), messages(spark, texts[:1950])
    cache = old.select(embeddings.cache_key("enc", F.col("text")).alias("cache_key"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = embeddings.cache_misses(asked, cache, "enc")
        found.explain()
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(r.text for r in rows) == sorted(texts[1950:2000]) and len({r.cache_key for r in rows}) == 50
    lines = capsys.readouterr().out.splitlines()
    hashed = [i for i, line in enumerate(lines) if "sha2(" in line]
    assert len(hashed) == 1, "a text's key is made once"
    exchange = max(i for i, line in enumerate(lines[: hashed[0]]) if "Exchange hashpartitioning(cache_key" in line)
    assert "partial_first(text" in lines[exchange + 1]


def test_sieve_lets_all_keys_through_and_few_others(spark):
    keyed = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("cache_key"))
    assert embeddings._sieved(keyed, keyed).count() == 200_000
    some = keyed.where("id % 100 = 0")
    passed = embeddings._sieved(keyed, some)
    assert passed.where("id % 100 = 0").count() == 2_000 and passed.count() < 2_100

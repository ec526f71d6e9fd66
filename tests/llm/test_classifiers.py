import random
from pathlib import Path

import numpy as np
import pytest

from deskspark.llm import queries
from deskspark.llm import quality as Q
from deskspark.llm import toxicity as T

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


def auc(label, score):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name, label, least", [("op3_quality", "quality", 0.95), ("op4_toxicity", "toxic", 0.95)])
def test_held_out_scores(spark, name, label, least):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    scored = queries.QUERIES[name](spark, LARGER)
    assert scored.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    rows = scored.where("held_out").join(labels, "doc_id").toPandas()
    assert auc(rows[label].to_numpy(), rows["score"].to_numpy()) > least
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all() and rows["score"].between(0, 1).all()


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op2_language(spark, SF).where("held_out").join(docs, "doc_id").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.98


def test_tokens_do_not_depend_on_place():
    text = "Ab, cd  Ab,\nAb ,, é!".encode()
    data = np.frombuffer(text, np.uint8)
    ids, _ = Q.tokens(data, np.array([0]))
    assert len(ids) == 9 and ids[0] == ids[3] == ids[5] and ids[1] == ids[4] and len(set(ids.tolist())) == 6
    both, texts = Q.tokens(np.concatenate([data, data]), np.array([0, len(data)]))
    assert both.tolist() == [*ids, *ids] and texts.tolist() == [0] * 9 + [1] * 9


def test_context_sums_by_hand():
    places, signs = Q.index_vectors()
    ids, texts = np.array([5, 9, 5, 7, 8]), np.array([0, 0, 0, 1, 1])
    vectors = np.zeros((Q.BUCKETS, Q.DIMENSIONS))
    for b in range(Q.BUCKETS):
        np.add.at(vectors[b], places[b], signs[b])
    want = np.zeros_like(vectors)
    for i in range(5):
        for j in range(max(0, i - 2), min(5, i + 3)):
            if i != j and texts[i] == texts[j]:
                want[ids[i]] += vectors[ids[j]]
    assert np.allclose(Q.context_sums(ids, texts, places, signs).reshape(want.shape), want)


def test_pooling_in_blocks_gives_the_same(monkeypatch):
    draw = random.Random(1)
    texts = [" ".join(draw.choice(["aa", "bb", "c!"]) for _ in range(draw.randint(0, 400))).encode() for _ in range(9)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    vectors = np.random.default_rng(0).normal(size=(Q.BUCKETS, Q.DIMENSIONS)).astype(np.float32)
    whole = Q.pooled(data, starts, vectors)
    monkeypatch.setattr(Q, "BLOCK_BYTES", 64)
    assert np.allclose(whole, Q.pooled(data, starts, vectors), atol=1e-5)


def test_network_and_temperature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert auc(y, Q.Network.fit(x, y).predict(x)) > 0.95
    z = rng.normal(size=20_000) * 2
    drawn = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(Q.best_temperature(3 * z, drawn) - 3) < 0.2


def test_folding():
    told = T.folded("STуp1d! Café​ “Id​iot” 1d10t")
    assert told == " styp1d ".replace("1", "i") + "cafe idiot idiot "
    assert T.folded(None) == T.folded("?!") == " "


def test_lexicon_words_stems_and_exceptions():
    toxic = {" bad ": 50, " lowei": 60, " loweia ": 20, " loweib ": 21, " lowe": 60, " the ": 90}
    chosen = T.choose_entries(toxic, {" the ": 900}, 100, 1000)
    assert set(chosen) == {" bad ", " lowei"}
    found = T.Lexicon(chosen, ("bad luck",))
    assert [h[:2] for h in found.hits(T.folded("Bad luck, b4d loweix!"))] == [(9, 14), (13, 19)]
    assert T.Lexicon({}).hits(" bad ") == []


def test_learning_and_odd_rows(spark, frame, odd, prose):
    rows = [(i, prose(i, 40) + (" zork" if i % 3 == 0 else "")) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    docs = frame([*rows, *odd, rows[0]])
    lexicon = T.learn_lexicon(docs, labels)
    assert " zork " in lexicon.weights
    got = T.score_toxicity(docs, lexicon).collect()
    assert len(got) == len(rows) + len(odd) + 1
    scores = {r["doc_id"]: r["score"] for r in got}
    assert min(scores[i] for i in range(0, 90, 3)) > 0.5 > max(scores[i] for i in range(1, 90, 3))
    assert scores[900] == scores[901] < 0.3
    nothing = T.learn_lexicon(docs, labels.where("toxic = 0"))
    assert not nothing.weights and T.score_toxicity(frame([]), nothing).count() == 0


def test_rare_toxic_words_stand_beside_a_rich_vocabulary(spark, frame):
    draw = random.Random(5)
    usual = ["".join(draw.choice("abcdefghij") for _ in range(9)) for _ in range(6000)]
    rows = [(i, " ".join(usual) + (" zork" if i < 7 else "") + (f" quib{'xy'[i % 2]}{chr(97 + i)}" if i < 10 else "")) for i in range(20)]
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(20)], "doc_id long, toxic int")
    assert len(T.entries_of(T.folded(rows[0][1]))) > 25_000
    weights = T.learn_lexicon(frame(rows), labels).weights
    counts = [{}, {}]
    for i, body in rows:
        for entry in T.entries_of(T.folded(body)):
            counts[i < 10][entry] = counts[i < 10].get(entry, 0) + 1
    toxic = {e: n for e, n in counts[1].items() if n >= T.MIN_DOCS}
    assert weights == T.choose_entries(toxic, counts[0], 10, 10) and {" zork ", " quib"} <= set(weights)


def test_exceptions_stand_in_no_toxic_document(spark, frame):
    # Toxic documents 0 to 99, clean ones 100 to 399: 11 clean ones are enough.
    after = {0: "hill", 1: "hill", **dict.fromkeys(range(100, 103), "hill"), **dict.fromkeys(range(103, 107), "pond")}
    after |= dict.fromkeys(range(107, 118), "tree")
    rows = [(i, f"some words zork {after.get(i, f'w{chr(97 + i % 26)}{chr(97 + i // 26)}')}") for i in range(118)]
    rows += [(i, "some words and others") for i in range(118, 400)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(400)], "doc_id long, toxic int")
    assert T.enough_clean(100, 300) == 11 and T.enough_clean(900, 100) == 3
    lexicon = T.learn_lexicon(frame(rows), labels, exceptions=())
    assert " zork " in lexicon.weights and lexicon.exceptions == ("zork tree",)
    assert len(lexicon.hits(T.folded("zork hill"))) == 1 and not lexicon.hits(T.folded("zork tree"))


def test_quality_learning_and_odd_rows(spark, frame, odd, prose):
    rows = [(i, prose(i, 60) if i % 2 else " ".join(["spam"] * 40 + ["##"] * 9)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    docs = frame([*rows, *odd, rows[0]])
    vectors, network = Q.learn_quality(docs, labels)
    scores = Q.score_quality(docs, vectors, network).collect()
    assert len(scores) == len(rows) + len(odd) + 1 and all(0 <= r["score"] <= 1 for r in scores)
    of = {r["doc_id"]: r["score"] for r in scores}
    assert min(of[i] for i in range(1, 120, 2)) > max(of[i] for i in range(0, 120, 2))
    none, net = Q.learn_quality(frame([]), labels)
    assert net is None and not none.any() and Q.score_quality(frame([(1, "a")]), none, net).first()["score"] == 0.5


def test_hits_in_exceptions_equal_brute_force_and_stay_linear():
    import random
    import time

    draw = random.Random(6)
    weights = {" bad ": 1.0, " worse ": 2.0, " ba": 0.5}
    lexicon = T.Lexicon(weights, ("bad day", "a bad day out", "worse luck", "day bad"))
    spared = [T.folded(p) for p in lexicon.exceptions]
    for _ in range(400):
        told = T.folded(" ".join(draw.choice(["bad", "day", "a", "out", "worse", "luck", "bat"]) for _ in range(12)))
        inside = [(i, i + len(p)) for p in spared for i in range(len(told)) if told.startswith(p, i)]
        want = [
            (i, i + len(e), w)
            for e, w in weights.items()
            for i in range(len(told))
            if told.startswith(e, i) and not any(s <= i and i + len(e) <= t for s, t in inside)
        ]
        assert sorted(lexicon.hits(told)) == sorted(want)
    took = []
    for n in (20_000, 80_000):
        told = T.folded("bad day worse " * n)
        started = time.process_time()
        assert len(lexicon.hits(told)) == n
        took.append(time.process_time() - started)
    assert took[1] < 10 * max(took[0], 0.1)

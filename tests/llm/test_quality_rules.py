import re
import warnings
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

from deskspark.llm import quality_rules as R


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(text):
    words = words_of(text)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, hit = Counter(wins), set()
    for i, w in enumerate(wins):
        if count[w] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def buckets_of(text):
    hashes = [xxhash.xxh64_intdigest(w, 42) for w in words_of(text)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    pairs = []
    for a, b in zip(signed, signed[1:]):
        seed = xxhash.xxh64_intdigest((a % (1 << 64)).to_bytes(8, "little"), 42)
        pairs.append(xxhash.xxh64_intdigest((b % (1 << 64)).to_bytes(8, "little"), seed))
    return [h % R.BUCKETS for h in hashes + pairs]


def verdicts(docs, good):
    raw, aim = np.zeros(R.BUCKETS), np.zeros(R.BUCKETS)
    for d, t in docs:
        for b in buckets_of(t):
            raw[b] += 1
            aim[b] += d in good
    prior = R.SMOOTHING * R.BUCKETS
    ratio = np.log((aim * raw.sum() / np.maximum(raw, 1) + prior) / (aim.sum() + prior))
    out = []
    for d, t in docs:
        told, b = brute(t), buckets_of(t)
        failed = told[0] < 20 or 100 * told[4] > 30 * told[0]
        score = float(ratio[b].mean()) if b else 0.0
        out.append((d, *told, failed, score, not failed and score >= R.THRESHOLD))
    return sorted(out, key=repr)


def test_counts_and_verdicts(spark, frame, prose, odd, monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 1 << 10)
    line = prose(50, 9)
    docs = [(i, prose(i, 30)) for i in range(30)]
    docs += [(60 + i, " ".join(w + "###" for w in prose(i, 30).split())) for i in range(10)]
    docs += [(70, f"{line}\n{line}\n \n{prose(1, 30)}\n{line}"), (71, "la " * 50), (72, prose(2, 19)), (73, prose(3, 8))]
    docs += [(74, (prose(4, 12) + " ") * 2 + prose(5, 80)), (75, "a\x0bb\x0cc d | <x> " * 9), (76, prose(9, 4000)), *odd, (3, prose(3, 30))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(25)] + [(60, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = R.judge(frame(docs), labels).collect()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept"]
    told = sorted((tuple(r[n] for n in names) for r in got), key=repr)
    for mine, theirs in zip(told, verdicts(docs, set(range(25))), strict=True):
        assert mine[:7] + mine[8:] == theirs[:7] + theirs[8:]
        assert mine[7] == pytest.approx(theirs[7], abs=1e-4)
    assert {r["doc_id"] for r in got if r["kept"]} >= set(range(25)) and not any(r["kept"] for r in got if r["doc_id"] in range(60, 70))
    carried = R.judge(frame(docs), labels, keep_columns=True)
    assert carried.columns == frame(docs).columns and carried.count() == sum(r["kept"] for r in got)
    assert R.judge(frame([]), labels).count() == 0 and R.judge(frame(docs), labels.where("1 = 0")).count() == len(docs)


def test_too_few_trusted_words_are_told(spark, frame, prose):
    docs = frame([(i, prose(i, 30)) for i in range(6)])
    labels = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, quality int")
    with pytest.warns(UserWarning, match="too few trusted"):
        R.judge(docs, labels)
    with warnings.catch_warnings():
        warnings.filterwarnings("error", "too few trusted")
        R.judge(docs, labels, threshold=-1e-4)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_clean_documents_stay(spark, folder):
    if not Path(folder).exists():
        pytest.skip("test tables are not here")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = R.judge(docs, labels).where("not base_failed").join(labels, "doc_id").toPandas()
    assert judged[judged["quality"] == 1]["kept"].mean() > 0.99

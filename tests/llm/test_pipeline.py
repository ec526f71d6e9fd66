import math
import re
import struct
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as P
from deskspark.llm import decontaminate, mixing, quality_rules, secrets, simhash
from deskspark.llm.secrets import RULES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def test_run_equals_the_operators_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    result = {r["doc_id"]: r for r in P.run(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in quality_rules.judge(docs, labels).where("kept").collect()}
    left = docs.where(docs.doc_id.isin(list(good)))
    groups = simhash.near_duplicates(left, bits=P.NEAR_BITS).collect()
    alone = {r["doc_id"] for r in groups if r["doc_id"] == r["component_id"]}
    left = left.where(docs.doc_id.isin(list(alone)))
    hits = decontaminate.find_benchmark_text(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    clean = {r["doc_id"] for r in hits if not r["items"]}
    assert set(result) == clean and 0 < len(clean) < len(alone) < len(good) < docs.count()
    left = left.where(docs.doc_id.isin(list(clean)))
    by_hand = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(P.mask_secrets(spark, left, SF)).collect()}
    assert {d: r["copies"] for d, r in result.items()} == by_hand


def test_reused_ids_lose_no_group(spark, frame, prose):
    texts = {name: prose(seed, 40) for seed, name in enumerate("ABCDE")}
    # B takes id 5 from A, A and C both have 5 as their smallest id, D and E share an id of their own.
    rows = [(5, "A"), (9, "A"), (3, "B"), (5, "B"), (5, "C"), (7, "C"), (8, "D"), (8, "E"), (8, "E"), (None, "D")]
    table = frame([(i, texts[t], "en", "s") for i, t in rows])
    kept = P.keep_one_of_each(spark, table, SF).collect()
    want = [(5, "A"), (3, "B"), (5, "C"), (8, "D"), (8, "E")]
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted((i, texts[t]) for i, t in want)


def test_stages_take_effect_on_odd_rows(spark, frame, odd, prose):
    docs = [(i, prose(i, 40), "en", "s") for i in range(20)]
    docs += [(30, prose(3, 40), "en", "s"), (None, prose(3, 40), "en", "s"), (None, prose(31, 40), "en", "s")]
    docs += [(4, prose(4, 40), "en", "s"), (32, prose(32, 40) + " password: abcdefgh12345", "en", None), *odd]
    table = frame(docs)
    names = table.columns
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, table, SF).columns == names
        assert stage(spark, table.where("1 = 0"), SF).count() == 0
    one = P.keep_one_of_each(spark, table.where("length(text) > 100"), SF).collect()
    assert sorted((r["doc_id"] for r in one if r["doc_id"] is not None)) == [*range(20), 32, 904]
    assert sum(r["doc_id"] is None for r in one) == 1
    masked = {r["doc_id"]: r["text"] for r in P.mask_secrets(spark, table, SF).collect()}
    assert masked[32].endswith("*" * 23) and len(masked[32]) == len(docs[24][1]) and masked[1] == docs[1][1]
    assert secrets.secret_counts(secrets.find_secrets(P.mask_secrets(spark, table, SF))).where("n_assign > 0").count() == 0
    assert P.mix(spark, table, SF).count() == len(docs)


SPACES, WORDS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def signed(digest):
    return digest - (1 << 64) if digest >> 63 else digest


def grams(text):
    """Buckets of words and of neighbours, hashed as columns are."""
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in SPACES.findall(text or "")]
    once = [xxhash.xxh64_intdigest(struct.pack("<q", h), 42) for h in hashes]
    pairs = [xxhash.xxh64_intdigest(struct.pack("<q", b), a) for a, b in zip(once, hashes[1:])]
    return [h % quality_rules.BUCKETS for h in hashes + [signed(p) for p in pairs]]


def good_by_brute_force(docs, labels):
    raw, aim = Counter(), Counter()
    trusted = {i for i, q in labels if q == 1}
    for i, text in docs:
        raw.update(grams(text))
        if i in trusted:
            aim.update(grams(text))
    prior, raws, aims = quality_rules.SMOOTHING * quality_rules.BUCKETS, sum(raw.values()), sum(aim.values())
    ratio = {b: float(np.float32(math.log((aim[b] * raws / raw[b] + prior) / (aims + prior)))) for b in raw}
    kept = []
    for i, text in docs:
        words, mine = SPACES.findall(text or ""), grams(text)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        repeated = {k + j for k, w in enumerate(windows) if w in twice for j in range(8)}
        fine = len(words) >= 20 and 100 * len(repeated) <= 30 * len(words)
        if fine and sum(ratio[b] for b in mine) / len(mine) >= quality_rules.THRESHOLD:
            kept.append((i, text))
    return kept


def fingerprint(text):
    words = SPACES.findall(lowered(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


def first_of_each_group(docs):
    prints = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= P.NEAR_BITS:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return [d for k, d in enumerate(docs) if top(k) == k]


def windows(words):
    return {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))} if words else set()


def without_benchmark(docs, items):
    known = set().union(*[windows(WORDS.findall(lowered(t))) for t in items])
    sizes = {len(w) for w in known}

    def holds(words):
        return any(tuple(words[k : k + n]) in known for n in sizes for k in range(len(words) - n + 1))

    return [(i, t) for i, t in docs if not holds(WORDS.findall(lowered(t)))]


def masked_by_regex(text):
    out = list(text)
    for rule in RULES:
        for m in re.finditer(rule.pattern, text):
            value = re.search(r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", m[0]) if rule.tail else None
            if len(value[1] if value else m[0]) >= rule.least:
                out[m.start() : m.end()] = "*" * (m.end() - m.start())
    return "".join(out)


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage on the stored result of the one before, against plain loops over the same rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted((r.doc_id, r.text) for r in docs.collect())
    got, seen = docs, []
    for name, stage in P.STAGES[:-1]:
        stage(spark, got, SF).write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        want = {
            "quality rules": lambda d: good_by_brute_force(d, labels),
            "near-dedup": first_of_each_group,
            "decontamination": lambda d: without_benchmark(d, items),
            "secret scan": lambda d: [(i, masked_by_regex(t)) for i, t in d],
        }[name](want)
        assert sorted((r.doc_id, r.text) for r in got.collect()) == want, name
        seen.append(len(want))
    assert seen[0] > seen[1] > seen[2] == seen[3] > 0
    rows = P.mix(spark, got, SF).collect()
    by_source = {}
    for r in got.collect():
        by_source.setdefault(r.source, []).append(len(SPACES.findall(r.text or "")))
    told = sorted((s for s in by_source if s is not None)) + [None] * (None in by_source)
    for source, aim in zip(told, mixing.targets([sum(by_source[s]) for s in told])):
        mine = [r for r in rows if r.source == source]
        assert sorted(r.size for r in mine) == sorted(by_source[source])
        assert {(r.source_size, r.target) for r in mine} == {(sum(by_source[source]), aim)}
        assert abs(sum(r.taken for r in mine) - aim) <= max(by_source[source])
        assert all(r.taken == r.copies * r.size and r.copies in (0, 1, 2) for r in mine)


def test_columns_of_any_name_and_ids_of_any_kind(spark, prose):
    """Names that operators use themselves, names with dots, and ids that are no numbers."""
    body = [prose(i, 40) for i in range(6)]
    rows = [(f"id {i}", body[i % 5], "en", "s", i, i, i, i, i) for i in range(10)] + [(None, body[5], "en", "s", *[90] * 5)]
    schema = "doc_id string, text string, lang string, source string, `_later` int, `_n_words` int, `_key` int, `a.b` int, `row` int"
    table = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES[:-1]:
        found = stage(spark, table, SF)
        assert found.columns == table.columns and found.schema["doc_id"].dataType.simpleString() == "string", name
        assert all(r["_later"] == r["_n_words"] == r["_key"] == r["a.b"] == r["row"] for r in found.collect())
    one = P.keep_one_of_each(spark, table, SF).collect()
    assert len(one) == 6 and {r["text"] for r in one} == set(body) and sum(r["doc_id"] is None for r in one) == 1
    assert P.mix(spark, table, SF).count() == 11
    assert P.keep_one_of_each(spark, table.select(F.lit(1).alias("doc_id"), "text"), SF).count() == 6

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from deskspark.llm import simhash as H
from deskspark.llm.components import component_labels


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    width = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ordered = sorted(root)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_near_duplicates(frame, prose, odd, monkeypatch):
    base = prose(1, 400)
    draw = random.Random(2)
    docs = [(i, prose(i, 30)) for i in range(30)] + [(50 + i, base) for i in range(5)] + [(3, prose(3, 30))]
    for i in range(60):
        words = base.split()
        words[draw.randrange(400)] = f"w{i}"
        docs.append((100 + i, " ".join(words)))
    docs += [*odd, (905, "one two"), (906, "ONE  two"), (907, prose(9, 50_000))]
    monkeypatch.setattr(H, "SHARD_ROWS", 20)
    monkeypatch.setattr(H, "LEAF_ROWS", 8)
    got = H.near_duplicates(frame(docs)).collect()
    prints = [brute_print(t) for _, t in docs]
    root = brute_components(prints)
    first = {}
    for (d, _), p in zip(docs, prints):
        if d is not None:
            first[root[p]] = min(first.get(root[p], d), d)
    want = sorted(((d, f"{p:016x}", first.get(root[p])) for (d, _), p in zip(docs, prints)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert H.near_duplicates(frame([])).count() == 0


def test_tree_loses_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64) * np.uint64(2)
    dense = np.full(500, base[0])
    for k in range(500):
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            dense[k] ^= np.uint64(1) << np.uint64(b)
    prints = np.unique(np.concatenate([base, dense]))
    want = brute_components([int(p) for p in prints])
    tree, n = H.grow_shards(rng.permutation(prints)[:400], 12, 3)
    shard, copies = H.route(tree, prints, 3)
    assert n > 4 and set(np.unique(copies)) == set(prints)
    root = {int(p): int(p) for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for s in range(n):
        for a, b in zip(*H.shard_links(copies[shard == s], 3)):
            root[find(int(a))] = find(int(b))
    groups = {}
    for p in root:
        groups.setdefault(find(p), set()).add(p)
    expected = {}
    for p, r in want.items():
        expected.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_a_dense_cluster_is_dealt_further_without_losing_a_link(spark, monkeypatch):
    """Distinct prints 2 to 9 bits around one point: no vantage point splits them, equal blocks do."""
    rng = np.random.default_rng(5)
    middle, prints = np.uint64(rng.integers(0, 2**63)), set()
    while len(prints) < 900:
        p = middle
        for b in rng.choice(64, rng.integers(2, 10), replace=False):
            p ^= np.uint64(1) << np.uint64(b)
        prints.add(int(p))
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    one = table.select(F.lit(0).cast("long").alias("shard"), "fp")
    for blocks in (4, 6):
        near = [(a, b) for a in list(prints)[:300] for b in list(prints)[:300] if a < b and (a ^ b).bit_count() <= 3]
        keyed = {r.fp % (1 << 64): set(r.k) for r in one.select("fp", F.array(*H.cover_keys(blocks, 3)).alias("k")).collect()}
        assert near and all(keyed[a] & keyed[b] for a, b in near)
        assert len(next(iter(keyed.values()))) == {4: 4, 6: 20}[blocks]
    monkeypatch.setattr(H, "SHARD_ROWS", 60)
    largest = [H.split_large(one, 3).groupBy("shard").count().agg(F.max("count")).first()[0]]
    assert largest[0] < 900 / 3
    monkeypatch.setattr(H, "SAMPLE_ROWS", 200)
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in H.print_links(table).collect()]
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = brute_components(prints)
    assert len({find(p) for p in prints}) == len(set(want.values()))
    assert len({(find(p), want[p]) for p in prints}) == len(set(want.values()))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in component_labels(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}
    assert component_labels(links.where("a < 0"), "a", "b").count() == 0

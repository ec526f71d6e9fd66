import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from deskspark.llm import clusters as C

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster string, own long, distance string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "x", "y", 1, "z") for i, v in rows], schema).repartition(3)


def brute(rows, k, dims, rounds, scale=64):
    """Every vector against every centroid, in Python's own whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and None not in v and np.isfinite(v).all()]
    most = C.largest_component(dims)
    kept = [(i, [int(max(-most, min(most, np.floor(np.float64(np.float32(x)) * scale)))) for x in v]) for i, v in kept]
    hashed = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in hashed[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign()):
            members[j].append(v)
        for j, vs in members.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted((repr(i), j, d) for (i, _), (d, j) in zip(kept, assign())), centroids


def made(seed, n, dims, spread, centers=5):
    draw = random.Random(seed)
    middles = [[draw.uniform(-1, 1) for _ in range(dims)] for _ in range(centers)]
    return [(i, [m + draw.gauss(0, spread) for m in draw.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("seed,spread,k,rounds", [(1, 0.05, 6, 3), (2, 0.6, 9, 6), (3, 0.02, 16, 4)])
def test_equals_measuring_everything(spark, seed, spread, k, rounds):
    rows = made(seed, 250, 8, spread)
    rows += [(3, [0.0] * 8)] * 4 + [(900, [0.5] * 8)] * 30 + [(None, [0.25] * 8)]
    rows += [(901, None), (902, []), (903, [0.1] * 7), (904, [0.1] * 9)]
    rows += [(905, [0.1] * 7 + [None]), (906, [0.1] * 7 + [float("nan")]), (907, [float("inf")] + [0.1] * 7)]
    placed, centroids = C.cluster_vectors(table(spark, rows), clusters=k, rounds=rounds, dimensions=8)
    want, middle = brute(rows, k, 8, rounds)
    assert sorted((repr(r.vec_id), r.cluster, r.distance) for r in placed.collect()) == want
    assert centroids == middle


def test_ties_and_huge_components(spark):
    most = C.largest_component(2)
    assert 2 * (2 * most) ** 2 < 2**63 and C.largest_component(64) == 2**27
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(-3, 4) for y in range(-3, 4))]
    rows += [(100 + i, [3e38 * (-1) ** i, 1e30]) for i in range(4)]
    placed, centroids = C.cluster_vectors(table(spark, rows), clusters=7, rounds=3, dimensions=2, scale=1)
    want, middle = brute(rows, 7, 2, 3, scale=1)
    assert sorted((repr(r.vec_id), r.cluster, r.distance) for r in placed.collect()) == want and centroids == middle


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.51] * 64)]
    placed, centroids = C.cluster_vectors(table(spark, rows))
    told = C.cluster_report(spark, placed, centroids).orderBy("vec_id").collect()
    assert len(centroids) == 3 and [r.distance for r in told] == [0, 0, 0]
    # Equal first centroids: the smaller number takes all.
    assert told[0].cluster == told[1].cluster != told[2].cluster
    assert told[2].centroid_sha256 == hashlib.sha256(",".join(["-33"] * 64).encode()).hexdigest()
    placed, centroids = C.cluster_vectors(table(spark, [(1, None)]))
    report = C.cluster_report(spark, placed, centroids)
    assert centroids == [] and report.count() == 0 and "inertia" in report.columns


def test_bounds_spare_most_distances():
    """Total displacement: a centroid that comes back rules out as much as one that never moved."""
    draw = np.random.default_rng(4)
    middles = draw.integers(-400, 400, (8, 16))
    v = (middles[draw.integers(0, 8, 2000)] + draw.integers(-9, 10, (2000, 16))).astype(np.int64)
    there = middles + draw.integers(-150, 150, middles.shape)
    history = [middles, there, middles]
    known = C.Nearest(np.array(history[:1])).assign(v, C.Bounds.unknown(2000, 8))
    assert (known.far_at == 0).all()
    for t in (2, 3):
        now = C.Nearest(np.array(history[:t], np.int64))
        known = now.assign(v, known)
        exact = ((v[:, None] - history[t - 1]) ** 2).sum(2)
        assert (known.cluster == exact.argmin(1)).all()
    # Bounds of the first round hold again in the third, so hardly anything is measured there.
    assert (known.far_at == 2).mean() < 0.2

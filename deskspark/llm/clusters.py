"""Centroid clustering whose distance bounds are loosened by total displacement.

Every vector keeps, for each centroid, the distance it last computed and the
round it did so in. All earlier centroids are kept too. A stored distance minus
the distance the centroid has moved in all since that round is a lower bound
now; moves that go back and forth cancel, where the sum of each round's moves
would not. Only centroids whose bound does not rule them out are measured again,
in whole numbers, so the result is that of measuring all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.llm.arrow_text import batch_of, map_batches
from deskspark.llm.stored import discard, stored, stored_with_path

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
SEED = 1
#: Pairs of vector and centroid measured at once.
PAIRS_AT_ONCE = 1 << 14
#: Share by which bounds must differ beyond rounding: stored bounds are single floats.
SLACK = 1e-6


def largest_component(dimensions: int) -> int:
    """Components beyond this would let a squared distance pass a long."""
    return 1 << ((62 - max(dimensions - 1, 1).bit_length()) // 2 - 1)


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str, dimensions: int, scale: float) -> DataFrame:
    """``vec_id, v`` of the vectors that are kept, as whole numbers."""
    x = F.col(embedding).cast("array<double>")
    usable = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = float(largest_component(dimensions))

    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c * float(scale)))).cast("int")

    kept = vectors.where((F.size(x) == dimensions) & F.coalesce(usable, F.lit(False)))
    return kept.select(F.col(vec_id).alias("vec_id"), F.transform(x, whole).alias("v"))


def first_centroids(whole: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id, at most ``clusters`` of them."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    few = whole.select(F.sha2(told.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(clusters)
    return [list(r["v"]) for r in few.collect()]


@dataclass
class Bounds:
    """What is known of a batch of vectors after some round, row by row.

    ``cluster`` and its squared distance ``own`` in round ``own_at``; for every
    centroid the distance ``far`` measured in round ``far_at``.
    """

    cluster: np.ndarray
    own: np.ndarray
    own_at: np.ndarray
    far: np.ndarray
    far_at: np.ndarray

    @classmethod
    def unknown(cls, rows: int, clusters: int) -> Bounds:
        """Nothing measured: a bound of zero rules out no centroid."""
        return cls(
            np.zeros(rows, np.int32),
            np.zeros(rows, np.int64),
            np.full(rows, -1, np.int32),
            np.zeros((rows, clusters), np.float32),
            np.zeros((rows, clusters), np.int8),
        )


def squared(v: np.ndarray, centroids: np.ndarray, rows: np.ndarray, js: np.ndarray) -> np.ndarray:
    """Exact squared distances of the pairs ``rows, js``."""
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), PAIRS_AT_ONCE):
        upto = slice(at, at + PAIRS_AT_ONCE)
        apart = v[rows[upto]] - centroids[js[upto]]
        out[upto] = np.einsum("ij,ij->i", apart, apart)
    return out


class Nearest:
    """Assigns vectors to the newest of a history of centroids (rounds, centroids, components)."""

    def __init__(self, history: np.ndarray) -> None:
        self.now = len(history) - 1
        self.centroids = history[-1]
        apart = (history - history[-1]).astype(np.float64)
        #: How far each centroid has moved in all since each round.
        self.moved = np.sqrt((apart * apart).sum(2))

    def assign(self, v: np.ndarray, known: Bounds, measure_own: bool = False) -> Bounds:
        """Bounds after this round; ``measure_own`` makes all distances of own clusters exact."""
        n, k = known.far.shape
        every = np.arange(n)
        a = known.cluster
        low = known.far.astype(np.float64)
        low -= self.moved[known.far_at, np.arange(k)] + SLACK * low
        low[every, a] = np.inf
        nearest_other = low.min(1)
        # One bound from above for the own centroid, then the exact distance where that is not enough.
        new = known.own_at < 0
        high = np.sqrt(known.own.astype(np.float64)) + self.moved[np.maximum(known.own_at, 0), a]
        open_ = new | (nearest_other <= high * (1 + SLACK)) | measure_own
        rows = np.flatnonzero(open_)
        own, own_at = known.own.copy(), known.own_at.copy()
        own[rows] = squared(v, self.centroids, rows, a[rows])
        own_at[rows] = self.now
        # Centroids that are still not ruled out are measured, ties included.
        sure = np.sqrt(own[rows].astype(np.float64)) * (1 + SLACK)
        at, js = np.nonzero(low[rows] <= sure[:, None])
        pairs = rows[at]
        found = squared(v, self.centroids, pairs, js)
        far, far_at = known.far.copy(), known.far_at.copy()
        far[rows, a[rows]] = np.sqrt(own[rows].astype(np.float64))
        far_at[rows, a[rows]] = self.now
        far[pairs, js] = np.sqrt(found.astype(np.float64))
        far_at[pairs, js] = self.now
        # Smallest distance, then smallest number, among the own and the measured ones.
        all_rows = np.concatenate([rows, pairs])
        all_js = np.concatenate([a[rows], js]).astype(np.int32)
        all_d = np.concatenate([own[rows], found])
        order = np.lexsort((all_js, all_d, all_rows))
        first = order[np.r_[True, np.diff(all_rows[order]) > 0]] if len(order) else order
        cluster = a.copy()
        cluster[all_rows[first]] = all_js[first]
        own[all_rows[first]] = all_d[first]
        return Bounds(cluster, own, own_at, far, far_at)


_STATE = (
    "v array<int>, cluster int, before int, own long, own_at int, far array<float>, far_at array<tinyint>"
)


def _table(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(len(column), width)


def _lists(table: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = table.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(table.ravel(), kind))


def _assigned(state: DataFrame, history: Sequence, first: bool) -> DataFrame:
    """The state after one more round, row by row."""
    rounds = np.array(history, np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(rounds)
        k, dims = rounds.shape[1:]
        for batch in batches:
            if not len(batch):
                continue
            v = _table(batch.column(1), dims, np.int64)
            if first:
                known, before = Bounds.unknown(len(v), k), np.full(len(v), -1, np.int32)
            else:
                c = dict(zip(batch.schema.names, batch.columns))
                plain = [np.asarray(c[name]) for name in ("cluster", "own", "own_at")]
                known = Bounds(*plain, _table(c["far"], k, np.float32), _table(c["far_at"], k, np.int8))
                before = known.cluster
            now = nearest.assign(v, known)
            columns = [batch.column(0), batch.column(1), now.cluster, before, now.own, now.own_at]
            columns += [_lists(now.far, pa.float32()), _lists(now.far_at, pa.int8())]
            types = [batch.column(0).type, batch.column(1).type, pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            yield batch_of(["vec_id", *_NAMES], columns, [*types, pa.list_(pa.float32()), pa.list_(pa.int8())])

    return map_batches(state, task, f"vec_id {state.schema['vec_id'].dataType.simpleString()}, {_STATE}")


_NAMES = ["v", "cluster", "before", "own", "own_at", "far", "far_at"]


def _finished(state: DataFrame, history: Sequence) -> DataFrame:
    """``vec_id, cluster, distance`` by the newest centroids."""
    rounds = np.array(history, np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(rounds)
        k, dims = rounds.shape[1:]
        for batch in batches:
            if not len(batch):
                continue
            c = dict(zip(batch.schema.names, batch.columns))
            plain = [np.asarray(c[name]) for name in ("cluster", "own", "own_at")]
            known = Bounds(*plain, _table(c["far"], k, np.float32), _table(c["far_at"], k, np.int8))
            now = nearest.assign(_table(c["v"], dims, np.int64), known, measure_own=True)
            types = [batch.column(0).type, pa.int32(), pa.int64()]
            yield batch_of(["vec_id", "cluster", "distance"], [batch.column(0), now.cluster, now.own], types)

    return map_batches(state, task, f"vec_id {state.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def _changes(state: DataFrame, k: int, dims: int) -> list:
    """What vectors that changed their cluster add to the sums: ``cluster, place, total`` (place -1: their number).

    Each task adds up its own rows first, so its rows number ``2 * k`` at most.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            v = _table(batch.column(2), dims, np.int64)
            for column, sign in ((0, 1), (1, -1)):
                js = np.asarray(batch.column(column))
                np.add.at(sums, js[js >= 0], sign * v[js >= 0])
                np.add.at(counts, js[js >= 0], sign)
        js = np.flatnonzero(counts.astype(bool) | sums.any(1))
        told = np.column_stack([counts, sums])[js]
        types = [pa.int32(), pa.list_(pa.int64())]
        yield batch_of(["cluster", "sums"], [js.astype(np.int32), _lists(told, pa.int64())], types)

    moved = state.where("cluster <> before").select("cluster", "before", "v")
    parts = map_batches(moved, task, "cluster int, sums array<long>")
    each = parts.select("cluster", F.posexplode("sums").alias("place", "part"))
    return each.groupBy("cluster", "place").agg(F.sum("part").alias("total")).collect()


def cluster_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: float = SCALE,
    seed: int = SEED,
) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every vector kept, and the centroids.

    Kept are vectors of ``dimensions`` components, none null or non-finite; each
    component becomes ``floor(scale * x)``. Null, shorter and longer vectors are
    left out. A null id is hashed as an empty one; ties of the first centroids'
    hashes go by the vector, ties of distance to the smaller number. Repeated
    rows are vectors of their own. With fewer vectors than ``clusters`` there
    are as many centroids as vectors; an empty table gives an empty result.
    Other columns are ignored. Components beyond ``largest_component``, 2^27 for
    64 of them, count as that, so that squared distances fit a long.

    Each round is one map over the rows of the round before, in the shared
    folder, without a shuffle; rows hold their vector and ``5 * clusters`` bytes
    of bounds. Only centroids and the sums of rows that changed, ``clusters *
    dimensions`` numbers, reach the driver. A round's rows go when the next are
    written.
    """
    spark = vectors.sparkSession
    state = whole_numbers(vectors, vec_id, embedding, dimensions, scale)
    start = first_centroids(state, clusters, seed)
    kind = state.schema["vec_id"].dataType.simpleString()
    if not start:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), []
    history = [start]
    sums = [[0] * (dimensions + 1) for _ in start]
    old = None
    for t in range(rounds):
        state, path = stored_with_path(_assigned(state, history, first=t == 0), "vectors")
        if old:
            discard(spark, old)
        old = path
        for row in _changes(state, len(start), dimensions):
            sums[row["cluster"]][row["place"]] += row["total"]
        history.append([[x // s[0] for x in s[1:]] if s[0] else c for s, c in zip(sums, history[-1])])
    if not rounds:
        state = _assigned(state, history, first=True)
    done = stored(_finished(state, history), "clusters")
    if old:
        discard(spark, old)
    return done, history[-1]


def cluster_report(spark: SparkSession, placed: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The digest columns of the query: inertia by cluster and in all, and each centroid's hash.

    Sums beyond a long are null. One row per cluster reaches the driver and is
    broadcast.
    """
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    of_cluster = {r["cluster"]: int(r["total"]) for r in placed.groupBy("cluster").agg(total).collect()}
    inertia = _as_long(sum(of_cluster.values()))
    rows = [
        (j, _as_long(of_cluster[j]), inertia, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for j, c in enumerate(centroids)
        if j in of_cluster
    ]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", *told.columns[1:])


def _as_long(x: int) -> int | None:
    return x if x < 1 << 63 else None

"""Quality classifier: random-indexing word vectors, pooled per text, and a small calibrated network.

Every token has a fixed sparse random vector by its hash. A token's word vector
is the sum of the random vectors of its neighbours over the whole corpus. Texts
are pooled to the mean and spread of their word vectors, and a two-layer
network, trained here, turns that into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm.arrow_text import batch_of, map_batches, text_bytes
from deskspark.llm.samples import labelled_sample

#: Tokens share this many vectors by hash: the table does not grow with the corpus.
BUCKETS = 1 << 14
DIMENSIONS = 32
NONZERO = 4
REACH = 2
HIDDEN = 32
#: Labelled rows the network is trained on, at most.
SAMPLE_ROWS = 20_000
EPOCHS = 60
PREDICT_AT = 0.3
SEED = 11
#: Bytes of text worked on at once; longer texts are cut at a space where there is one.
BLOCK_BYTES = 1 << 20

_SPACE, _WORD, _SIGN = 0, 1, 2
_kinds = np.full(256, _SIGN, np.uint8)
_kinds[:33] = _SPACE
_kinds[127] = _SPACE
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _kinds[_low:_high] = _WORD
KINDS = _kinds

_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, up to a block's length."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.ones(BLOCK_BYTES + 1, np.uint64)
            table[1:] = np.uint64(base)
            _powers.append(np.multiply.accumulate(table))
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def blocks(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """``first, last, low, high``: texts (last exclusive) and bytes of each block of work."""
    row, n = 0, len(starts) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(starts, starts[row] + BLOCK_BYTES, "right")) - 1)
        low, high = int(starts[row]), int(starts[last])
        while high - low > BLOCK_BYTES:
            spaces = np.flatnonzero(KINDS[data[low + 1 : low + BLOCK_BYTES]] == _SPACE)
            cut = low + 1 + int(spaces[-1]) if len(spaces) else low + BLOCK_BYTES
            yield row, row + 1, low, cut
            low = cut
        yield row, last, low, high
        row = last


def tokens(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token in a block, and the text it is in; ``edges`` are the starts of the texts.

    Tokens are runs of word bytes or of signs, as they are written.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = KINDS[data]
    begins = np.ones(len(data), bool)
    begins[1:] = kinds[1:] != kinds[:-1]
    begins[edges[(edges >= 0) & (edges < len(data))]] = True
    bounds = np.append(np.flatnonzero(begins), len(data))
    powers, inverse = _power_tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    low, high = bounds[:-1], bounds[1:]
    real = kinds[low] != _SPACE
    low, high = low[real], high[real]
    hashes = _mixed((sums[high] - sums[low]) * inverse[low])
    bits = np.uint64(64 - (BUCKETS.bit_length() - 1))
    return (hashes >> bits).astype(np.int64), np.searchsorted(edges, low, "right") - 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of the nonzero places of each bucket's random vector."""
    seeds = np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(SEED << 32)
    drawn = _mixed(_mixed(seeds * np.uint64(_BASE))).reshape(BUCKETS, NONZERO)
    return (drawn >> np.uint64(40)).astype(np.int64) % DIMENSIONS, 1.0 - 2.0 * (drawn & np.uint64(1)).astype(float)


def context_sums(ids: np.ndarray, texts: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """For each bucket the sum of its neighbours' random vectors, flat."""
    out = np.zeros(BUCKETS * DIMENSIONS)
    for reach in range(1, REACH + 1):
        same = texts[reach:] == texts[:-reach]
        left, right = ids[:-reach][same], ids[reach:][same]
        for me, other in ((left, right), (right, left)):
            for k in range(NONZERO):
                cells = me * DIMENSIONS + places[other, k]
                out += np.bincount(cells, signs[other, k], minlength=len(out))
    return out


def learn_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Word vectors of all buckets, from all documents: centred, of length one, 0 where nothing occurs.

    A task adds up its own table and sends the buckets it has seen, so the
    shuffle holds at most ``BUCKETS`` rows per task, as does the result on the
    driver.
    """
    names = ["bucket", *[f"d{i}" for i in range(DIMENSIONS)]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            data, starts = text_bytes(batch.column(0))
            for first, last, low, high in blocks(data, starts):
                total += context_sums(*tokens(data[low:high], starts[first:last] - low), places, signs)
        table = total.reshape(BUCKETS, DIMENSIONS).astype(np.int64)
        seen = np.flatnonzero(table.any(axis=1))
        columns = [seen, *[table[seen, i] for i in range(DIMENSIONS)]]
        yield batch_of(names, columns, [pa.int32(), *[pa.int64()] * DIMENSIONS])

    rows = docs.select(F.col(text).cast("string").alias("t"))
    parts = map_batches(rows, task, "bucket int, " + ", ".join(f"{n} long" for n in names[1:]))
    sums = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names[1:]])
    vectors = np.zeros((BUCKETS, DIMENSIONS))
    for row in sums.collect():
        vectors[row[0]] = row[1:]
    seen = vectors.any(axis=1)
    vectors[seen] /= np.linalg.norm(vectors[seen], axis=1, keepdims=True)
    if seen.any():
        vectors[seen] -= vectors[seen].mean(axis=0)
        vectors[seen] /= np.maximum(np.linalg.norm(vectors[seen], axis=1, keepdims=True), 1e-9)
    return vectors.astype(np.float32)


def pooled(data: np.ndarray, starts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean and spread of its word vectors, length of the mean, log of its tokens."""
    n = len(starts) - 1
    sums, squares, counts = np.zeros((n, DIMENSIONS)), np.zeros((n, DIMENSIONS)), np.zeros(n)
    for first, last, low, high in blocks(data, starts):
        ids, texts = tokens(data[low:high], starts[first:last] - low)
        if not len(ids):
            continue
        at = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
        rows, found = first + texts[at], vectors[ids]
        sums[rows] += np.add.reduceat(found, at, axis=0)
        squares[rows] += np.add.reduceat(found * found, at, axis=0)
        counts[rows] += np.diff(np.append(at, len(ids)))
    some = np.maximum(counts, 1)[:, None]
    mean = sums / some
    spread = np.sqrt(np.maximum(squares / some - mean * mean, 0))
    return np.column_stack([mean, spread, np.linalg.norm(mean, axis=1), np.log1p(counts)])


@dataclass
class Network:
    """Two layers over standardised inputs; the last output is divided by ``temperature``."""

    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.maximum((x - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2)[:, 0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> "Network":
        """Adam on four fifths of the rows; the temperature on the rest."""
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        centre, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
        layers = [
            rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, 1)),
            np.zeros(1),
        ]
        net = cls(centre, scale, layers)
        first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
        step = 0
        for _ in range(epochs):
            rng.shuffle(used)
            for low in range(0, len(used), 256):
                part = used[low : low + 256]
                z = (x[part] - centre) / scale
                h = np.maximum(z @ layers[0] + layers[1], 0)
                p = 1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -30, 30)))
                out = (p - y[part, None]) / len(part)
                back = (out @ layers[2].T) * (h > 0)
                slopes = [z.T @ back, back.sum(axis=0), h.T @ out, out.sum(axis=0)]
                step += 1
                for w, g, m, v in zip(layers, slopes, first, second):
                    g = g + 1e-4 * w
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 2e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        net.temperature = best_temperature(net.logits(x[held]), y[held])
        return net


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    low, high, gold = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - gold * (high - low), low + gold * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    rows: int = SAMPLE_ROWS,
) -> tuple[np.ndarray, Network | None]:
    """Word vectors from all documents, and a network from a bounded sample of labelled rows.

    The sample's pooled inputs, ``rows`` at most, are what reaches the driver.
    Without labels of both kinds there is no network.
    """
    vectors = learn_vectors(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = labelled_sample(docs, labels, label, rows, doc_id, text)
    kind = sample.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(*text_bytes(batch.column(1)), shared.value)
            columns = [batch.column(0), batch.column(2), list(x)]
            yield batch_of(["doc_id", "label", "x"], columns, [batch.column(0).type, pa.int32(), pa.list_(pa.float64())])

    found = map_batches(sample, task, f"doc_id {kind}, label int, x array<double>").orderBy("doc_id", "label").collect()
    y = np.array([r["label"] for r in found], float)
    if not len(y) or y.min() == y.max():
        return vectors, None
    return vectors, Network.fit(np.array([r["x"] for r in found]), y)


def score_quality(
    docs: DataFrame, vectors: np.ndarray, network: Network | None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, score`` for every row, from its whole text alone.

    Null and empty texts are pooled to zeros and scored like any other; without
    a network every score is 0.5. Repeated rows each count, other columns are
    ignored, an empty table gives an empty one.
    """
    # Plain values: workers need not know this module to read them.
    told = network and (network.centre, network.scale, network.layers, network.temperature)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, told))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = shared.value[0], shared.value[1] and Network(*shared.value[1])
        for batch in batches:
            x = pooled(*text_bytes(batch.column(1)), table)
            scores = np.full(len(x), 0.5) if net is None else net.predict(x)
            yield batch_of(["doc_id", "score"], [batch.column(0), scores], [batch.column(0).type, pa.float64()])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    return map_batches(rows, task, f"doc_id {kind}, score double")

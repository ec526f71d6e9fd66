"""Exact removal of repeated passages by suffix arrays over shared stretches.

Sorting all suffixes of a corpus would move every byte many times. Here a
passage meets its copies by a rolling minimum instead: of the gram hashes in a
50-byte stretch the smallest is the same in every copy, so stretches in a row
with the same minimum form a run, and the run is sent to that minimum's bucket.
Runs whose minimum occurs in one document only cannot repeat and stay at home.
Each bucket builds a suffix array of its distinct runs.

Texts are packed into a stored table of compressed chunks first. What is
learned about a run is addressed by chunk and place, and goes back to the chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm.arrow_text import batch_of, map_batches, pieces, text_bytes
from deskspark.llm.repeats import find_repeats, stretch_hashes
from deskspark.llm.stored import stored

REPEAT_BYTES = 50
GRAM_BYTES = 24
CHUNK_BYTES = 4 << 20
#: Bytes of text per bucket; the buckets grow in number with the corpus.
BUCKET_BYTES = 8 << 20
#: A run of more stretches is cut, to bound the suffixes of one string.
RUN_STRETCHES = 256
#: A minimum in more chunks than this spreads over buckets by whole stretches.
HOT_CHUNKS = 1_000
#: Bytes hashed at once, small enough to stay in a core's cache.
BLOCK_BYTES = 1 << 17
NO_ID = (1 << 63) - 1
SHARED, HOT = 1, 2


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data) -> bytes:
    data = bytes(data)
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _cut(keys: np.ndarray) -> bytes:
    """The upper 48 bits; the bucket tells some of the rest, and keys that only seem equal do no harm."""
    return (keys >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _uncut(body: bytes) -> np.ndarray:
    octets = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return np.pad(octets, ((0, 0), (0, 2))).reshape(-1).view(np.uint64)


def pack_chunks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``chunk, doc_ids, starts, body``: texts of about ``CHUNK_BYTES`` in one compressed row."""
    names = ["chunk", "doc_ids", "starts", "body"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            for first, last in pieces(starts, CHUNK_BYTES):
                low = starts[first]
                body = _packed(data[low : starts[last]].tobytes())
                row = [uuid.uuid4().int >> 65], [ids[first:last]], [starts[first : last + 1] - low], [body]
                yield batch_of(names, row, kinds)

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    return map_batches(rows, task, "chunk long, doc_ids array<long>, starts array<long>, body binary")


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    size, total = 1, len(x) - width + 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:total], x[width - size : width - size + total])


def runs_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum, first stretch and number of stretches of each run; stretches lie within one text."""
    total = len(data) - REPEAT_BYTES + 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low in range(0, max(total, 0), BLOCK_BYTES):
        high = min(total, low + BLOCK_BYTES)
        part = data[low : high + REPEAT_BYTES - 1]
        least = _least_of(stretch_hashes(part, GRAM_BYTES), REPEAT_BYTES - GRAM_BYTES + 1)
        valid = np.ones(high - low, bool)
        first, last = np.searchsorted(starts, [low, high + REPEAT_BYTES])
        for edge in (starts[first:last] - low).tolist():
            valid[max(0, edge - REPEAT_BYTES + 1) : max(0, edge)] = False
        change = np.ones(high - low, bool)
        change[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        at = np.flatnonzero(change)
        length = np.diff(np.append(at, high - low))
        keep = valid[at]
        out.append((least[at[keep]], at[keep] + low, length[keep]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, at, length = (np.concatenate(x) for x in zip(*out))
    cuts = -(-length // RUN_STRETCHES)
    if (cuts > 1).any():
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        least, at, length = np.repeat(least, cuts), np.repeat(at, cuts), np.repeat(length, cuts)
        at = at + nth * RUN_STRETCHES
        length = np.minimum(RUN_STRETCHES, length - nth * RUN_STRETCHES)
    return least, at, length


class Chunk:
    """One packed row with its runs, in the order that answers refer to."""

    def __init__(self, row: dict, buckets: int) -> None:
        self.id, self.buckets = row["chunk"], buckets
        self.ids = np.array(row["doc_ids"], np.int64)
        self.starts = np.array(row["starts"], np.int64)
        self.raw = _unpacked(row["body"])
        self.data = np.frombuffer(self.raw, np.uint8)
        self.least, self.at, self.length = runs_of(self.data, self.starts)
        self.text = np.searchsorted(self.starts, self.at, "right") - 1

    def keys(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per bucket the distinct minima in order, and whether two documents here have them.

        Notes for each run which of them, in that order, is its own.
        """
        order = np.argsort(self.least, kind="stable")
        sorted_, owner = self.least[order], self.ids[self.text[order]]
        if not len(sorted_):
            return
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        keys = sorted_[first]
        several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[by] = np.arange(len(keys))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.repeat(place, np.diff(np.append(first, len(order))))
        edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) > 0, [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(bucket[by[a]]), keys[by[a:b]], several[by[a:b]]

    def shared_strings(self, flags: dict[int, bytes]) -> dict[int, "Strings"]:
        """Per bucket the distinct strings of runs whose minimum is shared, and where each lies."""
        told = [
            np.frombuffer(flags[b], np.uint8) if b in flags else np.zeros(len(k), np.uint8) for b, k, _ in self.keys()
        ]
        if not told:
            return {}
        marks = np.concatenate(told)[self.place]
        out: dict[int, Strings] = {}
        width, raw = REPEAT_BYTES - 1, self.raw
        plain = np.flatnonzero(marks == SHARED)
        bucket = (self.least[plain] % np.uint64(self.buckets)).tolist()
        owner = self.ids[self.text[plain]].tolist()
        for b, at, n, d in zip(bucket, self.at[plain].tolist(), self.length[plain].tolist(), owner):
            if b not in out:
                out[b] = Strings()
            out[b].add(raw[at : at + n + width], at, d)
        for i in np.flatnonzero(marks == HOT).tolist():
            first, n, d = int(self.at[i]), int(self.length[i]), int(self.ids[self.text[i]])
            spread = stretch_hashes(self.data[first : first + n + width], REPEAT_BYTES) % np.uint64(self.buckets)
            for k, b in enumerate(spread.tolist()):
                if b not in out:
                    out[b] = Strings()
                out[b].add(raw[first + k : first + k + REPEAT_BYTES], first + k, d)
        return out


class Strings:
    """Distinct strings, the smallest document of each, and all places."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.least: list[int] = []
        self.places: list[tuple[int, int, int]] = []

    def add(self, string: bytes, at: int, doc: int) -> None:
        i = self.number.setdefault(string, len(self.number))
        if i == len(self.least):
            self.least.append(doc)
        elif doc < self.least[i]:
            self.least[i] = doc
        self.places.append((i, at, doc))


def _flag(table: pa.Table) -> pa.Table:
    """Which minima of a bucket two documents share; one row per chunk that has any."""
    parts = [_uncut(k.as_py()) for k in table.column("keys")]
    several = [np.frombuffer(s.as_py(), np.uint8) for s in table.column("several")]
    keys, sizes = np.concatenate(parts), [len(p) for p in parts]
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    count = np.diff(np.append(first, len(keys)))
    chunks = np.empty(len(keys), np.int64)
    chunks[order] = np.repeat(count, count)
    flags = np.where(chunks > HOT_CHUNKS, HOT, np.where((chunks > 1) | (np.concatenate(several) > 0), SHARED, 0))
    cut = np.split(flags.astype(np.uint8), np.cumsum(sizes)[:-1])
    any_ = [i for i, f in enumerate(cut) if f.any()]
    ids = table.column("chunk").to_pylist()
    return pa.table(
        {
            "chunk": pa.array([ids[i] for i in any_], pa.int64()),
            "bucket": pa.array([table.column("bucket")[0].as_py()] * len(any_), pa.int32()),
            "flags": pa.array([_packed(cut[i].tobytes()) for i in any_], pa.binary()),
        }
    )


def _answer(table: pa.Table) -> pa.Table:
    """For each chunk's strings: the smallest document that has all of it, and the spans smaller ones have."""
    number: dict[bytes, int] = {}
    least: list[int] = []
    mine: list[list[int]] = []
    for body, lengths, docs in zip(table.column("body"), table.column("lengths"), table.column("least")):
        raw, at, ids = _unpacked(body.as_py()), 0, []
        for n, d in zip(np.frombuffer(lengths.as_py(), np.uint16).tolist(), np.frombuffer(docs.as_py(), np.int64).tolist()):
            i = number.setdefault(raw[at : at + n], len(number))
            at += n
            if i == len(least):
                least.append(d)
            elif d < least[i]:
                least[i] = d
            ids.append(i)
        mine.append(ids)
    found = find_repeats(list(number), least, REPEAT_BYTES)
    spans: dict[int, list[tuple[int, int]]] = {}
    for s, o, r in zip(found.string.tolist(), found.offset.tolist(), found.reach.tolist()):
        if r:
            spans.setdefault(s, []).append((o, o + r))
    bodies = []
    for ids in mine:
        some = [(k, a, b) for k, i in enumerate(ids) for a, b in spans.get(i, ())]
        told = np.array([least[i] for i in ids], np.int64).tobytes() + np.array(some, np.int32).tobytes()
        bodies.append(len(ids).to_bytes(8, "little") + _packed(told))
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "bucket": table.column("bucket"),
            "told": pa.array(bodies, pa.binary()),
        }
    )


def _by_bucket(rows, field: str) -> dict[int, bytes]:
    return {} if rows is None else {r["bucket"]: bytes(r[field]) for r in rows}


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` for every row: removed byte spans, and the remaining bytes.

    A byte goes if a stretch of ``REPEAT_BYTES`` over it also starts in a
    document with a smaller id; stretches are judged on the input. Null and
    empty texts have no bytes. Ids are long integers; a null id counts as larger
    than all others, and rows of equal id never remove from each other. Other
    columns are ignored, an empty table gives an empty one.

    Three passes over the packed texts. What moves: six bytes or so per run for
    the minima, strings of shared runs, distinct per chunk, and the packed texts
    to meet the answers. A passage in very many documents is one string per
    chunk; a short passage with ever different surroundings spreads over buckets.
    """
    chunks = stored(pack_chunks(docs, doc_id, text), "text-chunks")
    size = chunks.agg(F.sum(F.get("starts", F.size("starts") - 1))).first()[0] or 0
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(width, -(-size // BUCKET_BYTES))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch.slice(i, 1).to_pylist()[0], buckets)
                found = list(chunk.keys())
                columns = [
                    [b for b, _, _ in found],
                    [chunk.id] * len(found),
                    [_cut(k) for _, k, _ in found],
                    [s.astype(np.uint8).tobytes() for _, _, s in found],
                ]
                yield batch_of(["bucket", "chunk", "keys", "several"], columns, [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    minima = map_batches(chunks, keys, "bucket int, chunk long, keys binary, several binary")
    flags = stored(
        minima.groupBy("bucket").applyInArrow(_flag, "chunk long, bucket int, flags binary"), "shared-minima"
    )
    of_chunk = flags.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "flags")).alias("flags"))
    marked = chunks.join(of_chunk, "chunk", "left")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "chunk", "body", "lengths", "least"]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if not row["flags"]:
                    continue
                chunk = Chunk(row, buckets)
                found = chunk.shared_strings({b: _unpacked(f) for b, f in _by_bucket(row["flags"], "flags").items()})
                columns = [
                    list(found),
                    [chunk.id] * len(found),
                    [_packed(b"".join(s.number)) for s in found.values()],
                    [np.array([len(x) for x in s.number], np.uint16).tobytes() for s in found.values()],
                    [np.array(s.least, np.int64).tobytes() for s in found.values()],
                ]
                yield batch_of(names, columns, kinds)

    shared = map_batches(marked, strings, "bucket int, chunk long, body binary, lengths binary, least binary")
    answers = stored(
        shared.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, told binary"), "repeat-answers"
    )
    told = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "told")).alias("told"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "n_bytes", "removed", "kept"], [pa.int64(), pa.int64(), pa.list_(span), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk(row, buckets)
                gone = _gone(chunk, row)
                ids = [None if d == NO_ID else d for d in chunk.ids.tolist()]
                n, removed, kept = [], [], []
                for a, b in zip(chunk.starts[:-1].tolist(), chunk.starts[1:].tolist()):
                    mask = gone[a:b]
                    step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
                    spans = zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())
                    n.append(b - a)
                    removed.append([{"start": x, "end": y} for x, y in spans])
                    kept.append(chunk.data[a:b][~mask].tobytes() if removed[-1] else chunk.raw[a:b])
                yield batch_of(names, [ids, n, removed, kept], kinds)

    ready = marked.join(told, "chunk", "left")
    return map_batches(ready, apply, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def _gone(chunk: Chunk, row: dict) -> np.ndarray:
    """Which bytes of a chunk go, from the answers to its strings."""
    steps = np.zeros(len(chunk.data) + 1, np.int32)
    if row["told"]:
        found = chunk.shared_strings({b: _unpacked(f) for b, f in _by_bucket(row["flags"], "flags").items()})
        for bucket, body in _by_bucket(row["told"], "told").items():
            strings = found[bucket]
            n, data = int.from_bytes(body[:8], "little"), _unpacked(body[8:])
            least = np.frombuffer(data[: 8 * n], np.int64)
            some = np.frombuffer(data[8 * n :], np.int32).reshape(-1, 3)
            lengths = np.array([len(x) for x in strings.number], np.int64)
            which, at, doc = (np.array(x, np.int64) for x in zip(*strings.places))
            whole = doc > least[which]
            np.add.at(steps, at[whole], 1)
            np.add.at(steps, at[whole] + lengths[which[whole]], -1)
            if len(some):
                order = np.argsort(some[:, 0], kind="stable")
                some = some[order]
                low, high = np.searchsorted(some[:, 0], which, "left"), np.searchsorted(some[:, 0], which, "right")
                n_spans = np.where(whole, 0, high - low)
                rep = np.repeat(np.arange(len(which)), n_spans)
                nth = np.arange(len(rep)) - np.repeat(np.cumsum(n_spans) - n_spans, n_spans)
                picked = some[low[rep] + nth]
                np.add.at(steps, at[rep] + picked[:, 1], 1)
                np.add.at(steps, at[rep] + picked[:, 2], -1)
    return np.cumsum(steps[:-1]) > 0


def removal_report(found: DataFrame) -> DataFrame:
    """The digest columns of the query, derived from the spans and the kept bytes."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

"""Benchmark decontamination by Wu-Manber search for windows of benchmark words.

Texts are reduced to lower-case words with one space around each. A window of
an item is then one byte string, and all windows are searched together: a table
of block shifts moves past positions where no window can end, the hash of the
last block picks the windows to test, and bytes are compared to confirm.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm.arrow_text import (
    batch_of,
    id_and_text,
    map_batches,
    schema_with_rows,
    text_bytes,
    with_rows,
)
from deskspark.llm.stored import stored
from deskspark.session import run_folder

WINDOW_WORDS = 10
#: Bytes of windows in one search; more items make more searches of the same batch.
SEARCH_BYTES = 8 << 20
LANES = 4096
SHIFT_BITS = 18
#: Windows at least this long are searched by blocks of so many bytes.
BLOCKS = ((24, 8, np.dtype("<u8")), (8, 4, np.dtype("<u4")), (0, 2, np.dtype("<u2")))
_MIX = np.uint64(0x9E3779B97F4A7C15)

_separators = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_table = bytearray(range(256))
for _b in _separators:
    _table[_b] = 0x20
for _b in range(0x41, 0x5B):
    _table[_b] = _b + 0x20
TABLE = bytes(_table)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def windows_of(words: Sequence[bytes], size: int = WINDOW_WORDS) -> list[bytes]:
    """All runs of ``size`` words; fewer words, but not none, are one window."""
    if not words:
        return []
    last = max(0, len(words) - size)
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(last + 1)]


def _blocks(data: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Every byte position read as a block of its own."""
    n = len(data) - kind.itemsize + 1
    return np.ndarray((max(n, 0),), kind, data, strides=(1,)) if n > 0 else np.zeros(0, kind)


def _slot(blocks: np.ndarray) -> np.ndarray:
    return (blocks.astype(np.uint64) * _MIX) >> np.uint64(64 - SHIFT_BITS)


@dataclass
class Search:
    """Shift table and suffix buckets for windows of one length class."""

    patterns: list[bytes]
    shortest: int
    kind: np.dtype
    shift: np.ndarray
    bucket_start: np.ndarray
    bucket: np.ndarray
    prefix: np.ndarray

    @classmethod
    def build(cls, patterns: list[bytes], kind: np.dtype) -> "Search":
        m, size = min(map(len, patterns)), kind.itemsize
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        shift = np.full(1 << SHIFT_BITS, m - size + 1, np.int32)
        slots = np.zeros(len(patterns), np.uint64)
        for at in range(m - size + 1):
            block = np.ascontiguousarray(heads[:, at : at + size]).view(kind)[:, 0]
            slots = _slot(block)
            np.minimum.at(shift, slots.astype(np.int64), m - size - at)
        order = np.argsort(slots, kind="stable")
        counts = np.bincount(slots.astype(np.int64), minlength=1 << SHIFT_BITS)
        prefix = np.ascontiguousarray(heads[:, :size]).view(kind)[:, 0]
        return cls(patterns, m, kind, shift, np.concatenate([[0], np.cumsum(counts)]), order, prefix)

    def candidates(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and windows that agree in the slot of the last block and in the first block."""
        blocks, size, m = _blocks(data, self.kind), self.kind.itemsize, self.shortest
        if len(data) < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Many lanes step through the data side by side, each over a share of the positions.
        edges = np.linspace(m - size, len(blocks), min(LANES, len(blocks)) + 1).astype(np.int64)
        at, end = edges[:-1].copy(), edges[1:]
        found: list[np.ndarray] = []
        while len(at):
            inside = at < end
            if not inside.all():
                at, end = at[inside], end[inside]
                if not len(at):
                    break
            step = self.shift[_slot(blocks[at]).astype(np.int64)]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
                step[hit] = 1
            at = at + step
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        stops = np.concatenate(found)
        slots = _slot(blocks[stops]).astype(np.int64)
        n = self.bucket_start[slots + 1] - self.bucket_start[slots]
        stops, first = np.repeat(stops, n), np.repeat(self.bucket_start[slots], n)
        nth = np.arange(len(stops)) - np.repeat(np.cumsum(n) - n, n)
        which, starts = self.bucket[first + nth], stops + size - m
        same = blocks[starts] == self.prefix[which]
        return starts[same], which[same]

    def occurrences(self, data: np.ndarray, raw: bytes) -> Iterator[tuple[int, int]]:
        starts, which = self.candidates(data)
        for s, w in zip(starts.tolist(), which.tolist()):
            if raw.startswith(self.patterns[w], s):
                yield s, w


@dataclass
class Windows:
    """Distinct windows, the items each belongs to, and their searches."""

    owners: dict[bytes, list[str]]
    searches: list[Search]

    @classmethod
    def build(cls, owners: dict[bytes, list[str]]) -> "Windows":
        searches, below = [], 1 << 62
        for least, _, kind in BLOCKS:
            group = [w for w in owners if least <= len(w) < below]
            below = least
            if group:
                searches.append(Search.build(group, kind))
        return cls(owners, searches)


def item_windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """``window, items``: every distinct window of the items, and the names of those that have it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, told in zip(batch.column(0), batch.column(1)):
                found = list(dict.fromkeys(windows_of(words_of(told.as_py().encode()), size)))
                yield batch_of(["window", "item"], [found, [name.as_py()] * len(found)], [pa.binary(), pa.string()])

    named = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).cast("string").alias("t")
    )
    each = map_batches(named.where("t IS NOT NULL"), task, "window binary, item string")
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _loads(items: DataFrame, item_id: str, text: str, size: int) -> tuple[list[tuple], str | None, int]:
    """The windows if they fit one search, else the folder that holds them in so many loads.

    A load is what falls to a hash of the window, about ``SEARCH_BYTES`` of
    windows and names; neither the driver nor a task ever has two of them.
    """
    found = stored(item_windows(items, item_id, text, size), "windows")
    names = F.aggregate("items", F.lit(0).cast("long"), lambda n, i: n + F.length(i) + 8)
    held = found.agg(F.sum(F.length("window") + names)).first()[0] or 0
    if held <= SEARCH_BYTES:
        return [(bytes(r["window"]), r["items"]) for r in found.collect()], None, 1
    loads = -(-held // SEARCH_BYTES)
    folder = run_folder(items.sparkSession, "loads")
    dealt = found.withColumn("load", F.pmod(F.xxhash64("window"), F.lit(loads)))
    dealt.repartition("load").write.partitionBy("load").parquet(folder)
    return [], folder, loads


def _read_loads(folder: str, loads: int) -> Iterator[Windows]:
    """One load after the other from the shared folder."""
    files, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    for load in range(loads):
        place = f"{root}/load={load}"
        if files.get_file_info(place).type == fs.FileType.NotFound:
            continue
        table = dataset.dataset(place, filesystem=files, format="parquet").to_table(["window", "items"])
        yield Windows.build(dict(zip(table.column("window").to_pylist(), table.column("items").to_pylist())))


def _scan(texts: list[bytes], loads: Iterable[Windows]) -> tuple[list[int], list[list], list[list[str]]]:
    """Words, merged hit word ranges and occurring items of each text."""
    counts, parts, begins, at = [], [], [], 0
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        part = b"\n " + b" ".join(words) + b" " if words else b"\n"
        begins.append(at)
        parts.append(part)
        at += len(part)
    raw = b"".join(parts)
    data = np.frombuffer(raw, np.uint8)
    begin = np.array(begins, np.int64)
    hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for load in loads:
        for search in load.searches:
            for s, w in search.occurrences(data, raw):
                doc = int(np.searchsorted(begin, s, "right")) - 1
                pattern = search.patterns[w]
                spans, names = hits.setdefault(doc, ([], set()))
                spans.append((s, pattern.count(b" ") - 1))
                names.update(load.owners[pattern])
    ranges: list[list] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    for doc, (spans, names) in hits.items():
        low = begins[doc]
        spaces = np.flatnonzero(data[low : low + len(parts[doc])] == 0x20) + low
        first = np.searchsorted(spaces, [s for s, _ in spans])
        ranges[doc] = _merged(sorted((int(a), int(a) + n) for a, (_, n) in zip(first, spans)))
        items[doc] = sorted(names)
    return counts, ranges, items


def _merged(ranges: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, end in ranges:
        if out and start <= out[-1]["end_word"]:
            out[-1]["end_word"] = max(out[-1]["end_word"], end)
        else:
            out.append({"start_word": start, "end_word": end})
    return out


_RANGES = pa.list_(pa.struct([("start_word", pa.int64()), ("end_word", pa.int64())]))


def find_benchmark_text(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window_words: int = WINDOW_WORDS,
    keep_rows: bool = False,
) -> DataFrame:
    """``doc_id, n_words, hits, items`` for every document: hit word ranges and occurring items.

    With ``keep_rows`` a column ``row`` carries the document's own columns.

    One map over the documents, which are read once. Item windows are made and
    told apart in Spark. Up to about ``SEARCH_BYTES`` of them are broadcast; more
    lie in the shared folder in loads of that size, and each batch of documents
    is searched for one load after the other, so memory does not grow with the
    items while time does. The shared folder must then be of a kind Arrow can
    open. Null and empty texts have no words and no
    hits; a null item has no window, a null item id is called ``null``; equal
    items and repeated rows each count; other columns are ignored; empty
    tables give no rows or no hits.
    """
    few, folder, loads = _loads(items, item_id, item_text, window_words)
    shared = docs.sparkSession.sparkContext.broadcast(few)
    names = ["doc_id", "n_words", "hits", "items"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Windows.build(dict(shared.value))] if folder is None else None
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            counts, ranges, found = _scan(texts, known or _read_loads(folder, loads))
            kinds = [batch.column(0).type, pa.int64(), _RANGES, pa.list_(pa.string())]
            yield with_rows(batch, batch_of(names, [batch.column(0), counts, ranges, found], kinds))

    rows = id_and_text(docs, doc_id, text, keep_rows)
    told = "n_words long, hits array<struct<start_word:long,end_word:long>>, items array<string>"
    return map_batches(rows, task, schema_with_rows(rows, told))


def contamination(found: DataFrame) -> DataFrame:
    """The digest columns of the query, derived from the hits."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end_word"] - h["start_word"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )

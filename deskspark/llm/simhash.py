"""SimHash near-duplicates: fingerprints, and exact links by vantage-point trees.

A tree of vantage points, fitted on a bounded sample, deals all distinct
fingerprints to shards by their Hamming distance to the points. Fingerprints
close to a boundary go to both sides, so any two that link share a shard. Shards
that stay large, as a dense cluster does, are dealt further by equal blocks of
bits. Each shard grows its own tree and compares only inside its leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.llm.arrow_text import batch_of, map_batches, text_bytes
from deskspark.llm.components import component_labels
from deskspark.llm.stored import stored

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints from which the tree of shards is fitted, at least and at most; all fingerprints are dealt.
SAMPLE_ROWS = 16_384
MOST_SAMPLE_ROWS = 1 << 20
SHARD_ROWS = 20_000
LEAF_ROWS = 1_024
SHINGLES_AT_ONCE = 65_536
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes) -> int:
    """64 bits: bit b is set if more than half of the shingle hashes have it."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(SHINGLE_WORDS, len(words))
    stops = ends[width - 1 :].tolist()
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for low in range(0, len(stops), SHINGLES_AT_ONCE):
        high = low + SHINGLES_AT_ONCE
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[low:high], stops[low:high])]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(stops)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row; null and empty texts have 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            raw = data.tobytes()
            prints = [fingerprint(raw[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield batch_of(["doc_id", "fp"], [batch.column(0), signed], [batch.column(0).type, pa.int64()])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    return map_batches(rows, task, f"doc_id {kind}, fp long")


def _apart(prints: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ point)


#: ``(point, radius, near, far)``: prints at most ``radius`` bits from ``point`` go near, those beyond it
#: far, the boundary to both. A shard is its number. Plain tuples, so that tasks need no class for them.
Tree = tuple | int


def choose_split(prints: np.ndarray, bits: int, tries: int = 12) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that leave the fewest comparisons, or None if none saves any.

    Judged on at most 4,096 of the prints; what lies where is then decided for all.
    """
    seen = prints[:: max(1, len(prints) // 4096)]
    best, least = None, 0.95
    for point in np.unique(seen[:: max(1, len(seen) // tries)][:tries]):
        upto = np.cumsum(np.bincount(_apart(seen, point), minlength=65)) / len(seen)
        far = 1 - np.concatenate([np.zeros(bits), upto])[:65]
        work = upto**2 + far**2
        radius = int(np.argmin(work))
        if work[radius] < least and upto[radius] < 1:
            best, least = (point, radius), work[radius]
    return best


def sides(prints: np.ndarray, point: np.uint64, radius: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two prints that link are both near, or both more than ``radius - bits`` bits away."""
    d = _apart(prints, point).astype(np.int64)
    return d <= radius, d > radius - bits


def grow_shards(sample: np.ndarray, shards: float, bits: int) -> tuple[Tree, int]:
    """A tree whose leaves are shard numbers; each leaf has about 1 / ``shards`` of the sample."""
    count = 0
    least = max(2.0, len(sample) / max(shards, 1.0))

    def grow(part: np.ndarray) -> Tree:
        nonlocal count
        split = choose_split(part, bits) if len(part) > least else None
        if split is None:
            count += 1
            return count - 1
        near, far = sides(part, *split, bits)
        return (*split, grow(part[near]), grow(part[far]))

    return grow(sample), count


def route(tree: Tree, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each print with each of its shards."""
    todo, shard_of, out = [(tree, prints)], [], []
    while todo:
        node, part = todo.pop()
        if not len(part):
            continue
        if isinstance(node, tuple):
            point, radius, to_near, to_far = node
            near, far = sides(part, point, radius, bits)
            todo += [(to_near, part[near]), (to_far, part[far])]
        else:
            shard_of.append(np.full(len(part), node, np.int32))
            out.append(part)
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return np.concatenate(shard_of), np.concatenate(out)


def _leaf_links(part: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one leaf: a search from print to print, each looking only at those not reached."""
    heads, tails = [], []
    open_ = part
    if len(part) <= LEAF_ROWS:
        close = np.bitwise_count(part[:, None] ^ part[None, :]) <= bits
        open_ = part[close.sum(axis=1) > 1]
    while len(open_):
        root, frontier, open_ = open_[0], open_[:1], open_[1:]
        while len(frontier) and len(open_):
            reached = np.zeros(len(open_), bool)
            for point in frontier[:64]:
                reached |= _apart(open_, point) <= bits
            new = open_[reached]
            heads.append(np.full(len(new), root))
            tails.append(new)
            open_ = open_[~reached]
            frontier = np.concatenate([frontier[64:], new])
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (empty, empty)


def shard_links(prints: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever lies within ``bits`` bits, directly or by steps."""
    heads, tails, todo = [], [], [np.unique(prints)]
    while todo:
        part = todo.pop()
        split = choose_split(part, bits) if len(part) > LEAF_ROWS else None
        if split is None:
            h, t = _leaf_links(part, bits)
            heads.append(h)
            tails.append(t)
            continue
        near, far = sides(part, *split, bits)
        todo += [part[near], part[far]]
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (empty, empty)


def cover_keys(blocks: int, bits: int) -> list[Column]:
    """Keys such that any two fingerprints of a shard within ``bits`` bits have one in common.

    The 64 bits are cut into ``blocks``; at most ``bits`` of them can differ, so
    some choice of the others is equal in both. Different keys that hash alike
    share a group, which costs time only.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [
        F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1)) for low, high in zip(edges, edges[1:])
    ]
    chosen = combinations(range(blocks), blocks - bits)
    return [F.xxhash64("shard", F.lit(k), *[parts[i] for i in which]) for k, which in enumerate(chosen)]


def split_large(dealt: DataFrame, bits: int) -> DataFrame:
    """``shard, fp`` with shards of over twice ``SHARD_ROWS`` dealt further, as no tree can split a dense cluster.

    First by single blocks of ``bits + 1``, then, where many prints agree even
    there, by choices of three blocks of ``bits + 3``. Every two that link still
    share a shard.
    """
    for blocks in (bits + 1, bits + 3):
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("n"))
        large = stored(sizes.where(F.col("n") > 2 * SHARD_ROWS).select("shard"), "large-shards")
        if large.isEmpty():
            break
        further = dealt.join(large, "shard", "left_semi").select(
            F.explode(F.array(*cover_keys(blocks, bits))).alias("shard"), "fp"
        )
        dealt = stored(dealt.join(large, "shard", "left_anti").unionByName(further), "dealt")
    return dealt


def print_links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: links between distinct fingerprints, enough to connect each component.

    ``distinct`` is read three times (count, sample, all) and should be stored.
    The sample grows with the shards, up to ``MOST_SAMPLE_ROWS``.
    """
    spark = distinct.sparkSession
    rows = distinct.count()
    wanted = min(MOST_SAMPLE_ROWS, max(SAMPLE_ROWS, 8 * rows // SHARD_ROWS))
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(wanted)
    held = np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64)
    tree, _ = grow_shards(held, rows / SHARD_ROWS, bits)
    shared = spark.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            shard, copies = route(shared.value, prints, bits)
            yield batch_of(["shard", "fp"], [shard.astype(np.int64), copies.view(np.int64)], [pa.int64(), pa.int64()])

    def link(table: pa.Table) -> pa.Table:
        prints = table.column("fp").to_numpy().view(np.uint64)
        a, b = shard_links(prints, bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = split_large(stored(map_batches(distinct.select("fp"), deal, "shard long, fp long"), "dealt"), bits)
    return dealt.groupBy("shard").applyInArrow(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Copies share a fingerprint and meet only as one row of the distinct table,
    pre-aggregated before the shuffle. Documents without words have fingerprint
    zero and link like any other. A component is named by its smallest id, null
    only if all its ids are; repeated rows stay; other columns are ignored; an
    empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    labels = component_labels(print_links(distinct, bits), "a", "b")
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = stored(named.join(smallest, "root").select("fp", "component_id"), "print-components")
    return prints.join(of_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )

"""Per-text embedding cache: a table keyed by a hash of encoder and text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.functions.scores import computed_once
from deskspark.operators.sizes import computed_now
from deskspark.schemas import EMBEDDINGS
from deskspark.sources import commits

TextEncoder = Callable[[Sequence[str]], np.ndarray]
#: Texts handed to the encoder at once.
ENCODE_ROWS = 64
#: Words of 64 bits that sieve rows by their key, a power of two.
SIEVE_WORDS = 1 << 19


def cache_key(encoder: str, text: Column) -> Column:
    """Hex SHA-256 of the encoder name, a zero byte and the text."""
    return F.sha2(F.concat(F.lit(encoder), F.lit("\0"), text), 256)


def keyed_texts(messages: DataFrame, encoder: str) -> DataFrame:
    """``text, cache_key`` of all rows with a text; each text is hashed once, whatever a join asks of its key."""
    key = computed_once(cache_key=cache_key(encoder, F.col("text")))
    return messages.where("text IS NOT NULL").select("text", key)


def _sieved(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose ``cache_key`` may be among ``keys``: every one that is, and hardly another unless keys are very many.

    A bit per key's hash is broadcast, in ``SIEVE_WORDS`` rows at most.
    """
    spot = F.xxhash64("cache_key")
    word = spot.bitwiseAND(F.lit(SIEVE_WORDS - 1).cast("long"))
    bit = F.shiftrightunsigned(spot, 58).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    sieve = keys.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    held = (word == F.col("_word")) & (F.bit_get("_bits", bit) == 1)
    return keyed.join(F.broadcast(sieve), held, "left_semi")


def cache_misses(messages: DataFrame, cache: DataFrame, encoder: str) -> DataFrame:
    """Distinct texts that still have to be encoded.

    Keys are looked up first, without their texts. Only texts that are missing
    move after that, and copies of a text collapse before they do. A null text
    has no key and is never missing.
    """
    keyed = keyed_texts(messages, encoder)
    missing = computed_now(keyed.select("cache_key").distinct().join(cache.select("cache_key"), "cache_key", "left_anti"))
    wanted = _sieved(keyed, missing).groupBy("cache_key").agg(F.any_value("text").alias("text"))
    return wanted.join(missing, "cache_key", "left_semi")


def with_embeddings(messages: DataFrame, cache: DataFrame, encoder: str) -> DataFrame:
    """Look embeddings up; rows not in the cache keep a null embedding."""
    keyed = messages.withColumn("cache_key", cache_key(encoder, F.col("text")))
    return keyed.join(cache.select("cache_key", "embedding"), "cache_key", "left").drop("cache_key")


def encode_texts(missing: DataFrame, load_encoder: Callable[[], TextEncoder], rows: int = ENCODE_ROWS) -> DataFrame:
    """``cache_key, embedding`` of distinct texts, encoded in batches inside the tasks.

    ``load_encoder`` runs once per task. A result with other than one row per
    text, or a component that is no finite number, is an error: a vector stays
    in the cache for good.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            encode = encode or load_encoder()
            for at in range(0, len(texts), rows):
                some = texts[at : at + rows]
                vectors = np.asarray(encode(some), dtype=np.float64)
                if vectors.ndim != 2 or len(vectors) != len(some) or not np.isfinite(vectors).all():
                    raise ValueError(f"The encoder gave no usable vectors for {len(some)} texts")
                column = pa.array(list(vectors), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([keys[at : at + rows], column], EMBEDDINGS.names)

    return missing.select("cache_key", "text").mapInArrow(task, EMBEDDINGS)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Embeddings of all published fills, one row per key."""
    return commits.read_parts(spark, path, EMBEDDINGS, commits.latest(spark, path).parts)


def fill_cache(
    messages: DataFrame, path: str, encoder: str, load_encoder: Callable[[], TextEncoder], rows: int = ENCODE_ROWS
) -> int:
    """Encode the texts that the cache at ``path`` does not hold yet; how many were added.

    Rows become part of the cache all at once, when their list is published.
    Until then a failed or killed fill leaves the cache as it was. A fill that
    meets another one's list drops the keys the other one added and publishes
    the rest, so no key is ever there twice. Calling again encodes nothing.
    """
    spark = messages.sparkSession
    seen = commits.latest(spark, path)
    missing = cache_misses(messages, commits.read_parts(spark, path, EMBEDDINGS, seen.parts), encoder)
    part = commits.new_part(encode_texts(missing, load_encoder, rows), path)
    while True:
        added = commits.read_parts(spark, path, EMBEDDINGS, (part,)).count()
        if not added:
            return 0
        if commits.publish(spark, path, seen, (*seen.parts, part)):
            return added
        now = commits.latest(spark, path)
        theirs = commits.read_parts(spark, path, EMBEDDINGS, tuple(p for p in now.parts if p not in seen.parts))
        mine = commits.read_parts(spark, path, EMBEDDINGS, (part,))
        part = commits.new_part(mine.join(theirs.select("cache_key"), "cache_key", "left_anti"), path)
        seen = now


def compact_cache(spark: SparkSession, path: str, files: int) -> bool:
    """Put all fills into one folder of ``files`` files, ordered by key; false if there was nothing to do.

    Fills published meanwhile stay beside it.
    """
    seen = commits.latest(spark, path)
    if len(seen.parts) < 2:
        return False
    whole = commits.read_parts(spark, path, EMBEDDINGS, seen.parts)
    part = commits.new_part(whole.repartitionByRange(files, "cache_key").sortWithinPartitions("cache_key"), path)
    merged = set(seen.parts)
    while not commits.publish(spark, path, seen, (part, *[p for p in seen.parts if p not in merged])):
        seen = commits.latest(spark, path)
        if not merged <= set(seen.parts):
            return False  # another compaction came first
    return True


def embed_messages(
    messages: DataFrame, path: str, encoder: str, load_encoder: Callable[[], TextEncoder], rows: int = ENCODE_ROWS
) -> DataFrame:
    """``messages`` with ``embedding``, encoding only what the cache does not hold; null for null texts."""
    fill_cache(messages, path, encoder, load_encoder, rows)
    return with_embeddings(messages, read_cache(messages.sparkSession, path), encoder)

"""Deterministic stratified samples and splits.

Every row draws a ticket, the MD5 of (seed, row_id). A class's sample is the
rows with its lowest tickets, so membership depends on nothing but seed and ids.
To find where a class's sample ends without sorting the class, tickets are
counted by their leading bits, and only the tickets in the one bucket where the
quota runs out are ranked. What is left is a cut ticket per class, and drawing
the sample is a filter that moves no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskspark.operators.sizes import computed_now

# Rows ranked in one task at most, roughly; more buckets are used beyond it.
ROWS_PER_BUCKET = 100_000
_TICKET_BITS = 32


def ticket(seed: int, row_id: str = "row_id") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def class_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def quotas(sizes: DataFrame, n: int, label: str = "label") -> DataFrame:
    """``label, n, quota``: ``n`` split over classes by size; leftovers go to the largest remainders.

    Equal remainders are settled by class order. Works on a class-sized table.
    """
    whole = Window.partitionBy()
    exact = F.lit(float(n)) * F.col("n") / F.sum("n").over(whole)
    parts = sizes.select(label, "n", exact.alias("exact"), F.floor(exact).alias("part"))
    left = F.lit(n) - F.sum("part").over(whole)
    place = F.row_number().over(Window.partitionBy().orderBy((F.col("exact") - F.col("part")).desc(), label))
    more = F.when(place <= left, 1).otherwise(0)
    return parts.select(label, "n", (F.col("part") + more).alias("quota"))


def _cuts(df: DataFrame, wanted: DataFrame, largest: int, seed: int, label: str, rows_per_bucket: int) -> DataFrame:
    """``label, cut_ticket, cut_id``: the last row of each class's sample."""
    bits = min(_TICKET_BITS, max(0, math.ceil(math.log2(max(1.0, largest / rows_per_bucket)))))
    lead = F.conv(F.substring(ticket(seed), 1, _TICKET_BITS // 4), 16, 10).cast("long")
    bucket = F.shiftright(lead, _TICKET_BITS - bits)
    quota = wanted.where("quota > 0").select(F.col(label).alias("_label"), "quota")
    earlier = Window.partitionBy(label).orderBy("bucket")
    ends = computed_now(
        df.groupBy(label, bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(earlier))
        .join(quota, F.col(label).eqNullSafe(F.col("_label")))
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select(
            F.col(label).alias("_label"),
            F.col("bucket").alias("_bucket"),
            (F.col("quota") - F.col("upto") + F.col("n")).alias("rest"),
        )
    )
    place = Window.partitionBy("_label").orderBy("cut_ticket", "cut_id")
    rows = df.select(
        label, bucket.alias("bucket"), ticket(seed).alias("cut_ticket"), F.col("row_id").alias("cut_id")
    )
    here = F.col(label).eqNullSafe(F.col("_label")) & (F.col("bucket") == F.col("_bucket"))
    return computed_now(
        rows.join(ends, here)
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") == F.col("rest"))
        .select("_label", "cut_ticket", "cut_id")
    )


def _mark_sampled(
    df: DataFrame, wanted: DataFrame, largest: int, seed: int, label: str, rows_per_bucket: int
) -> DataFrame:
    cuts = _cuts(df, wanted, largest, seed, label, rows_per_bucket)
    marked = df.join(cuts, F.col(label).eqNullSafe(F.col("_label")), "left")
    mine = F.struct(ticket(seed).alias("t"), F.col("row_id").alias("i"))
    cut = F.struct(F.col("cut_ticket").alias("t"), F.col("cut_id").alias("i"))
    inside = F.col("cut_ticket").isNotNull() & (mine <= cut)
    return marked.withColumn("sampled", inside).drop("_label", "cut_ticket", "cut_id")


def _extent(sizes: DataFrame) -> tuple[int, int, int]:
    """Rows in all, rows of the largest class, and classes."""
    row = sizes.agg(F.sum("n"), F.max("n"), F.count("*")).first()
    return row[0] or 0, row[1] or 0, row[2]


def stratified_subsample(
    df: DataFrame,
    n: int,
    seed: int = 42,
    label: str = "label",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``n`` rows in the class proportions of ``df``; rows without a label are a class of their own.

    All rows if ``n`` covers them; a plain random sample if ``n`` is below the
    number of classes.
    """
    sizes = computed_now(class_sizes(df, label))
    total, largest, n_classes = _extent(sizes)
    if n >= total:
        return df
    if n < n_classes:
        pooled = df.withColumn("_all", F.lit(0))
        one = df.sparkSession.createDataFrame([(0, n)], "_all int, quota long")
        marked = _mark_sampled(pooled, one, total, seed, "_all", rows_per_bucket)
        return marked.where("sampled").drop("sampled", "_all")
    marked = _mark_sampled(df, quotas(sizes, n, label), largest, seed, label, rows_per_bucket)
    return marked.where("sampled").drop("sampled")


def stratified_split(
    df: DataFrame,
    val_share: float = 0.1,
    seed: int = 42,
    label: str = "label",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``split``: ``val`` for ``val_share`` of each class, else ``train``.

    Rows without a label are a class of their own.
    """
    sizes = computed_now(class_sizes(df, label))
    total, largest, _ = _extent(sizes)
    wanted = quotas(sizes, math.ceil(val_share * total), label)
    marked = _mark_sampled(df, wanted, largest, seed, label, rows_per_bucket)
    return marked.withColumn("split", F.when(F.col("sampled"), "val").otherwise("train")).drop(
        "sampled"
    )


def class_shares(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    counts = df.groupBy(split, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split)))


def class_drift(
    df: DataFrame, left: str, right: str, label: str = "label", split: str = "split"
) -> DataFrame:
    """Largest difference of a class's share between two splits, one row."""

    def share(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col(split) == name, F.col("share"))), F.lit(0.0))

    return (
        class_shares(df.where(F.col(split).isin(left, right)), label, split)
        .groupBy(label)
        .agg((share(left) - share(right)).alias("difference"))
        .agg(F.max(F.abs("difference")).alias("max_share_difference"))
    )


def shared_texts(
    df: DataFrame, splits: Sequence[str], split: str = "split", text: str = "text"
) -> DataFrame:
    """Per pair of ``splits``, how many distinct texts they share.

    Each text keeps one bit per split it occurs in. The bits are combined before
    the shuffle, so a text repeated any number of times moves as one row a task.
    """
    bit = F.coalesce(*[F.when(F.col(split) == s, F.lit(1 << i)) for i, s in enumerate(splits)])
    owners = (
        df.where(F.col(split).isin(*splits))
        .groupBy(F.sha2(text, 256).alias("text_key"))
        .agg(F.bit_or(bit).alias("owners"))
    )
    pairs = [(a, b) for a in range(len(splits)) for b in range(a + 1, len(splits))]

    def both(a: int, b: int) -> Column:
        mask = (1 << a) | (1 << b)
        return F.count_if(F.col("owners").bitwiseAND(mask) == mask)

    counted = owners.agg(*[both(a, b).alias(f"_{a}_{b}") for a, b in pairs])
    rows = [
        F.struct(
            F.lit(splits[a]).alias("split_a"),
            F.lit(splits[b]).alias("split_b"),
            F.col(f"_{a}_{b}").alias("shared_texts"),
        )
        for a, b in pairs
    ]
    return counted.select(F.inline(F.array(*rows)))


def dataset_quality(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows, null counts and distinct classes per split.

    One hash aggregate per (split, class) over the rows; the rest is class-sized.
    """
    classes = df.groupBy(split, "label").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("null_texts")
    )
    return classes.groupBy(split).agg(
        F.sum("n").alias("n_rows"),
        F.sum("null_texts").alias("null_texts"),
        F.sum(F.when(F.col("label").isNull(), F.col("n")).otherwise(0)).alias("null_labels"),
        F.count("label").alias("n_classes"),
        F.min("label").alias("min_label"),
        F.max("label").alias("max_label"),
    )

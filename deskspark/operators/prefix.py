"""Running totals and exact order statistics over data of any size.

A window over a hot key (or over no key at all) runs in one task. Here the rows
of a key are cut into slices along the order, so a key holding most of the rows
is spread over many tasks; each slice sums on its own and the totals of earlier
slices are added on top.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskspark.operators.sizes import computed_now, computed_small

#: Rows of a bounded sample for each slice bound, and slices at most.
SAMPLED_PER_SLICE = 32
MOST_SLICES = 4096
#: Codes of values per factor of e: neighbours are 1 / 4096 apart.
CODE_STEPS = 4096


def _directed(order: Sequence[str]) -> list[tuple[str, bool]]:
    """Column and whether it falls, from names with a leading minus for falling ones."""
    return [(c.removeprefix("-"), c.startswith("-")) for c in order]


def _sorting(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc() if falls else F.col(c).asc() for c, falls in _directed(order)]


def slice_number(df: DataFrame, order: Sequence[str], slices: int) -> Column:
    """The slice of a row, a function of its ``order`` columns alone.

    Bounds are quantiles of a bounded sample and stand in the plan as literals;
    a binary search finds the place of a row among them. A retried task
    therefore places its rows as the first try did. Nulls go with the first
    slice of a rising and the last of a falling column, as they sort.
    """
    names = _directed(order)
    mark = F.xxhash64(*[c for c, _ in names])
    few = df.select(*[c for c, _ in names]).orderBy(mark).limit(SAMPLED_PER_SLICE * slices)
    rows = few.orderBy(*_sorting(order)).collect() if slices > 1 else []
    bounds = list(dict.fromkeys(rows[len(rows) * i // slices] for i in range(1, slices)) if rows else [])
    if not bounds:
        return F.lit(0)
    lists = [F.array(*[F.lit(b[i]).cast(df.schema[c].dataType) for b in bounds]) for i, (c, _) in enumerate(names)]

    def at_or_after(place: Column) -> Column:
        """Whether the row sorts at or after the bound at a place."""
        told = F.lit(True)
        for (c, falls), values in reversed(list(zip(names, lists))):
            mine, bound = F.col(c), F.get(values, place)
            past = (mine < bound) if falls else (mine > bound)
            told = F.coalesce(past | ((mine == bound) & told), F.lit(falls))
        return told

    step, found = 1 << (len(bounds).bit_length() - 1), F.lit(0)
    steps = []
    while step:
        steps.append(F.lit(step))
        step //= 2
    inside = len(bounds)
    return F.aggregate(
        F.array(*steps),
        found,
        lambda at, s: F.when((at + s <= inside) & at_or_after(at + s - 1), at + s).otherwise(at),
    )


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    slices: int | None = None,
    wanted: Callable[[dict[str, Column]], Column] | None = None,
) -> DataFrame:
    """Adds ``running_<c>`` for each integer column ``c`` in ``sums``.

    ``order`` names columns, with a minus for falling order, and must be a total
    order within ``by``. The sums should be integers: their total then does not
    depend on where the slices fall. Totals of the slices are added up before
    rows move, and rows move once, to their slice. ``wanted`` may rule out
    slices by the totals before them; their rows are left out and never move.
    """
    spark = df.sparkSession
    n = min(slices or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_SLICES)
    placed = df.withColumn("_slice", slice_number(df, order, n))
    totals = placed.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_total_{c}") for c in sums])
    # At most ``n`` rows per key.
    earlier = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_slice").alias("_by_slice"),
        *[F.coalesce(F.sum(f"_total_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums],
    )
    if wanted is not None:
        offsets = offsets.where(wanted({c: F.col(f"_before_{c}") for c in sums}))
    same = F.col("_slice") == F.col("_by_slice")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = placed.join(computed_now(offsets), same)
    inside = (
        Window.partitionBy(*by, "_slice")
        .orderBy(*_sorting(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return joined.select(
        *df.columns,
        *[(F.col(f"_before_{c}") + F.sum(c).over(inside)).alias(f"running_{c}") for c in sums],
    )


def _same_group(by: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return same


def value_code(value: Column) -> Column:
    """A whole number that never falls where ``value`` rises: its logarithm in steps of 1 / ``CODE_STEPS``.

    Counts by code are a quantile sketch that merges by adding, and they are
    exact: the code that holds a rank is known from them for sure.
    """
    size = F.abs(value)
    # The logarithm of the smallest double is above -745.2, so codes of positive values are positive.
    step = F.floor((F.ln(size) + 746.0) * CODE_STEPS)
    beyond = F.lit(1456 * CODE_STEPS)  # the logarithm of the largest is below 710
    code = F.when(size == 0, 0).when(size == float("inf"), beyond).otherwise(step)
    return F.when(F.isnan(value), beyond + 1).when(value < 0, -code).otherwise(code).cast("long")


def _asked(codes: DataFrame, fractions: Sequence[float], by: list[str]) -> DataFrame:
    """``_of_<by>, _of_code, _asks``: codes that hold a wanted rank, and which place in them it has.

    ``codes`` has ``_code, _n``. A percentile lies between two neighbouring
    ranks, which may have different codes.
    """
    within = Window.partitionBy(*by)
    counted = codes.select(
        *by,
        "_code",
        "_n",
        F.sum("_n").over(within).alias("_size"),
        F.sum("_n").over(within.orderBy("_code").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_upto"),
    )
    asks = []
    for i, q in enumerate(fractions):
        place = F.lit(float(q)) * (F.col("_size") - 1)
        first = F.floor(place)
        for last, rank in ((False, first), (True, F.least(first + 1, F.col("_size") - 1))):
            here = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n"))
            told = F.struct(
                F.lit(i).alias("f"),
                F.lit(last).alias("last"),
                (rank - F.col("_upto") + F.col("_n")).cast("long").alias("place"),
                (place - first).alias("part"),
            )
            asks.append(F.when(here, told))
    wanted = F.array_compact(F.array(*asks))
    return counted.where(F.size(wanted) > 0).select(
        *[F.col(c).alias(f"_of_{c}") for c in by], F.col("_code").alias("_of_code"), wanted.alias("_asks")
    )


def percentiles_by_code(
    rows: DataFrame, codes: DataFrame, value: str, fractions: dict[str, float], by: Sequence[str]
) -> DataFrame:
    """Percentiles of ``value`` from counts by code, ``codes`` with ``_code, _n``, and one more pass over the rows.

    The pass counts the values whose code holds a wanted rank; only they are
    ranked.
    """
    keys = list(by)
    shares = list(fractions.values())
    valued = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))
    same = _same_group(keys) & (value_code(F.col("_value")) == F.col("_of_code"))
    near = valued.join(_asked(codes, shares, keys), same)
    counts = computed_small(
        near.groupBy(*keys, "_of_code", "_value", "_asks").agg(F.count("*").alias("_n"))
    )
    if counts.rdd.getNumPartitions() == 1:
        upto = Window.partitionBy(*keys, "_of_code").orderBy("_value")
        ranked = counts.withColumn("running__n", F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    else:
        ranked = running_totals(counts, [*keys, "_of_code"], ["_value"], ["_n"])
    each = ranked.select(*keys, "_value", "_n", "running__n", F.explode("_asks").alias("_ask"))
    place = F.col("_ask")["place"]
    found = each.where((place < F.col("running__n")) & (place >= F.col("running__n") - F.col("_n")))

    def told(what: Column, i: int, last: bool) -> Column:
        return F.max(F.when((F.col("_ask")["f"] == i) & (F.col("_ask")["last"] == last), what))

    answers = []
    for i, name in enumerate(fractions):
        low, high = (told(F.col("_value"), i, last) for last in (False, True))
        part = told(F.col("_ask")["part"], i, False)
        # Next to an infinite value a share of nothing must stay nothing.
        answers.append(F.when(part == 0, low).otherwise(low + (high - low) * part).alias(name))
    return found.groupBy(*keys).agg(*answers)


def exact_percentiles(
    df: DataFrame,
    value: str,
    fractions: dict[str, float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Linear-interpolation percentiles of ``value``, one column per fraction.

    Exact at any size. Counting the rows by ``value_code`` finds the codes that
    hold the wanted ranks, one more count finds the values in them, and only
    those are ranked: a share of about 1 / ``CODE_STEPS`` of the rows where values
    are spread out. Both counts are added up before they move, so neither a hot
    group nor a hot value lands in one task. Groups without values give no row,
    except that an ungrouped call always gives one.
    """
    keys = list(by) or ["_all"]
    rows = df.select(*(by or [F.lit(0).alias("_all")]), F.col(value).alias("_measure"))
    coded = rows.where("_measure IS NOT NULL").withColumn("_code", value_code(F.col("_measure").cast("double")))
    codes = computed_small(coded.groupBy(*keys, "_code").agg(F.count("*").alias("_n")))
    found = percentiles_by_code(rows, codes, "_measure", fractions, keys)
    return found if by else found.agg(*[F.max(name).alias(name) for name in fractions])

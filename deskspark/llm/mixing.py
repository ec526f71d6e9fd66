"""Mixing sources to target weights by subset-sum budget fitting.

Documents of a source differ for the budget only by their length, so they are
counted by exact length first. Each length gives its share of the budget, and
bounded-knapsack dynamic programming over the documents that are left finds
lengths that fill the rest. Which documents of a length are taken follows from
a seeded hash of their id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskspark.llm.stored import stored

#: Fixed values of the mix: weights by source order, the share of all words, and copies per document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
SEED = 7
SPACES = "[\\x20\\x09-\\x0D]+"
#: Words left to the dynamic program.
REST_WORDS = 4_096
#: Documents of one length in one ranked slice.
SLICE_ROWS = 4_096


def length_of(text: Column) -> Column:
    """Words; a split has an empty part where the text begins or ends with space."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> list[float]:
    """Targets of the sources in their order; excess over twice a size is reshared until none is above."""
    most = [MAX_COPIES * s for s in sizes]
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    capped: set[int] = set()
    while True:
        left = share * sum(sizes) - sum(most[i] for i in capped)
        total = sum(w for i, w in enumerate(weight) if i not in capped)
        if not total:
            return [float(m) for m in most]
        aims = [float(most[i]) if i in capped else left * weight[i] / total for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in capped and aims[i] > most[i]}
        if not over:
            return aims
        capped |= over


def fill_rest(lengths: np.ndarray, left: np.ndarray, rest: int) -> dict[int, int]:
    """Bounded knapsack: documents by length, at most ``left`` of each, whose words come nearest to ``rest``.

    Reachable sums are bits of a number; a length with n documents joins in
    binary parts. Stops as soon as the exact sum is reached. The sum may pass
    ``rest`` where that is nearer.
    """
    usable = lengths[(lengths > 0) & (left > 0)]
    if rest <= 0 or not len(usable):
        return {}
    most = 2 * rest
    room = (1 << (most + 1)) - 1
    reach, steps = 1, []
    for length, count in zip(lengths.tolist(), left.tolist()):
        if length <= 0 or length > most:
            continue
        count, part = min(count, most // length), 1
        while count > 0:
            take = min(part, count)
            new = (reach << (length * take)) & room & ~reach
            if new:
                steps.append((length, take, new))
                reach |= new
            count, part = count - take, part * 2
        if reach >> rest & 1:
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    at = below
    if above:
        next_up = rest + (above & -above).bit_length()
        at = next_up if next_up - rest < rest - below else below
    chosen: dict[int, int] = {}
    for length, take, new in reversed(steps):
        if new >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, rest_words: int = REST_WORDS) -> np.ndarray:
    """Documents to take of each length so that their words come to ``budget`` as nearly as can be.

    Shares are dealt to the lengths from long to short, rounded so that what
    one length leaves over passes to the next. All but the last words go this
    way; the dynamic program fills the rest.
    """
    total = int((lengths * counts).sum())
    budget = min(max(budget, 0), total)
    taken = np.zeros(len(lengths), np.int64)
    if total == 0 or budget == 0:
        return taken
    if budget == total:
        return counts.copy()
    order = np.argsort(-lengths, kind="stable")
    bulk = max(0, budget - rest_words)
    mass = np.cumsum((lengths * counts)[order])
    used = 0
    for at, upto in zip(order.tolist(), mass.tolist()):
        length = int(lengths[at])
        if length > 0:
            due = int(bulk * upto // total) - used
            taken[at] = max(0, min(int(counts[at]), due // length))
            used += int(taken[at]) * length
    for length, n in fill_rest(lengths, counts - taken, budget - used).items():
        taken[int(np.flatnonzero(lengths == length)[0])] += n
    return taken


def _plan(table: pa.Table) -> pa.Table:
    """Copies for one source from its counts by length: all documents ``whole`` times, ``extra`` once more."""
    table = table.sort_by("size")  # rows come in any order, the fit must not
    lengths = table.column("size").to_numpy().astype(np.int64)
    counts = table.column("n").to_numpy().astype(np.int64)
    target = table.column("target")[0].as_py()
    total = int((lengths * counts).sum())
    whole = min(MAX_COPIES, int(target // total)) if total else 0
    extra = fit_budget(lengths, counts, round(target) - whole * total) if whole < MAX_COPIES else 0 * counts
    return pa.table(
        {
            "key": table.column("key"),
            "size": lengths,
            "n": counts,
            "whole": np.full(len(lengths), whole, np.int64),
            "extra": np.asarray(extra, np.int64),
        }
    )


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    seed: int = SEED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` and the columns in ``keep``, for every row.

    Sources go by code point, null last, and an empty name is a source of its
    own. Null texts have size 0; documents without words add nothing and get
    the copies that all documents get. Repeated rows are documents of their own:
    if only some of a set of equal rows are due a copy more, as many get it. An
    empty table gives an empty one. Reruns agree: a hash of seed, id, text and
    kept columns ranks the documents of a length.

    Texts are read once; everything after that reads a row's size and hash from
    the shared folder. Bounds: one row per source on the driver; one group has
    one row per distinct length of a source, at most the square root of twice its
    words. Ranking is cut into slices by hash, equal hashes count as one row, only
    the slice that holds the cut is ranked, and slices grow in number with the
    documents of that length.
    """
    spark = docs.sparkSession
    key = F.struct(F.col("_source").isNull().alias("last"), F.coalesce("_source", F.lit("")).alias("name"))
    kept = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in keep]))] if keep else []
    read = docs.select(
        F.col(doc_id).alias("_doc_id"), F.col(source).cast("string").alias("_source"), length_of(F.col(text)).alias("_size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), *kept).alias("_ticket"),
        *[F.col(f"`{c}`").alias(f"_kept_{c}") for c in keep],
    )
    rows = stored(read.withColumn("_key", key), "sizes")
    slim = rows.select("_key", "_size", "_ticket")
    counts = stored(slim.groupBy("_key", "_size").agg(F.count("*").alias("n")), "lengths").select(
        F.col("_key").alias("key"), F.col("_size").alias("size"), "n"
    )
    of_source = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()
    of_source.sort(key=lambda r: (r["key"]["last"], r["key"]["name"].encode()))
    aims = targets([r["words"] for r in of_source], weights, share)
    aim_rows = [((r["key"]["last"], r["key"]["name"]), r["words"], a) for r, a in zip(of_source, aims)]
    goal = stored(
        spark.createDataFrame(aim_rows, "key struct<last:boolean,name:string>, source_size long, target double"), "targets"
    )
    plan = stored(
        counts.join(goal, "key").groupBy("key").applyInArrow(
            _plan, "key struct<last:boolean,name:string>, size long, n long, whole long, extra long"
        ),
        "copies-by-length",
    )
    # The cut lies in one slice of the tickets of a length; slices below it are taken whole.
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / SLICE_ROWS)).cast("long")
    slice_of = F.pmod(F.col("_ticket"), slices)
    part = plan.where("extra > 0 and extra < n").select("key", "size", "n", "extra")
    cut = [F.col("_key") == F.col("key"), F.col("_size") == F.col("size")]
    sliced = slim.join(part, cut).withColumn("slice", slice_of)
    per_slice = sliced.groupBy("key", "size", "slice").agg(F.count("*").alias("m"), F.first("extra").alias("extra"))
    before = F.sum("m").over(
        Window.partitionBy("key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = per_slice.withColumn("before", F.coalesce(before, F.lit(0)))
    edge = placed.where("before < extra and before + m >= extra").select(
        F.col("key").alias("e_key"),
        F.col("size").alias("e_size"),
        F.col("slice").alias("last_slice"),
        (F.col("extra") - F.col("before")).alias("inside"),
    )
    here = [F.col("key") == F.col("e_key"), F.col("size") == F.col("e_size"), F.col("slice") == F.col("last_slice")]
    # Rows of one ticket are equal; they count before they move, and the cut may lie among them.
    tickets = sliced.join(edge, here).groupBy("key", "size", "last_slice", "_ticket").agg(
        F.count("*").alias("alike"), F.first("inside").alias("inside")
    )
    upto = F.sum("alike").over(
        Window.partitionBy("key", "size").orderBy("_ticket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    marks = (
        tickets.withColumn("upto", upto)
        .where("upto >= inside and upto - alike < inside")
        .select(
            "key", "size", "last_slice", F.col("_ticket").alias("last_ticket"), "alike",
            (F.col("inside") - F.col("upto") + F.col("alike")).alias("due"),
        )
    )
    table = stored(
        plan.join(marks, ["key", "size"], "left").join(goal, "key").select(
            "key", "size", "n", "whole", "extra", "last_slice", "last_ticket", "alike", "due", "source_size", "target"
        ),
        "cuts",
    )
    mine, last = F.pmod(F.col("_ticket"), slices), F.col("last_slice")
    taken = (mine < last) | ((mine == last) & (F.col("_ticket") <= F.col("last_ticket")))
    once_more = (
        F.when(F.col("extra") == F.col("n"), 1).when(F.col("extra") == 0, 0).when(taken, 1).otherwise(0)
    )
    split = (F.col("due") < F.col("alike")) & (mine == last) & (F.col("_ticket") == F.col("last_ticket"))
    names = {"doc_id": "_doc_id", "size": "_size", "source_size": "source_size", "target": "target"}
    also = {c: f"_kept_{c}" for c in keep}
    joined = rows.join(table, cut)

    def told(df: DataFrame, copies: Column) -> DataFrame:
        parts = [F.col(f"`{c}`").alias(n) for n, c in names.items()]
        return df.select(*parts, copies.alias("copies"), *[F.col(f"`{c}`").alias(n) for n, c in also.items()])

    if table.where("due < alike").isEmpty():
        return told(joined, F.col("whole") + once_more)
    plain = told(joined.where(~F.coalesce(split, F.lit(False))), F.col("whole") + once_more)
    return plain.unionByName(told(_dealt(joined.where(split), [*names.values(), *also.values()]), F.col("whole") + F.col("more")))


def _dealt(alike: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Equal rows again, ``due`` of each set with ``more`` 1 and the others with 0.

    A set moves as one row with its number of copies and is written out in
    pieces of ``SLICE_ROWS``, spread over all tasks.
    """
    sets = alike.groupBy(*[F.col(f"`{c}`") for c in columns], "_ticket", "whole", "alike", "due").agg(F.count("*").alias("m"))
    # Different rows of one ticket, a clash of hashes, take from what is due in order.
    order = Window.partitionBy(F.col("_ticket"), F.col("_size"), F.col("source_size")).orderBy(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in columns]))
    earlier = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.least(F.col("m"), F.greatest(F.lit(0), F.col("due") - F.col("before"))).cast("long")
    halves = F.array(
        F.struct(share.alias("rows"), F.lit(1).alias("more")),
        F.struct((F.col("m") - share).alias("rows"), F.lit(0).alias("more")),
    )
    each = sets.withColumn("before", earlier).select("*", F.inline(halves)).where("rows > 0")
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / SLICE_ROWS))
    spread = each.withColumn("piece", F.explode(pieces)).repartition(F.col("_ticket"), F.col("more"), F.col("piece"))
    here = F.least(F.lit(SLICE_ROWS), F.col("rows") - F.col("piece") * SLICE_ROWS).cast("int")
    return spread.withColumn("_again", F.explode(F.array_repeat(F.lit(0), here)))


def mix_report(mixed: DataFrame, *also: str) -> DataFrame:
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, *also)

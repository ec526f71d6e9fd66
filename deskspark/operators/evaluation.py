"""A whole evaluation from one pass over the predictions.

Accuracy, F1, confusion, calibration, billing and the sketch of the latencies
are all sums over rows, so they are taken together: grouping sets give the
confusion cells, the calibration bins and the latency codes from one scan, and
each task sends at most classes x classes + bins + codes rows per model. Every
table is derived from those few rows, in one task while they are small; exact
latency percentiles count the latencies near them in one more pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.functions.teacher import token_cost
from deskspark.operators import cost, metrics
from deskspark.operators.calibration import DEFAULT_BINS, confidence_bin
from deskspark.operators.prefix import exact_percentiles, percentiles_by_code, value_code
from deskspark.operators.sizes import computed_small
from deskspark.operators.thresholds import routing_stats
from deskspark.sources.latency import IN_PROCESS, with_latency_source

_SUMS = ("conf", "latency_ms", "input_tokens", "output_tokens", "top_5_hit")


def evaluation_cells(
    df: DataFrame, by: Sequence[str] = ("model",), n_bins: int = DEFAULT_BINS
) -> DataFrame:
    """Counts and sums per (group, label, pred), per (group, bin) and per (group, latency code).

    ``df`` has ``label, pred, conf, latency_ms`` and, for a token-billed model,
    ``input_tokens, output_tokens``, and for models with scores ``top_5_hit``
    (null elsewhere). ``kind`` tells the rows apart: ``cell``, ``bin`` or
    ``code``.
    """
    by = list(by)
    sums = [c for c in _SUMS if c in df.columns]
    binned = df.select(
        *by,
        "label",
        "pred",
        confidence_bin(F.col("conf"), n_bins).alias("bin"),
        (F.col("label") == F.col("pred")).cast("long").alias("hit"),
        value_code(F.col("latency_ms").cast("double")).alias("_code"),
        *sums,
    )
    sets = [[F.col(c) for c in [*by, *more]] for more in (("label", "pred"), ("bin",), ("_code",))]
    kind = F.when(F.grouping("bin") == 0, "bin").when(F.grouping("_code") == 0, "code").otherwise("cell")
    return binned.groupingSets(sets, *by, "label", "pred", "bin", "_code").agg(
        kind.alias("kind"),
        F.count("*").alias("n"),
        F.sum("hit").alias("hits"),
        *[F.sum(c).alias(f"{c}_sum") for c in sums],
    )


def stored_cells(
    df: DataFrame, by: Sequence[str] = ("model",), n_bins: int = DEFAULT_BINS
) -> DataFrame:
    """Cells computed at once, so that the tables made from them scan nothing twice."""
    return computed_small(evaluation_cells(df, by, n_bins))


def cell_counts(cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Confusion counts out of evaluation cells."""
    return cells.where("kind = 'cell'").select(*by, "label", "pred", "n")


def cell_scores(cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Top-1 accuracy and calibration error out of evaluation cells."""
    gap = F.abs(F.col("conf_sum") - F.col("hits"))
    more = [(F.sum("top_5_hit_sum") / F.sum("n")).alias("top_5_accuracy")] if "top_5_hit_sum" in cells.columns else []
    return (
        cells.where("kind = 'bin'")
        .groupBy(*by)
        .agg(
            (F.sum("hits") / F.sum("n")).alias("top_1_accuracy"),
            *more,
            (F.sum(gap) / F.sum("n")).alias("ece"),
            F.sum("n").alias("n"),
        )
    )


def cell_costs(
    cells: DataFrame,
    by: Sequence[str] = ("model",),
    vcpu: float = cost.SERVING_VCPU,
    memory_gib: float = cost.SERVING_MEMORY_GIB,
    serving_rates: Mapping[str, float] = cost.SERVING_RATES,
    token_rates: Mapping[str, float] = cost.TEACHER_RATES,
) -> DataFrame:
    """Cost per thousand: by tokens where a group has them, else by serving time."""
    n = F.sum("n")
    seconds = F.sum("latency_ms_sum") / 1000.0
    per_second = (
        vcpu * serving_rates["usd_per_vcpu_second"]
        + memory_gib * serving_rates["usd_per_gib_second"]
    )
    dollars = seconds * per_second + n * (serving_rates["usd_per_million_requests"] / 1e6)
    if "input_tokens_sum" in cells.columns:
        tokens = token_cost(F.sum("input_tokens_sum"), F.sum("output_tokens_sum"), token_rates)
        dollars = F.coalesce(tokens, dollars)
    bins = cells.where("kind = 'bin'")
    return bins.groupBy(*by).agg((dollars / n * 1000.0).alias("cost_per_1k_usd"))


def cell_percentiles(
    cells: DataFrame, df: DataFrame, fractions: dict[str, float], by: Sequence[str] = ("model",)
) -> DataFrame:
    """Exact latency percentiles of the rows the cells were made of, from their codes and one more pass."""
    codes = cells.where("kind = 'code' AND _code IS NOT NULL").select(*by, "_code", F.col("n").alias("_n"))
    return percentiles_by_code(df, codes, "latency_ms", fractions, by)


def _join_groups(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Join tables with one row per group; merged, those in one partition need no exchange."""
    whole = parts[0]
    for part in parts[1:]:
        of = part.withColumnsRenamed({c: f"_of_{c}" for c in by})
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
        whole = whole.join(of.hint("merge"), same).drop(*[f"_of_{c}" for c in by])
    return whole


def headline(
    df: DataFrame, classes: DataFrame, by: Sequence[str] = ("model",), n_bins: int = DEFAULT_BINS
) -> DataFrame:
    """One row per model: top-1, macro F1, calibration error, P95 latency, cost."""
    cells = stored_cells(df, by, n_bins)
    counts = cell_counts(cells, by)
    return _join_groups(
        [
            cell_scores(cells, by),
            metrics.macro_f1(counts, classes, by),
            cell_percentiles(cells, df, {"latency_ms_p95": 0.95}, by),
            cell_costs(cells, by),
        ],
        by,
    )


def evaluation_tables(
    df: DataFrame,
    classes: DataFrame,
    by: Sequence[str] = ("model",),
    n_bins: int = DEFAULT_BINS,
    top_pairs: int = 20,
    load_test: DataFrame | None = None,
    limits: DataFrame | None = None,
    target: float | None = None,
    pricing_date: str = cost.PRICING_DATE,
) -> dict[str, DataFrame]:
    """The tables of a results document, one per metric family.

    ``load_test`` (``model, latency_ms``) takes the place of a model's own
    latencies; with it ``by`` is the model. ``limits`` are routing thresholds
    fitted on other rows for ``target``; they add the threshold block.
    """
    by = list(by)
    cells = stored_cells(df, by, n_bins)
    counts = cell_counts(cells, by)
    percentiles = {f"latency_ms_{p}": q for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}
    if load_test is None:
        latencies = cell_percentiles(cells, df, percentiles, by).withColumn("latency_source", F.lit(IN_PROCESS))
    else:
        timed = with_latency_source(df, load_test).select(*by, "latency_source", "latency_ms")
        latencies = exact_percentiles(timed, "latency_ms", percentiles, [*by, "latency_source"])
    n_classes = classes.select("label_id").distinct().agg(F.count("*")).scalar()
    tables = {
        "metrics": _join_groups(
            [
                cell_scores(cells, by).withColumn("n_classes", n_classes),
                metrics.macro_f1(counts, classes, by),
                latencies,
                cell_costs(cells, by),
            ],
            by,
        ),
        "per_class": metrics.per_class_metrics(counts, classes, by),
        "top_confusion_pairs": metrics.top_confusion_pairs(counts, classes, top_pairs, by),
        "cost_summary": cost.cost_breakdown(cell_costs(cells, by), pricing_date=pricing_date),
    }
    if limits is not None:
        routed = routing_stats(df, limits, by)
        tables["thresholds"] = routed.withColumn("target_precision", F.lit(target).cast("double"))
    return tables


def nested(tables: Mapping[str, DataFrame]) -> Column:
    """The tables as one struct of arrays, for writing a single document.

    Each table is class-sized, so the document is as well.
    """
    parts = []
    for name, table in tables.items():
        rows = table.agg(F.collect_list(F.struct(*table.columns)).alias(name))
        parts.append(rows.scalar().alias(name))
    return F.struct(*parts)

"""Dated price sheets: the date and all rates arrive together, as one row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from deskspark.operators.cost import PRICING_DATE, SERVING_RATES, TEACHER_RATES


@dataclass(frozen=True)
class PriceSheet:
    """Rates and the date they hold for."""

    pricing_date: str
    teacher: dict[str, float]
    serving: dict[str, float]


DEFAULT_PRICES = PriceSheet(PRICING_DATE, TEACHER_RATES, SERVING_RATES)


def read_prices(spark: SparkSession, path: str) -> PriceSheet:
    """The one JSON row of a price sheet; a missing date or rate is an error."""
    names = [*TEACHER_RATES, *SERVING_RATES]
    schema = ", ".join(["pricing_date string", *[f"{n} double" for n in names]])
    rows = spark.read.schema(schema).option("multiLine", True).json(path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: a price sheet has one row")
    missing = [n for n, v in rows[0].asDict().items() if v is None]
    if missing:
        raise ValueError(f"{path}: no value for {', '.join(missing)}")
    row = rows[0]
    return PriceSheet(
        row["pricing_date"], {n: row[n] for n in TEACHER_RATES}, {n: row[n] for n in SERVING_RATES}
    )

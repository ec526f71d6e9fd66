"""Intermediate tables that are read several times, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from deskspark.session import run_folder
from deskspark.sources.files import located

#: A stored table of at most so many bytes may be read by one task.
SMALL_BYTES = 32 << 20


def computed_now(df: DataFrame) -> DataFrame:
    """The result of running ``df`` once, as a table in the shared folder.

    Lineage ends there. The planner knows the table's bytes, so it broadcasts
    the table in a join exactly if they are within the session's limit.
    """
    path = run_folder(df.sparkSession, "computed")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed_small(df: DataFrame) -> DataFrame:
    """``computed_now`` for tables that are small as a rule: one partition if the stored bytes allow it.

    What is made of one partition by grouping, ranking or joining needs no
    exchange, each of which would be a job. A table beyond ``SMALL_BYTES`` stays
    spread, and the same plans then move its rows.
    """
    path = run_folder(df.sparkSession, "computed")
    df.write.parquet(path)
    files, location = located(df.sparkSession, path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return table.coalesce(1) if files.getContentSummary(location).getLength() <= SMALL_BYTES else table

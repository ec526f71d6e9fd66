"""Tables stored by hash of a key, so that joins on the key move no rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def write_bucketed(df: DataFrame, table: str, path: str, by: Sequence[str], buckets: int) -> DataFrame:
    """Store ``df`` below ``path`` in ``buckets`` parts by hash of ``by``, each sorted by it, as ``table``.

    Rows move once, to their part, so that each part is one file. Two tables of
    the same keys and number of parts join without an exchange of rows.
    """
    parts = df.repartition(buckets, *by)
    writer = parts.write.format("parquet").bucketBy(buckets, *by).sortBy(*by)
    writer.option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def open_bucketed(
    spark: SparkSession, table: str, path: str, schema: StructType, by: Sequence[str], buckets: int
) -> DataFrame:
    """A table that ``write_bucketed`` stored in another session, known to this one's catalog again."""
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    keys = ", ".join(map(_quoted, by))
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {_quoted(table)} ({columns}) USING parquet "
        f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(table)

"""Tables that are folders of files and numbered lists of the folders that count.

A writer puts its rows into a folder of its own and then publishes a list that
names it. Lists are never changed: the next one has the next number, and the
last one is the table. A folder no list names, as a killed job leaves it, is not
part of the table. Two writers that publish the same number meet at the rename,
which one of them loses; it looks at what the other added and tries again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from deskspark.sources.files import located, names_in

LISTS, DATA = "lists", "data"


@dataclass(frozen=True)
class Version:
    """The folders that count as of a number; number 0 is the empty table."""

    number: int
    parts: tuple[str, ...]


def latest(spark: SparkSession, path: str) -> Version:
    """The newest list; one folder listing and one small file, whatever the table holds."""
    numbers = [int(n) for n in names_in(spark, f"{path}/{LISTS}") if n.isdecimal()]
    if not numbers:
        return Version(0, ())
    told = spark.read.text(f"{path}/{LISTS}/{max(numbers):010d}", wholetext=True).first()[0]
    return Version(max(numbers), tuple(json.loads(told)["parts"]))


def publish(spark: SparkSession, path: str, after: Version, parts: tuple[str, ...]) -> Version | None:
    """Make ``parts`` the table, if ``after`` is still its newest list; else ``None``.

    The list is written aside and renamed, so readers see all of it or nothing.
    Renaming never replaces a file.
    """
    files, folder = located(spark, f"{path}/{LISTS}")
    files.mkdirs(folder)
    _, aside = located(spark, f"{path}/{LISTS}/.{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(json.dumps({"parts": list(parts)}).encode())
    out.close()
    _, place = located(spark, f"{path}/{LISTS}/{after.number + 1:010d}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark._jsc.hadoopConfiguration()
    )
    plain = spark._jvm.org.apache.hadoop.fs.Options.Rename
    try:
        context.rename(aside, place, spark.sparkContext._gateway.new_array(plain, 0))
    except Exception:
        if not files.exists(place):
            raise
        files.delete(aside, False)
        return None
    return Version(after.number + 1, tuple(parts))


def new_part(df: DataFrame, path: str) -> str:
    """Rows written to a folder that no list names yet."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/{DATA}/{name}")
    return name


def read_parts(spark: SparkSession, path: str, schema: StructType, parts: tuple[str, ...]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{DATA}/{p}" for p in parts])


def remove_unlisted(spark: SparkSession, path: str, older_than_ms: int) -> int:
    """Delete folders that the newest list does not name and nothing has touched for a time; how many.

    The time must exceed the longest write and the longest read of an earlier list.
    """
    files, folder = located(spark, f"{path}/{DATA}")
    if not files.exists(folder):
        return 0
    # Folders first: one that is published in between is then seen in the list.
    found = [(s.getPath(), s.getModificationTime()) for s in files.listStatus(folder)]
    listed = set(latest(spark, path).parts)
    now = spark._jvm.java.lang.System.currentTimeMillis()
    gone = [p for p, at in found if p.getName() not in listed and now - at >= older_than_ms]
    for p in gone:
        files.delete(p, True)
    return len(gone)

"""From raw documents to a training mix, as five stages with a stored table between any two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.llm import decontaminate, mixing, quality_rules, secrets, simhash
from deskspark.llm.stored import stored

#: Fingerprints and the fitted log ratios have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


#: Bits in which fingerprints of near copies may differ. More bits find more near copies, but deal
#: several times as many copies of each fingerprint; README has figures for 6.
NEAR_BITS = 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(docs: DataFrame) -> Column:
    """The whole row as one column, so that no name of a document's column meets one of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents' own columns out of ``row``."""
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def keep_good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and read like the trusted ones; the rest goes.

    Null, empty and short texts fail the base rules. Repeated rows are judged
    alike. An empty table stays empty; columns keep their names and values,
    whatever they are called.
    """
    plain = docs.select(*[F.col(f"`{c}`").alias(c) for c in ("doc_id", "text")], _row(docs))
    judged = quality_rules.judge(plain, _table(spark, sf_dir, "labels"), keep_columns=True)
    return _columns(judged.select("row"), docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    A document without an id goes by a hash of its text, after all that have
    one; so does an id that is no whole number, by a hash of id and text. Rows of
    one id and text are one document; different texts of one id are documents of
    their own, and the smaller hash of the text comes first. Null and empty texts
    are near copies of each other. An empty table stays empty; columns keep their
    names and values.
    """
    told = F.col("doc_id").cast("string")
    hashed = F.xxhash64(told, "text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    by_id = F.coalesce(F.expr("try_cast(doc_id AS long)"), hashed).alias("id")
    # With the text's hash in it, a group's smallest key names no other group's document.
    keyed = docs.select(F.struct(by_id, F.xxhash64("text").alias("text")).alias("key"), F.col("text").alias("text"), _row(docs))
    groups = stored(simhash.near_duplicates(keyed, doc_id="key", bits=NEAR_BITS), "near-groups")
    later = stored(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("later")).distinct(), "later")
    counts = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    several = stored(counts.select(F.col("doc_id").alias("several")), "repeated-ids")
    # Both lists are stored, so the planner knows their bytes and moves texts only if a list is large.
    first = keyed.join(later, F.col("key") == F.col("later"), "left_anti")
    single = first.join(several, F.col("key") == F.col("several"), "left_anti")
    repeated = first.join(several, F.col("key") == F.col("several"), "left_semi").dropDuplicates(["key"])
    return _columns(single.unionByName(repeated).select("row"), docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts and texts without words hold no window and stay, as all
    do if there are no items. Repeated rows are judged alike. An empty table stays
    empty; columns keep their names and values.
    """
    found = decontaminate.find_benchmark_text(docs, _table(spark, sf_dir, "benchmark"), keep_rows=True)
    return _columns(found.where(F.size("items") == 0), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every character of a secret masked; lengths stay as they are.

    Null texts stay null, empty ones empty. Repeated rows are masked alike. An
    empty table stays empty; all other columns keep their names and values.
    """
    found = secrets.find_secrets(docs, keep_rows=True)
    text = secrets.masked(F.col("row.text"), F.col("spans")).alias("text")
    return found.select(*[text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document enters the mix, and the words it adds.

    Documents without words add none; a null source is a source of its own, and
    equal rows may differ by one copy where the target lies between them. An empty
    table gives an empty one; columns other than id, text and source are left out.
    """
    mixed = mixing.mix_sources(docs, keep=["source"])
    return mixing.mix_report(mixed, "source", "copies")


STAGES = [
    ("quality rules", keep_good_text),
    ("near-dedup", keep_one_of_each),
    ("decontamination", drop_benchmark_text),
    ("secret scan", mask_secrets),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage reads the stored result of the one before."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Redaction over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.functions import redact as R


def redact_messages(df: DataFrame, salt: bytes, text: str = "text") -> DataFrame:
    """Add ``redacted_text`` and ``spans``.

    A one-element generator keeps the redaction from being inlined, and so run,
    once per use of its two columns.
    """
    both = F.array(F.coalesce(R.redact(F.col(text), salt), F.lit(None).cast(R.REDACTION)))
    return df.select("*", F.inline(both))


def candidate_spans(df: DataFrame, kind: str, salt: bytes, text: str = "text") -> DataFrame:
    """One row per match of ``kind`` before overlaps between kinds are resolved."""
    found = R.pii_candidates(F.col(text), kind)
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.explode(found).alias("m")).select(
        *others,
        F.col("m")["span_start"].alias("span_start"),
        F.col("m")["span_end"].alias("span_end"),
        R.salted_hash(salt, F.col("m")["raw"]).alias("original_hash"),
    )


def redaction_spans(df: DataFrame, salt: bytes, text: str = "text") -> DataFrame:
    """One row per accepted span."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.inline(R.redact(F.col(text), salt)["spans"]))


def pii_profile(df: DataFrame, salt: bytes, text: str = "text") -> DataFrame:
    """Spans and texts hit per kind.

    Spans are counted per text first, so what is shuffled is four rows per task.
    """

    def spans_of(kind: str) -> Column:
        mine = F.filter("spans", lambda s: s["kind"] == kind)
        return F.struct(F.lit(kind).alias("kind"), F.size(mine).cast("long").alias("n"))

    per_kind = F.array(*[spans_of(k) for k in R.KINDS])
    counted = redact_messages(df.select(text), salt, text).select(F.inline(per_kind))
    return counted.groupBy("kind").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_spans"), F.count_if(F.col("n") > 0).alias("n_texts")
    )

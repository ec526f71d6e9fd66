"""One query per operator over the shared test tables; ``oracles`` says some of them in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.llm import (
    clusters,
    decontaminate,
    fill_middle,
    language,
    mixing,
    pair_bytes,
    quality,
    quality_rules,
    secrets,
    simhash,
    suffix_dedup,
    toxicity,
    warc,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_benchmark_text(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    )
    return decontaminate.contamination(found)


def _fold(parts: int) -> Column:
    """The remainder of an id's hash; a null id counts as an empty text, whose remainder is 0."""
    told = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(told.cast("binary")), F.lit(parts))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    profiles = language.learn_profiles(docs.where(_fold(5) != 0), "text", "lang")
    return language.identify(docs, profiles).select(
        "doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score"
    )


def _judged(scores: DataFrame, held_out: Column, at: float) -> DataFrame:
    return scores.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted")
    )


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    vectors, network = quality.learn_quality(docs, labels.where(_fold(5) != 0))
    return _judged(quality.score_quality(docs, vectors, network), _fold(5) == 0, quality.PREDICT_AT)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    lexicon = toxicity.learn_lexicon(docs, labels.where(_fold(4) != 2))
    return _judged(toxicity.score_toxicity(docs, lexicon), _fold(4) == 2, toxicity.PREDICT_AT)


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archive_pages(_table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(mixing.mix_sources(_table(spark, folder, "documents")))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removal_report(suffix_dedup.drop_repeats(_table(spark, folder, "documents")))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_counts(secrets.find_secrets(_table(spark, folder, "documents")))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op11_clusters(spark: SparkSession, folder: str) -> DataFrame:
    placed, centroids = clusters.cluster_vectors(_table(spark, folder, "embeddings"))
    return clusters.cluster_report(spark, placed, centroids)


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.rearranged_digest(fill_middle.rearrange_texts(_table(spark, folder, "documents")))


def op13_bpe(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    coded = pair_bytes.encode_texts(_table(spark, folder, "documents"), tokenizer)
    return pair_bytes.token_digest(pair_bytes.decode_ids(coded, tokenizer))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_language,
        op3_quality,
        op4_toxicity,
        op5_warc,
        op6_quality_rules,
        op7_mixing,
        op8_suffix_dedup,
        op9_secrets,
        op10_simhash,
        op11_clusters,
        op12_fill_middle,
        op13_bpe,
    )
}

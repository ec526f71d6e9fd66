"""Quality rules: counts per text, and a hashed n-gram log-likelihood ratio against a trusted corpus.

Words and word pairs are hashed into buckets. Two multinomials over the buckets
are counted, one from trusted documents and one from all, and a document's
score is the mean log ratio over its n-grams. Everything is a column
expression; texts are never shuffled.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the base rules.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
NOT_SPACES = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"

#: Buckets of the two multinomials: the table of ratios has this size, whatever the corpus.
BUCKETS = 1 << 16
#: Prior counts per bucket, on average.
SMOOTHING = 1.0
#: Documents whose mean log ratio per n-gram is below this are rejected.
THRESHOLD = -0.15
#: Labelled documents from which the trusted multinomial is counted, at most.
TRUSTED_ROWS = 50_000


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text; none if it is null or all space."""
    told = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(told == "", F.array().cast("array<string>")).otherwise(F.split(told, SPACES))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words in windows of ``window`` words that occur twice or more, the first included.

    ``words`` are the hashes of the words, windows are compared by a 64-bit hash of those. Only texts with an equal pair are
    sorted; the cost is n log n for any text.
    """
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.xxhash64(F.slice(words, i, window))
    )

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_ranked(r: Column) -> Column:
            def again(x: Column, i: Column) -> Column:
                before = F.get(r, i - 1)["h"].eqNullSafe(x["h"]) & (i > 0)
                return before | F.get(r, i + 1)["h"].eqNullSafe(x["h"])

            places = F.array_sort(F.transform(F.filter(r, again), lambda x: x["i"]))
            return _let(
                places,
                lambda p: F.aggregate(
                    F.transform(
                        p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(window)), F.lit(window))
                    ),
                    F.lit(0).cast("long"),
                    lambda total, n: total + n,
                ),
            )

        found = _let(ranked, of_ranked)
        return F.when(F.size(F.array_distinct(h)) < F.size(h), found).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > window, _let(hashes, covered)).otherwise(F.lit(0).cast("long"))


def base_counts(text: Column, words: Column) -> dict[str, Column]:
    """The base columns of a text and its words' hashes."""
    told = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(told, "\n"), lambda x: x.rlike(NOT_SPACES))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(told, SPACES, "")).cast("long"),
        "n_symbols": F.regexp_count(told, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(words),
    }


def _buckets(words: Column) -> Column:
    """Buckets of all words and of all pairs of neighbours, from the words' hashes."""

    def bucket(x: Column) -> Column:
        return F.pmod(x, F.lit(BUCKETS)).cast("int")

    firsts = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.transform(firsts, lambda x, i: bucket(F.xxhash64(x, F.get(words, i + 1))))
    return F.concat(F.transform(words, bucket), pairs)


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``bucket, ratio``: the log ratio of trusted to raw frequency, for each bucket that occurs.

    All documents count into the raw multinomial, those whose id is among the
    (bounded) ``trusted_ids`` also into the trusted one. N-grams are summed
    before the only shuffle, which holds at most ``BUCKETS`` rows per task.
    """
    # Compared as text, so that ids of another kind than the labels' are no error.
    trusted = F.broadcast(trusted_ids.select(F.col(trusted_ids.columns[0]).cast("string").alias("_trusted_id")).distinct())
    rows = docs.select(F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("_text"))
    marked = rows.join(trusted, F.col("_id") == F.col("_trusted_id"), "left")
    grams = marked.select(
        F.col("_trusted_id").isNotNull().alias("trusted"), F.explode(_let(_hashes(words_of(F.col("_text"))), _buckets)).alias("bucket")
    )
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("aim"))
    # Prior counts of the trusted multinomial follow the raw one, so a small corpus
    # pulls all ratios towards 0 instead of favouring what few documents hold.
    prior, weight = F.lit(SMOOTHING * BUCKETS), F.col("aim") * F.col("raws") / F.col("raw")
    whole = Window.partitionBy()  # over ``BUCKETS`` rows at most
    ratio = F.log((weight + prior) / (F.col("aims") + prior)).cast("float")
    summed = counts.select("*", F.sum("raw").over(whole).alias("raws"), F.sum("aim").over(whole).alias("aims"))
    return summed.select("bucket", ratio.alias("ratio"))


def trusted_sample(labels: DataFrame, rows: int = TRUSTED_ROWS, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Ids of at most ``rows`` documents labelled good, those with the smallest hashes."""
    good = labels.where(F.col(quality) == 1).where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"))
    return good.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    keep_columns: bool = False,
) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``log_ratio`` and ``kept`` for every row.

    A null text has no words and fails the base rules, as does any text of
    under ``MIN_WORDS`` words; ``log_ratio`` is 0 without n-grams. Equal texts
    get equal verdicts, repeated rows each count, other columns are ignored (or
    carried along with ``keep_columns``), an empty table gives an empty one.
    The lowest ratio is ``log(prior / (prior + trusted n-grams))``: with fewer
    than about 10,600 trusted n-grams (at -0.15) it rejects nothing and the base
    rules decide alone, of which a warning tells.
    """
    # One value per bucket, a fixed number: folded into the plan as a literal array.
    told = ["0"] * BUCKETS
    ratios = log_ratios(docs, trusted_sample(labels), doc_id, text).collect()
    for row in ratios:
        told[row["bucket"]] = f"{row['ratio']:.6g}"
    if ratios and min(row["ratio"] for row in ratios) >= threshold:
        warnings.warn(f"too few trusted n-grams for a log ratio below {threshold}: only the base rules reject", stacklevel=2)
    body, table = F.col(text), F.split(F.lit(",".join(told)), ",").cast("array<float>")

    def measured(words: Column) -> Column:
        def mean(b: Column) -> Column:
            total = F.aggregate(b, F.lit(0.0), lambda s, x: s + F.get(table, x))
            return F.when(F.size(b) > 0, total / F.size(b)).otherwise(F.lit(0.0))

        counts = [v.alias(k) for k, v in base_counts(body, words).items()]
        return F.struct(*counts, _let(_buckets(words), mean).alias("log_ratio"))

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio"]
    kept = docs.columns if keep_columns else [doc_id]
    rows = docs.select(*kept, F.inline(F.array(_let(_hashes(words_of(body)), measured))).alias(*[f"_{n}" for n in names]))
    failed = (F.col("_n_words") < MIN_WORDS) | (
        F.col("_n_repeat_words") * 100 > F.col("_n_words") * MAX_REPEAT_PERCENT
    )
    if keep_columns:
        return rows.where(~failed & (F.col("_log_ratio") >= threshold)).select(*docs.columns)
    return rows.select(
        F.col(doc_id).alias("doc_id"),
        *[F.col(f"_{n}").alias(n) for n in names],
        failed.alias("base_failed"),
        (~failed & (F.col("_log_ratio") >= threshold)).alias("kept"),
    )

"""Toxicity by a weighted lexicon, found with Aho-Corasick in folded texts.

Folding maps look-alike letters, accents and digits standing for letters to
plain letters, and everything else to single spaces. Lexicon entries are whole
words or stems; a match inside an exception phrase does not count. Weights and
exceptions are learned from labels, and the weight of a text, plain and by its
length, gives a probability.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm.arrow_text import batch_of, map_batches
from deskspark.llm.samples import labelled_sample
from deskspark.llm.stored import stored

#: Labelled rows the lexicon is learned from, at most.
SAMPLE_ROWS = 20_000
MIN_DOCS = 5
MIN_WEIGHT = 2.5
STEM_CHARS = range(3, 8)
#: A stem is an entry of its own if it is in so many times the documents of any one continuation.
STEM_GAIN = 1.5
PREDICT_AT = 0.3
#: A phrase in clean documents alone is harmless if that many from the sample are so by chance this rarely.
EXCEPTION_CHANCE = 0.05
#: Clean documents an exception phrase needs in any case.
EXCEPTION_DOCS = 3
#: Counts a task holds before it sends them on; Spark adds them up.
HELD_COUNTS = 200_000

# Letters that look like another, digits and signs in place of letters, sayings without offence.
LOOKALIKES = dict(zip("аеорсхуіѕјкмтнвԁαοεικνρτυχ", "aeopcxyisjkmthbdaoeikvptux"))
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
HIDDEN = "­​‌‍⁠﻿"
SAYINGS = ("trash can", "trash bin", "sore loser", "clown fish", "pond scum")


class _Fold(dict):
    """A translation table that fills itself: letters fold, the rest is space."""

    def __missing__(self, point: int) -> str:
        char = chr(point)
        plain = unicodedata.normalize("NFKD", char)
        plain = "".join(LOOKALIKES.get(c, c) for c in plain if not unicodedata.combining(c)).lower()
        told = STAND_INS.get(char) or ("" if char in HIDDEN else plain if plain.isalpha() else " ")
        self[point] = told
        return told


_FOLD = _Fold()


def folded(text: str | None) -> str:
    """Words of a text as compared, one space around each."""
    words = (text or "").lower().translate(_FOLD).split()
    return f" {' '.join(words)} " if words else " "


@dataclass
class Lexicon:
    """Weights by entry: `` word `` or `` stem`` as it stands in a folded text."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slopes: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 1.0]))

    def __post_init__(self) -> None:
        self._found = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_found": None}

    @property
    def automaton(self) -> ahocorasick.Automaton | None:
        if self._found is None and self.weights:
            found = ahocorasick.Automaton()
            entries = {e: w for e, w in self.weights.items()}
            for phrase in {folded(p) for p in self.exceptions} - {" "}:
                found.add_word(phrase, (len(phrase), entries.get(phrase, 0.0), True))
            for entry, weight in entries.items():
                if entry not in found:
                    found.add_word(entry, (len(entry), weight, False))
            found.make_automaton()
            self._found = found
        return self._found

    def hits(self, told: str) -> list[tuple[int, int, float]]:
        """``(start, end, weight)`` of counting matches in a folded text."""
        if self.automaton is None:
            return []
        found = [(end + 1 - n, end + 1, w, spared) for end, (n, w, spared) in self.automaton.iter(told)]
        spared = sorted((s, e) for s, e, _, x in found if x)
        hits = [(s, e, w) for s, e, w, x in found if not x]
        if spared:
            # The furthest end of all phrases that begin no later than a hit decides.
            starts, ends = [s for s, _ in spared], list(accumulate((e for _, e in spared), max))
            places = ((h, bisect_right(starts, h[0])) for h in hits)
            hits = [h for h, at in places if not at or ends[at - 1] < h[1]]
        return hits

    def measures(self, told: str, hits: Sequence[tuple[int, int, float]] | None = None) -> tuple[float, float]:
        """Log of the weight found, and of the weight per hundred words."""
        total = sum(w for _, _, w in (self.hits(told) if hits is None else hits))
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, told.count(" ") - 1)))

    def score(self, told: str, hits: Sequence[tuple[int, int, float]] | None = None) -> float:
        x = self.slopes @ np.array([1.0, *self.measures(told, hits)])
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def entries_of(told: str) -> set[str]:
    """All words and stems of a folded text."""
    words = set(told.split())
    out = {f" {w} " for w in words}
    out.update(f" {w[:n]}" for w in words for n in STEM_CHARS if len(w) > n)
    return out


def best_continuations(toxic: dict[str, int]) -> Counter:
    """For each stem, the toxic documents of the entry most frequent among those that go on from it."""
    best: Counter = Counter()
    for entry, n in toxic.items():
        stem = entry.rstrip(" ")
        for cut in range(2, len(stem)):
            best[stem[:cut]] = max(best[stem[:cut]], n)
        if entry.endswith(" "):
            best[stem] = max(best[stem], n)
    return best


def choose_entries(
    toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, best: dict[str, int] | None = None
) -> dict[str, float]:
    """Entries far more frequent in toxic documents; stems only where they join several words.

    ``best`` has the best continuations if ``toxic`` does not hold all entries.
    """
    best = best_continuations(toxic) if best is None else best
    weights = {}
    for entry, n in toxic.items():
        weight = np.log((n + 0.5) / (n_toxic + 1)) - np.log((clean.get(entry, 0) + 0.5) / (n_clean + 1))
        if n >= MIN_DOCS and weight >= MIN_WEIGHT:
            if entry.endswith(" ") or n >= STEM_GAIN * best[entry]:
                weights[entry] = float(weight)
    # A word that has a chosen stem counts by its stem.
    stems = {e for e in weights if not e.endswith(" ")}
    return {
        e: w
        for e, w in weights.items()
        if not any(e.rstrip(" ")[:cut] in stems and e.rstrip(" ")[:cut] != e for cut in range(3, len(e) + 1))
    }


def strong_entries(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """``entry, toxic, clean, best``: the rows of ``counts`` that ``choose_entries`` can choose, all of them.

    ``best`` are the toxic documents of a stem's best continuation among all
    entries of ``MIN_DOCS``. ``counts`` is read twice and should be stored.
    """
    often = counts.where(F.col("toxic") >= MIN_DOCS)
    stem, is_word = F.rtrim("entry"), F.col("entry").endswith(" ")
    longest = F.least(F.length(stem) - F.when(is_word, 0).otherwise(1), F.lit(STEM_CHARS[-1] + 1))
    cuts = F.when(longest > STEM_CHARS[0], F.sequence(F.lit(STEM_CHARS[0] + 1), longest))
    going_on = often.select(stem.alias("stem"), "toxic", F.explode(cuts).alias("cut"))
    best = going_on.groupBy(F.expr("left(stem, cut)").alias("entry")).agg(F.max("toxic").alias("best"))
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    # A hair below the bound: numpy's logarithm decides in the end.
    strong = often.where(weight >= MIN_WEIGHT - 1e-9).join(best, "entry", "left").fillna(0, ["best"])
    return strong.where(is_word | (F.col("toxic") >= STEM_GAIN * F.col("best")))


def enough_clean(n_toxic: int, n_clean: int) -> int:
    """Documents of the sample that are all clean by chance in at most ``EXCEPTION_CHANCE`` of cases."""
    rarely = np.log(EXCEPTION_CHANCE) / np.log(n_clean / (n_toxic + n_clean))
    return max(EXCEPTION_DOCS, int(np.ceil(rarely)))


def fit_slopes(measures: np.ndarray, toxic: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression with an intercept, by Newton's method."""
    x = np.column_stack([np.ones(len(measures)), measures])
    slopes = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ slopes, -30, 30)))
        gradient = x.T @ (p - toxic) + ridge * slopes
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), gradient)
        slopes = slopes - step
        if np.abs(step).max() < 1e-9:
            break
    return slopes


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    rows: int = SAMPLE_ROWS,
    exceptions: Sequence[str] = SAYINGS,
) -> Lexicon:
    """Lexicon, exceptions and slopes from a bounded sample of labelled rows.

    Three passes over the stored sample: entries by label, phrases around hits,
    and measures. Entries are counted and compared in Spark, and all that are
    frequent and toxic enough reach the driver. Exceptions are phrases in no toxic
    document and in so many clean ones that the toxic share of the sample makes
    chance unlikely. Without labels of both kinds the lexicon is empty.
    """
    sample = labelled_sample(docs, labels, label, rows, doc_id, text).select("text", "label")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, tuple(exceptions))

    def counted(entries) -> DataFrame:
        """``entry, toxic, clean``: documents of the sample by entry and label."""

        def told(sums: Counter) -> pa.RecordBatch:
            columns = [[e for e, _ in sums], [k for _, k in sums], list(sums.values())]
            return batch_of(["entry", "label", "n"], columns, [pa.string(), pa.int32(), pa.int64()])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: Counter = Counter()
            for batch in batches:
                for body, kind in zip(batch.column(0), batch.column(1).to_pylist()):
                    sums.update((entry, kind) for entry in entries(folded(body.as_py())))
                    if len(sums) > HELD_COUNTS:
                        yield told(sums)
                        sums = Counter()
            yield told(sums)

        found = map_batches(sample, task, "entry string, label int, n long")
        by_label = [F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((1, "toxic"), (0, "clean"))]
        return found.groupBy("entry").agg(*by_label)

    often = stored(counted(entries_of).where(F.col("toxic") >= MIN_DOCS), "toxic-entries")
    strong = sorted(strong_entries(often, n_toxic, n_clean).collect())
    toxic, clean, best = ({r["entry"]: r[c] for r in strong} for c in ("toxic", "clean", "best"))
    found = Lexicon(choose_entries(toxic, clean, n_toxic, n_clean, best))

    def phrases(told: str) -> set[str]:
        out = set()
        for start, _, _ in found.hits(told):
            before = told[:start].rsplit(" ", 1)[-1]
            word = told[start + 1 :].split(" ", 1)[0]
            rest = told[start + 1 + len(word) :].split(" ", 2)
            out.add(f"{before} {word}".strip())
            if len(rest) > 1 and rest[1]:
                out.add(f"{word} {rest[1]}")
        return {p for p in out if " " in p}

    spared = counted(phrases).where((F.col("toxic") == 0) & (F.col("clean") >= enough_clean(n_toxic, n_clean)))
    harmless = sorted(r["entry"] for r in spared.collect())
    lexicon = Lexicon(found.weights, tuple(dict.fromkeys([*exceptions, *harmless])))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [lexicon.measures(folded(t.as_py())) for t in batch.column(0)]
            columns = [[b[0] for b in both], [b[1] for b in both], batch.column(1)]
            yield batch_of(["plain", "dense", "label"], columns, [pa.float64(), pa.float64(), pa.int32()])

    # In an order that does not depend on the tasks, as sums of doubles do.
    rows_ = sorted(map_batches(sample, measured, "plain double, dense double, label int").collect())
    values = np.array([[r["plain"], r["dense"]] for r in rows_])
    return Lexicon(lexicon.weights, lexicon.exceptions, fit_slopes(values, np.array([r["label"] for r in rows_], float)))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, matches`` for every row, from its whole text alone.

    ``matches`` counts lexicon hits. Null and empty texts have none and get the
    score of a text without hits. Repeated rows each count, other columns are
    ignored, an empty table gives an empty one.
    """
    # Plain values: workers need not know this module to read them.
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.slopes))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(*shared.value)
        for batch in batches:
            scores, counts = [], []
            for body in batch.column(1):
                told = folded(body.as_py())
                hits = known.hits(told)
                scores.append(known.score(told, hits))
                counts.append(len(hits))
            columns = [batch.column(0), scores, counts]
            yield batch_of(["doc_id", "score", "matches"], columns, [batch.column(0).type, pa.float64(), pa.int64()])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    return map_batches(rows, task, f"doc_id {kind}, score double, matches long")

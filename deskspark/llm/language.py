"""Language identification by rank-order profiles of character n-grams.

A language's profile lists its most frequent n-grams by rank. A document is
ranked the same way, and its distance to a language is the sum over its n-grams
of how far each is out of place there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskspark.llm.arrow_text import batch_of, map_batches

PROFILE_GRAMS = 300
LONGEST_GRAM = 3
UNKNOWN = "und"
#: Characters counted at once; a longer text is counted in pieces that overlap.
PIECE_CHARS = 1 << 16
#: Mean places by which a language must be nearer to be e times as likely.
SHARPNESS = 8.0
#: Letters end before this code point.
LAST_POINT = 0x34000
_SHIFT = np.uint64(21)


_known_letters: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its symbol: 0 if it is no letter, else two more than the code point.

    No letters lie beyond the last point of the table, which stands for them. The
    table is made once per process; it does not travel with the code.
    """
    if not _known_letters:
        _known_letters.append(_letter_table())
    return _known_letters[0]


def _letter_table() -> np.ndarray:
    symbols = np.zeros(LAST_POINT + 1, np.uint32)
    points = np.array([c for c in range(LAST_POINT) if chr(c).isalpha()])
    symbols[points] = points + 2
    return symbols


def _symbols(piece: str, before: np.ndarray) -> np.ndarray:
    """Letters of a piece after what is carried over; runs of anything else are one space (1)."""
    points = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.concatenate([before, np.maximum(_letters()[np.minimum(points, LAST_POINT)], 1)])
    keep = found > 1
    keep[1:] |= found[:-1] > 1
    keep[: len(before)] = True
    return found[keep]


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to 3 letters, words padded by a space, and how often each occurs."""
    start = np.ones(1, np.uint32)
    parts, carried, fresh = [], start, 0
    for at in range(0, len(text), PIECE_CHARS):
        symbols = _symbols(text[at : at + PIECE_CHARS], carried)
        last = at + PIECE_CHARS >= len(text)
        if last and symbols[-1] > 1:
            symbols = np.append(symbols, np.uint32(1))
        s = symbols.astype(np.uint64)
        codes = []
        for n in range(1, LONGEST_GRAM + 1):
            code = np.zeros(max(0, len(s) - n + 1), np.uint64)
            for i in range(n):
                code = (code << _SHIFT) | s[i : len(s) - n + 1 + i]
            # Grams that lie wholly in what was carried over are counted already.
            codes.append(code[max(0, fresh - n + 1) :])
        codes[0] = codes[0][codes[0] > 1]
        parts.append(_counted(np.concatenate(codes)))
        carried = symbols[-(LONGEST_GRAM - 1) :]
        fresh = len(carried)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    return _merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` frequent n-grams, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:most]]


@dataclass
class Profiles:
    """Ranks of all profile n-grams in all languages; ``grams`` where a language lacks one."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    grams: int

    @classmethod
    def build(cls, lists: dict[str, np.ndarray], grams: int) -> "Profiles":
        names = sorted(lists)
        codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *lists.values()]))
        ranks = np.full((len(names), len(codes)), grams, np.int64)
        for row, name in zip(ranks, names):
            row[np.searchsorted(codes, lists[name])] = np.arange(len(lists[name]))
        return cls(names, codes, ranks, grams)

    def predict(self, text: str | None) -> tuple[str, float]:
        top = ranked(*gram_counts(text), self.grams) if text else np.zeros(0, np.uint64)
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        known = self.codes[at] == top
        theirs = np.where(known, self.ranks[:, at], self.grams)
        apart = np.where(theirs < self.grams, np.abs(theirs - np.arange(len(top))), self.grams).mean(axis=1)
        best = int(np.argmin(apart))
        return self.languages[best], float(1 / np.exp((apart[best] - apart) / SHARPNESS).sum())


def learn_profiles(docs: DataFrame, text: str, lang: str, grams: int = PROFILE_GRAMS) -> Profiles:
    """Profiles from all rows with a language.

    Tasks sum their n-grams by language before the shuffle. A language's
    n-grams are first ranked in parts by hash, then the best of the parts, so
    neither a frequent language nor a frequent n-gram fills a task. What reaches
    the driver is ``grams`` rows per language.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            found: dict[str, list] = {}
            for name, told in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.setdefault(name, [sums[name]] if name in sums else []).append(gram_counts(told.as_py()))
            for name, parts in found.items():
                sums[name] = _merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        for name, (codes, counts) in sums.items():
            kinds = [pa.string(), pa.int64(), pa.int64()]
            yield batch_of(["lang", "gram", "n"], [[name] * len(codes), codes.view(np.int64), counts], kinds)

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counts = map_batches(rows.dropna(), task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = [F.desc("n"), F.asc("gram")]
    parts = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64)))
    near = parts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("r") <= grams)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best))
    lists: dict[str, list[tuple[int, int]]] = {}
    for row in near.withColumn("r", rank).where(F.col("r") <= grams).select("lang", "gram", "r").collect():
        lists.setdefault(row["lang"], []).append((row["r"], row["gram"]))
    ordered = {k: np.array([g for _, g in sorted(v)], np.int64).view(np.uint64) for k, v in lists.items()}
    return Profiles.build(ordered, grams)


def identify(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if no language was learned. Ties go to the first name by code point.
    Repeated rows each count, other columns are ignored, an empty table gives an
    empty one.
    """
    # Plain values: workers need not know this module to read them.
    shared = docs.sparkSession.sparkContext.broadcast((profiles.languages, profiles.codes, profiles.ranks, profiles.grams))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(*shared.value)
        for batch in batches:
            found = [known.predict(told.as_py()) for told in batch.column(1)]
            columns = [batch.column(0), [f[0] for f in found], [f[1] for f in found]]
            yield batch_of(
                ["doc_id", "lang_pred", "score"], columns, [batch.column(0).type, pa.string(), pa.float64()]
            )

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    return map_batches(rows, task, f"doc_id {kind}, lang_pred string, score double")

"""Fill-in-the-middle: a text's middle moves to its end, behind marks that tell the parts apart.

The text is cut between units (code points, or any pattern). One match of
``(unit)*`` over the whole text keeps every repetition it captured, so the ends
of that group give the number of units and the offset of every cut at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.llm.arrow_text import batch_of, id_and_text, map_batches, schema_with_rows, text_bytes, with_rows

#: Units that one match may hold, as each takes some hundred bytes; longer texts take several matches.
BLOCK_UNITS = 1 << 18
POINT = r"(?s:.)"


@dataclass(frozen=True)
class Rearrange:
    """How texts are cut: seed, unit, shares in percent, and the three marks."""

    seed: int = 1
    unit: str = POINT
    moved_percent: int = 90
    suffix_first_percent: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = self.marks
        if any(not m for m in marks) or any(a in b for a in marks for b in marks if a is not b):
            raise ValueError("marks must not be empty or hold one another")
        # A mark whose head repeats at its end could be found too early behind a text that ends so.
        if any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)))):
            raise ValueError("no mark may end as a mark begins")
        if regex.fullmatch(self.unit, "") is not None:
            raise ValueError("a unit must not match the empty text")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def patterns(self) -> tuple[regex.Pattern, regex.Pattern]:
        """For a whole text, and for the next units of a long one."""
        unit = f"((?>{self.unit}))"
        return regex.compile(f"{unit}*"), regex.compile(f"{unit}{{1,{BLOCK_UNITS}}}+")


def unit_ends(text: str, whole: regex.Pattern, block: regex.Pattern) -> np.ndarray | None:
    """Where each unit ends, in code points; ``None`` if units do not cover the text."""
    if len(text) <= BLOCK_UNITS:
        found = whole.fullmatch(text)
        return None if found is None else np.array(found.ends(1), np.int64)
    parts, at = [], 0
    while at < len(text):
        found = block.match(text, at)
        if found is None:
            return None
        parts.append(np.array(found.ends(1), np.int64))
        at = found.end()
    return np.concatenate(parts)


def draws(seed: int, doc_id: str) -> list[int]:
    """Four numbers below 2^32 from the hash of seed and id."""
    told = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(told[at : at + 8], 16) for at in range(0, 32, 8)]


class Cutter:
    """Cuts texts by a fixed plan."""

    def __init__(self, plan: Rearrange) -> None:
        self.plan = plan
        self.whole, self.block = plan.patterns()

    def cut(self, doc_id: str, text: str) -> tuple[int, str, int | None, int | None, str]:
        """``n, form, prefix_chars, middle_chars, output``."""
        plan = self.plan
        ends = unit_ends(text, self.whole, self.block)
        if ends is None:
            return 0, "plain", None, None, text
        n = len(ends)
        one, two, three, four = draws(plan.seed, doc_id)
        if n == 0 or three % 100 >= plan.moved_percent or any(m in text for m in plan.marks):
            return n, "plain", None, None, text
        first, second = (0 if k == 0 else int(ends[k - 1]) for k in sorted((one % (n + 1), two % (n + 1))))
        prefix, middle, suffix = text[:first], text[first:second], text[second:]
        if four % 100 < plan.suffix_first_percent:
            form, output = "spm", f"{plan.suffix}{suffix}{plan.prefix}{prefix}{plan.middle}{middle}"
        else:
            form, output = "psm", f"{plan.prefix}{prefix}{plan.suffix}{suffix}{plan.middle}{middle}"
        return n, form, len(prefix), len(middle), output


_COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def rearrange_texts(
    docs: DataFrame,
    plan: Rearrange = Rearrange(),
    doc_id: str = "doc_id",
    text: str = "text",
    keep_rows: bool = False,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row.

    ``form`` is ``plain`` (output is the text), ``psm`` or ``spm``. With
    ``keep_rows`` a column ``row`` carries the document's own columns. A map
    without shuffle: cuts depend on seed, id and text alone, so reruns and
    repeated rows agree. Null texts count as empty, and empty texts, texts with
    a mark in them and texts that units do not cover (``n`` is then 0) stay
    plain; a null id draws as an empty one. Lengths are code points. Memory is
    bounded by one batch or text and ``BLOCK_UNITS`` captures; other columns are
    ignored, an empty table gives an empty one.
    """
    made = [getattr(plan, f) for f in plan.__dataclass_fields__]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(Rearrange(*made))
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            ids = pc.fill_null(batch.column(0).cast(pa.string()), "").to_pylist()
            rows = [
                cutter.cut(i, data[a:b].tobytes().decode())
                for i, a, b in zip(ids, starts[:-1].tolist(), starts[1:].tolist())
            ]
            columns = list(zip(*rows)) if rows else [[]] * len(_TYPES)
            told = batch_of(_COLUMNS, [batch.column(0), *columns], [batch.column(0).type, *_TYPES])
            yield with_rows(batch, told)

    rows = id_and_text(docs, doc_id, text, keep_rows)
    told = "n long, form string, prefix_chars long, middle_chars long, output string"
    return map_batches(rows, task, schema_with_rows(rows, told))


def restored(output: Column, form: Column, plan: Rearrange = Rearrange()) -> Column:
    """The text before it was rearranged, from output and form alone, as a column expression.

    No part holds a mark, so a mark's first occurrence is the mark itself. Null
    output or form gives null.
    """

    def after(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, -1)

    def until(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, 1)

    middle, head = after(output, plan.middle), until(output, plan.middle)
    prefix_first = F.concat(after(until(head, plan.suffix), plan.prefix), middle, after(head, plan.suffix))
    suffix_first = F.concat(after(head, plan.prefix), middle, after(until(head, plan.prefix), plan.suffix))
    return F.when(form == "psm", prefix_first).when(form == "spm", suffix_first).when(form == "plain", output)


def rearranged_digest(cut: DataFrame, plan: Rearrange = Rearrange()) -> DataFrame:
    """The digest columns of the query: hashes of the output and of the text rebuilt from it."""
    back = restored(F.col("output"), F.col("form"), plan)
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )

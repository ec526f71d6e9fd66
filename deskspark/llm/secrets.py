"""Secret scans: all rules in one deterministic automaton, read byte by byte.

Three automata come from the same rules. The first runs over every byte once and
stays in its last state as soon as any rule has matched, which most texts never
reach. Only texts that do are read again to place the spans: one pass from the
end marks every byte at which a match of any rule begins, and from the leftmost
mark of a rule behind its last match the third finds where the longest one ends.
Marks are matches, so a rule's runs cover its own spans only, and the time of
a text grows with its length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.llm.arrow_text import (
    batch_of,
    id_and_text,
    map_batches,
    schema_with_rows,
    text_bytes,
    with_rows,
)
from deskspark.llm.automaton import Automaton


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds a match; it counts if ``checked`` trailing characters of ``tail`` number ``least``.

    ``tail`` is the set of characters the last part of the pattern takes, or
    empty for the whole match. ``base`` rules are counted by the query.
    ``sieve`` is a pattern that is found wherever a counting match is; without
    counts of its own it keeps the automaton of all rules small.
    """

    kind: str
    pattern: str
    least: int
    sieve: str
    tail: str = ""
    base: bool = False


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), "[aA][pP][iI]_?[kK][eE][yY]"])
_ASSIGNS = f"(?:{_KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?"
_VALUE = "[A-Za-z0-9+/_.=-]"

#: The base kinds in their listed order, then well-known token formats.
RULES = (
    Rule("assign", f"{_ASSIGNS}{_VALUE}+", 12, f"{_ASSIGNS}{_VALUE}", tail=_VALUE, base=True),
    Rule("access", "AKIA[A-Z0-9]+", 18, "AKIA", base=True),
    Rule("hex", "[0-9a-f]+", 16, "[0-9a-f]{16}", base=True),
    Rule("github", "gh[opsur]_[A-Za-z0-9]+", 40, "gh[opsur]_[A-Za-z0-9]"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15, "xox[abprs]-[A-Za-z0-9-]"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 36, "eyJ[A-Za-z0-9_-]+\\.eyJ"),
    Rule("key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 27, "-----BEGIN "),
)


class Scanner:
    """The automata, and where each rule's matches lie."""

    def __init__(self, rules: Sequence[Rule], tables: Sequence[tuple] | None = None) -> None:
        self.rules = tuple(rules)
        if tables is None:
            sieve = Automaton.compile([r.sieve for r in rules], anywhere=True, absorbing=True)
            begins = Automaton.compile([r.pattern for r in rules], anywhere=True, backward=True)
            exact = Automaton.compile([r.pattern for r in rules], anywhere=False)
            tails = [Automaton.compile([r.tail], anywhere=False) if r.tail else None for r in rules]
        else:
            sieve, begins, exact, *tails = [t and Automaton(*t) for t in tables]
        self.automata = sieve, begins, exact
        self.tails = tails
        self.sieve, self.begins, self.exact = (a.linked()[0] for a in self.automata)

    def plain(self) -> tuple[list[tuple], list[tuple | None]]:
        """Rules and tables as tuples and arrays, which workers can read without this module."""
        tables = [a and (a.table, a.accepts, a.hopes) for a in (*self.automata, *self.tails)]
        return [astuple(r) for r in self.rules], tables

    @classmethod
    def from_plain(cls, told: tuple[list[tuple], list[tuple | None]]) -> Scanner:
        rules, tables = told
        return cls([Rule(*r) for r in rules], tables)

    def touched(self, text: bytes) -> bool:
        """One pass over all bytes, for all rules."""
        state = self.sieve
        for byte in text:
            state = state[byte]
        return state[256] > 0

    def matches(self, text: bytes) -> list[tuple[int, int, int]]:
        """``(start, end, rule)`` in bytes: leftmost, non-overlapping per rule, longest from its start."""
        marks, state = [], self.begins
        for at in range(len(text) - 1, -1, -1):
            state = state[text[at]]
            if state[256]:
                marks.append((at, state[256]))
        out, free = [], [0] * len(self.rules)
        for start, mask in reversed(marks):
            for i, at in enumerate(free):
                if at <= start and mask >> i & 1:
                    free[i] = end = self._end(text, start, 1 << i)
                    if self._counts(i, text[start:end]):
                        out.append((start, end, i))
        return sorted(out, key=lambda m: (m[0], m[2]))

    def _end(self, text: bytes, start: int, rule: int) -> int:
        """Where the longest match of a rule from ``start`` ends."""
        state, end = self.exact, start
        for at in range(start, len(text)):
            state = state[text[at]]
            if state[256] & rule:
                end = at + 1
            if not state[257] & rule:
                break
        return end

    def _counts(self, rule: int, found: bytes) -> bool:
        if self.tails[rule] is None:
            return len(found) >= self.rules[rule].least
        ok = self.tails[rule].accepts[self.tails[rule].table[0]] > 0
        # The separators before the last part may hold characters of its set, but only one: the sign.
        at = len(found)
        while at > 0 and ok[found[at - 1]]:
            at -= 1
        return _value_length(found[at:], found[:at]) >= self.rules[rule].least

    def spans(self, text: bytes) -> list[tuple[int, int, str]]:
        """``(start, end, kind)`` in code points."""
        if not self.touched(text):
            return []
        out, at, chars = [], 0, 0
        found = self.matches(text)
        points: dict[int, int] = {}
        for edge in sorted({e for s, t, _ in found for e in (s, t)}):
            chars += len(text[at:edge].decode("utf-8", "replace"))
            at = edge
            points[edge] = chars
        for s, t, i in found:
            out.append((points[s], points[t], self.rules[i].kind))
        return out


def _value_length(run: bytes, before: bytes) -> int:
    """Length of the value in a trailing run, which begins after the first sign if the sign is inside it.

    A run that follows a space, a quote or a colon after the sign is all value;
    otherwise it begins with the keyword and the value starts past the ``=``.
    """
    if any(sign in before for sign in (b":", b"=")):
        return len(run)
    # Keyword (and a quote or spaces, then in ``before``) up to the first sign.
    return len(run) - run.index(b"=") - 1


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def find_secrets(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    keep_rows: bool = False,
) -> DataFrame:
    """``doc_id, spans`` for every row: where secrets lie, in code points, by start and then rule order.

    With ``keep_rows`` a column ``row`` carries the document's own columns. A
    map without shuffle; memory is bounded by one batch and the automata, which
    depend on the rules alone. Null and empty texts have no spans; repeated rows
    each count; other columns are ignored; an empty table gives an empty one.
    Spans of different rules may overlap.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules).plain())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.from_plain(shared.value)
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            raw = data.tobytes()
            found = [
                [{"start": s, "end": e, "kind": k} for s, e, k in scanner.spans(raw[a:b])]
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())
            ]
            told = batch_of(["doc_id", "spans"], [batch.column(0), found], [batch.column(0).type, _SPANS])
            yield with_rows(batch, told)

    rows = id_and_text(docs, doc_id, text, keep_rows)
    return map_batches(rows, task, schema_with_rows(rows, "spans array<struct<start:long,end:long,kind:string>>"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every character in a span replaced by ``*``, as a column expression."""
    inside = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s["end"] > a["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    a["out"],
                    F.substring(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")),
                    F.repeat(F.lit("*"), (s["end"] - F.greatest(s["start"], a["at"])).cast("int")),
                ).alias("out"),
            ),
        ).otherwise(a),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2147483647))),
    )
    return F.when(F.size(spans) > 0, inside).otherwise(text)


def secret_counts(found: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The digest columns of the query, derived from the spans."""

    def told(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    base = [r.kind for r in rules if r.base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts, F.sha2(told(of_base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans")
    )

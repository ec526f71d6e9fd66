"""Personal-data redaction as Spark expressions.

Everything here is Column in, Column out: a row never leaves the JVM and no
shuffle is needed, so the cost is one pass over the text. Rows that cannot hold
a match (no ``@`` and no pair of digits) skip all of it.

How spans get exact offsets: a pattern's matches are wrapped in two private-use
characters by ``regexp_replace``; splitting on the closing one leaves pieces
"text before + opening mark + match", and summing piece lengths gives code-point
offsets. Texts that already hold a mark have it swapped for a third private-use
character first, which changes neither lengths nor matches.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as each kind of personal data.
# Digits, spaces and word characters are spelled out as Unicode classes because
# Java's shorthands differ from them (Java's \s lacks U+001C..U+001F, its \b
# depends on the Java version). Runs that nothing after them could share are
# possessive, so that long runs of spaces do not backtrack.
DIGIT = r"\p{Nd}"
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
GAP = SPACE[:-1] + r"\-.]"
# Java looks back one UTF-16 unit unless the pattern holds a character beyond
# them; the digit added here (already in \p{N}) makes it look back a character.
WORD_START = "(?<![\\p{L}\\p{N}_\U0001d7ce])"
WORD_END = r"(?![\p{L}\p{N}_])"
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_INTERNATIONAL = rf"\+{DIGIT}{{1,3}}(?:{GAP}?{DIGIT}{{1,4}}){{2,5}}"
PHONE_PARENTHESES = rf"\({DIGIT}{{3}}\){SPACE}*+{DIGIT}{{3}}{GAP}?{DIGIT}{{4}}"
PHONE_SEPARATED = rf"{WORD_START}{DIGIT}{{3}}{GAP}{DIGIT}{{3}}{GAP}{DIGIT}{{4}}{WORD_END}"
CARD = rf"{WORD_START}(?:{DIGIT}[ -]?){{12,18}}{DIGIT}{WORD_END}"
ACCOUNT_LEAD = rf"(?i:account{SPACE}++(?:no\.?|number|#)?|a/c|acct\.?){SPACE}*+[#:.]?{SPACE}*+"
ACCOUNT_DIGITS = rf"{DIGIT}{{8,12}}"
TOKENS = {"email": "[EMAIL]", "phone": "[PHONE]", "card": "[CARD]", "account": "[ACCT]"}
PHONE_DIGITS = (7, 15)
CARD_DIGITS = (13, 19)

# An e-mail can only begin where the previous match ended or where a run of
# address characters begins; saying so keeps long unbroken runs linear.
_EMAIL_SCAN = r"(?:\G|(?<![A-Za-z0-9._%+-]))" + EMAIL

_OPEN, _CLOSE, _STAND_IN = "\ue000", "\ue001", "\ue002"
_WHOLE = f"{_OPEN}$0{_CLOSE}"

_DIGIT_PAIR = rf"{DIGIT}[ -]?{DIGIT}"

# kind, pattern, replacement that marks the span, and a cheap pattern that is
# found wherever a match is; in tie-break order.
_FINDERS = (
    ("email", _EMAIL_SCAN, _WHOLE, "@"),
    ("phone", PHONE_INTERNATIONAL, _WHOLE, rf"\+{DIGIT}"),
    ("phone", PHONE_PARENTHESES, _WHOLE, rf"\({DIGIT}{{3}}\)"),
    ("phone", PHONE_SEPARATED, _WHOLE, rf"{DIGIT}{{3}}{GAP}{DIGIT}{{3}}"),
    ("card", CARD, _WHOLE, rf"(?:{DIGIT}[ -]?){{12}}{DIGIT}"),
    ("account", f"({ACCOUNT_LEAD})({ACCOUNT_DIGITS}){WORD_END}", f"$1{_OPEN}$2{_CLOSE}", ACCOUNT_DIGITS),
)
KINDS = tuple(TOKENS)

_MATCH_LIST = "array<struct<span_start:int,span_end:int,raw:string>>"
_CANDIDATE = "struct<neg_len:int,span_start:int,finder:int,span_end:int,kind:string,raw:string>"
SPAN_LIST = "array<struct<span_start:int,span_end:int,kind:string,original_hash:string>>"
REDACTION = f"struct<redacted_text:string,spans:{SPAN_LIST}>"


def _digit_table() -> tuple[str, str]:
    """Every non-ASCII decimal digit and the ASCII digit of the same value."""
    every = (chr(c) for c in range(128, sys.maxunicode + 1))
    digits = [c for c in every if unicodedata.category(c) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(c)) for c in digits)


_OTHER_DIGITS, _THEIR_VALUES = _digit_table()


def _let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _empty(array_type: str) -> Column:
    return F.array().cast(array_type)


def ascii_digits(raw: Column) -> Column:
    """The decimal digits of ``raw``, of any script, as ASCII."""
    only_digits = F.regexp_replace(raw, r"\P{Nd}", "")
    return F.translate(only_digits, _OTHER_DIGITS, _THEIR_VALUES)


def luhn_valid(digits: Column) -> Column:
    """Luhn checksum over a string of ASCII digits, 13 to 19 of them."""

    def weight(place: Column) -> Column:
        digit = F.substring(digits, -place, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return F.when(place % 2 == 0, doubled).otherwise(digit)

    places = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(places, F.lit(0), lambda acc, place: acc + weight(place))
    return F.length(digits).between(*CARD_DIGITS) & (total % 10 == 0)


def _blocks(values: Column) -> Column:
    """``values`` cut into about as many consecutive blocks as each holds values.

    Growing an array inside ``aggregate`` copies it at every step. Doing that per
    block, and once over the blocks, keeps a text with very many matches from
    costing the square of their number.
    """

    def cut(size: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), size)
        return F.transform(firsts, lambda first: F.slice(values, first, size))

    return _let(F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1)), cut)


def _running(values: Column, join) -> Column:
    """Inclusive scan of non-negative ints; ``join`` is addition or maximum."""
    none = _empty("array<int>")

    def extend(scan: Column, value: Column) -> Column:
        before = F.when(F.size(scan) == 0, 0).otherwise(F.get(scan, F.size(scan) - 1))
        return F.concat(scan, F.array(join(before, value)))

    def carry_over(scans: Column) -> Column:
        upto = F.aggregate(F.transform(scans, lambda scan: F.get(scan, F.size(scan) - 1)), none, extend)
        return _let(
            upto,
            lambda totals: F.flatten(
                F.transform(
                    scans,
                    lambda scan, b: _let(
                        F.when(b == 0, 0).otherwise(F.get(totals, b - 1)),
                        lambda before: F.transform(scan, lambda v: join(before, v)),
                    ),
                )
            ),
        )

    scans = F.transform(_blocks(values), lambda block: F.aggregate(block, none, extend))
    return _let(scans, carry_over)


def _locate(marked: Column) -> Column:
    """The matches marked in a text, with code-point offsets, in text order."""

    def match(piece: Column, end: Column) -> Column:
        raw = F.substring_index(piece, _OPEN, -1)
        return F.struct(
            (end - F.length(raw)).alias("span_start"), end.alias("span_end"), raw.alias("raw")
        )

    def place(found: Column) -> Column:
        # One character of each piece is the opening mark.
        lengths = F.transform(found, lambda p: F.length(p) - 1)
        ends = _running(lengths, lambda a, b: a + b)
        return _let(ends, lambda at: F.transform(found, lambda p, i: match(p, F.get(at, i))))

    # The last piece is the text after the final match.
    pieces = F.split(marked, _CLOSE, -1)
    found = _let(pieces, lambda p: F.slice(p, F.lit(1), F.size(p) - 1))
    return _let(found, lambda f: F.when(F.size(f) == 0, _empty(_MATCH_LIST)).otherwise(place(f)))


def _keep(kind: Column, raw: Column) -> Column:
    """Whether a match has the digits its kind needs."""
    n_digits = F.length(F.regexp_replace(raw, r"\P{Nd}", ""))
    return (
        F.when(kind == "phone", n_digits.between(*PHONE_DIGITS))
        .when(kind == "card", _let(ascii_digits(raw), luhn_valid))
        .otherwise(True)
    )


def _may_match(text: Column) -> Column:
    """Cheap necessary condition for a match of any kind."""
    return F.contains(text, F.lit("@")) | F.rlike(text, F.lit(_DIGIT_PAIR))


def _without_marks(text: Column) -> Column:
    return F.translate(text, _OPEN + _CLOSE, _STAND_IN * 2)


def _finders(text: Column, kinds: tuple[str, ...]) -> Column:
    """Candidates of all finders of ``kinds``, sorted longest first."""
    wanted = [f for f in _FINDERS if f[0] in kinds]

    def candidates(of_finder: Column, finder: Column) -> Column:
        kind = F.get(F.array(*[F.lit(f[0]) for f in wanted]), finder)
        kept = F.filter(_locate(of_finder), lambda m: _keep(kind, m["raw"]))
        return F.transform(
            kept,
            lambda m: F.struct(
                (m["span_start"] - m["span_end"]).alias("neg_len"),
                m["span_start"].alias("span_start"),
                finder.alias("finder"),
                m["span_end"].alias("span_end"),
                kind.alias("kind"),
                m["raw"].alias("raw"),
            ),
        )

    def collect(clean: Column) -> Column:
        marked = [
            F.when(
                F.rlike(clean, F.lit(gate)), F.regexp_replace(clean, F.lit(pattern), F.lit(marking))
            ).otherwise("")
            for _, pattern, marking, gate in wanted
        ]
        return F.array_sort(F.flatten(F.transform(F.array(*marked), candidates)))

    return _let(_without_marks(text), collect)


def pii_candidates(text: Column, *kinds: str) -> Column:
    """Matches of ``kinds`` before overlaps are resolved."""
    return F.when(
        text.isNotNull(),
        F.when(_may_match(text), _finders(text, kinds or KINDS)).otherwise(
            _empty(f"array<{_CANDIDATE}>")
        ),
    )


def _accept(cluster: Column) -> Column:
    """Longest first; a candidate touching an accepted one is dropped."""

    def step(taken: Column, c: Column) -> Column:
        clash = F.exists(
            taken,
            lambda t: (t["span_start"] < c["span_end"]) & (c["span_start"] < t["span_end"]),
        )
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(c)))

    def settle(run: Column) -> Column:
        greedy = F.aggregate(F.array_sort(run), _empty(f"array<{_CANDIDATE}>"), step)
        return F.when(F.size(run) <= 1, run).otherwise(greedy)

    return _let(cluster, settle)


def _resolve(candidates: Column) -> Column:
    """Non-overlapping candidates in text order.

    Only overlapping neighbours compete, so candidates are put in text order, cut
    wherever one starts beyond all earlier ends, and each run of overlapping ones
    is settled on its own.
    """
    by_place = F.array_sort(
        F.transform(candidates, lambda c: F.struct(c["span_start"].alias("at"), c.alias("c")))
    )

    def settle(ordered: Column) -> Column:
        reach = _running(F.transform(ordered, lambda o: o["c"]["span_end"]), F.greatest)

        def runs(reached: Column) -> Column:
            starts_run = F.filter(
                F.sequence(F.lit(0), F.size(ordered) - 1),
                lambda i: (i == 0) | (F.get(ordered, i)["at"] >= F.get(reached, i - 1)),
            )
            return _let(
                starts_run,
                lambda firsts: F.transform(
                    firsts,
                    lambda first, k: F.slice(
                        ordered,
                        first + 1,
                        F.coalesce(F.get(firsts, k + 1), F.size(ordered)) - first,
                    ),
                ),
            )

        clusters = _let(reach, runs)
        return F.flatten(
            F.transform(
                clusters, lambda cluster: _accept(F.transform(cluster, lambda o: o["c"]))
            )
        )

    kept = _let(
        by_place,
        lambda o: F.when(F.size(o) == 0, _empty(f"array<{_CANDIDATE}>")).otherwise(settle(o)),
    )
    return F.array_sort(
        F.transform(
            kept,
            lambda c: F.struct(
                c["span_start"].alias("span_start"),
                c["span_end"].alias("span_end"),
                c["kind"].alias("kind"),
                c["raw"].alias("raw"),
            ),
        )
    )


def salted_hash(salt: bytes, raw: Column) -> Column:
    """Hex SHA-256 of the salt followed by the UTF-8 bytes of ``raw``."""
    return F.sha2(F.concat(F.lit(bytes(salt)), F.encode(raw, "UTF-8")), 256)


def _rewrite(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its token.

    Finding a place in a UTF-8 string means reading up to it, so each block of
    spans works on its own stretch of the text.
    """
    token = F.create_map(*[F.lit(x) for pair in TOKENS.items() for x in pair])

    def end_of(span: Column) -> Column:
        return F.coalesce(span["span_end"], F.lit(0))

    def block_text(block: Column, at: Column) -> Column:
        stretch = F.substring(text, at + 1, end_of(F.element_at(block, -1)) - at)

        def piece(part: Column, span: Column, i: Column) -> Column:
            before = F.when(i == 0, at).otherwise(F.get(block, i - 1)["span_end"])
            kept = F.substring(part, before - at + 1, span["span_start"] - before)
            return F.concat(kept, token[span["kind"]])

        return _let(
            stretch,
            lambda part: F.array_join(F.transform(block, lambda s, i: piece(part, s, i)), ""),
        )

    def join(blocks: Column) -> Column:
        return F.array_join(
            F.transform(
                blocks,
                lambda block, b: _let(
                    F.when(b == 0, 0).otherwise(
                        end_of(F.element_at(F.get(blocks, b - 1), -1))
                    ),
                    lambda at: block_text(block, at),
                ),
            ),
            "",
        )

    tail = F.substring(text, F.element_at(spans, -1)["span_end"] + 1, F.length(text))
    return F.concat(_let(_blocks(spans), join), tail)


def redact(text: Column, salt: bytes) -> Column:
    """``struct<redacted_text, spans>``; raw values are kept only as salted hashes.

    Offsets are code points into the original text, end exclusive. Null text
    gives null.
    """

    def finish(spans: Column) -> Column:
        hashed = F.transform(
            spans,
            lambda s: F.struct(
                s["span_start"].alias("span_start"),
                s["span_end"].alias("span_end"),
                s["kind"].alias("kind"),
                salted_hash(salt, s["raw"]).alias("original_hash"),
            ),
        )
        rewritten = F.when(F.size(spans) == 0, text).otherwise(_rewrite(text, spans))
        return F.struct(
            rewritten.alias("redacted_text"), hashed.cast(SPAN_LIST).alias("spans")
        )

    untouched = F.struct(
        text.alias("redacted_text"), _empty(SPAN_LIST).alias("spans")
    )
    found = _let(_resolve(_finders(text, KINDS)), finish)
    return F.when(
        text.isNotNull(), F.when(_may_match(text), found).otherwise(untouched)
    )

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from deskspark.functions import redact as R
from deskspark.operators.redaction import candidate_spans, pii_profile, redact_messages, redaction_spans

SALT = b"pepper"


@pytest.fixture(scope="module")
def redact(spark):
    def run(*texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
        rows = redact_messages(df, SALT).orderBy("id").collect()
        return [(r["redacted_text"], [tuple(s) for s in r["spans"]] if r["spans"] is not None else None) for r in rows]

    return run


def with_check_digit(head):
    """``head`` and the digit that makes the whole number pass the card check."""
    return next(head + d for d in "0123456789" if plain_luhn(head + d))


def whole(redact, *texts):
    """Kinds found in each text, and whether each was found as the whole text."""
    return [[(kind, (s, e) == (0, len(t))) for s, e, kind, _ in spans] for t, (_, spans) in zip(texts, redact(*texts))]


def test_mail_addresses(redact):
    good = ["q@w.io", "first_last%tag@mail-4.host.museum", "9-9@a.b.cd", "A+B.c@Z.ZZ"]
    assert whole(redact, *good) == [[("email", True)]] * 4
    assert whole(redact, "q@w", "@w.io", "q@.i", "q w.io", "q@w.i") == [[]] * 5
    [(text, _)] = redact("<q@w.io>,(r@w.io);s@w.io.")
    assert text == "<[EMAIL]>,([EMAIL]);[EMAIL]."


def test_phone_numbers_have_seven_to_fifteen_digits(redact):
    grouped = ["+7 301 44 88", "+352-27-61-35-9", "+1.202.9931.4410", "(603) 2714409", "603.271.4409"]
    assert whole(redact, *grouped) == [[("phone", True)]] * 5
    # Too short, groups of a wrong size, and a date.
    assert whole(redact, "+4 12 34", "60-3271-4409", "(60) 271-4409", "1999-12-31", "603271.4409") == [[]] * 5
    for n in range(4, 19):
        digits = "+3" + "".join(str(i % 10) for i in range(1, n))
        [found] = whole(redact, digits)
        assert (("phone", True) in found) == (7 <= n <= 15), digits


def test_cards_pass_the_check_digit(redact):
    for n in range(11, 21):
        number = with_check_digit(("5" + "3107264" * 3)[: n - 1])
        wrong = number[:-1] + str((int(number[-1]) + 1) % 10)
        good, bad = whole(redact, number, wrong)
        assert (("card", True) in good) == (13 <= n <= 19) and bad == []
    spaced = with_check_digit("601125093748162")
    parts = [spaced[i : i + 4] for i in range(0, 16, 4)]
    assert whole(redact, " ".join(parts), "-".join(parts)) == [[("card", True)]] * 2
    assert redact(f"x{spaced} {spaced}y") == [(f"x{spaced} {spaced}y", [])]


def test_accounts_need_a_word_before_them(redact):
    words = ["account ", "Account no ", "ACCOUNT NUMBER: ", "account # ", "a/c", "A/C: ", "Acct", "acct.#"]
    for word, (text, spans) in zip(words, redact(*[f"{w}90817263 ok" for w in words])):
        assert text == f"{word}[ACCT] ok" and [s[2] for s in spans] == ["account"]
    assert [s for _, s in redact("bank 90817263", "account9081726", "account 9081726", "acct 9081726354433")] == [[]] * 4
    sizes = {n: bool(redact("acct " + "9" * n)[0][1]) for n in range(6, 14)}
    assert sizes == {n: 8 <= n <= 12 for n in range(6, 14)}


def test_several_kinds_in_order(redact):
    card = with_check_digit("37124509981653")
    [(text, spans)] = redact(f"acct 90817263, q@w.io; 603-271-4409 / {card}")
    assert text == "acct [ACCT], [EMAIL]; [PHONE] / [CARD]"
    assert [s[2] for s in spans] == ["account", "email", "phone", "card"] and spans == sorted(spans)
    assert redact("", "nothing here") == [("", []), ("nothing here", [])]


def test_offsets_and_salted_hash(redact):
    [(_, [(start, end, kind, digest)])] = redact("é😀 to: q@w.io")
    assert (start, end, kind) == (7, 13, "email")
    assert digest == hashlib.sha256(SALT + b"q@w.io").hexdigest()


def test_salt_changes_hash(spark):
    df = spark.createDataFrame([("q@w.io and again q@w.io",)], "text string")
    digests = {salt: {r["original_hash"] for r in redaction_spans(df, salt).collect()} for salt in (b"p", b"q", b"p ")}
    assert all(len(d) == 1 for d in digests.values()) and len(set.union(*digests.values())) == 3


def test_null_text(redact):
    assert redact(None, "x@y.com") == [(None, None), ("[EMAIL]", redact("x@y.com")[0][1])]


# --- an independent statement of the rules: brute force over Python's re -------

PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 0),
    ("phone", re.compile(r"\+\d{1,3}(?:[\s\-.]?\d{1,4}){2,5}"), 0),
    ("phone", re.compile(r"\(\d{3}\)\s*\d{3}[\s\-.]?\d{4}"), 0),
    ("phone", re.compile(r"\b\d{3}[\s\-.]\d{3}[\s\-.]\d{4}\b"), 0),
    ("card", re.compile(r"\b(?:\d[ -]?){12,18}\d\b"), 0),
    ("account", re.compile(r"(?:account\s+(?:no\.?|number|#)?|a/c|acct\.?)\s*[#:.]?\s*(\d{8,12})\b", re.I), 1),
]


def plain_luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(sum(divmod(d, 10)) for d in doubled) % 10 == 0


def brute_spans(text):
    found = []
    for rank, (kind, pattern, group) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            raw = m.group(group)
            digits = [c for c in raw if c.isdecimal()]
            if kind == "phone" and not 7 <= len(digits) <= 15:
                continue
            if kind == "card" and not plain_luhn(digits):
                continue
            found.append((m.end(group) - m.start(group), -m.start(group), -rank, m.span(group), kind))
    taken = set()
    spans = []
    for _, _, _, (start, end), kind in sorted(found, reverse=True):
        if taken.isdisjoint(range(start, end)):
            taken.update(range(start, end))
            spans.append((start, end, kind))
    return sorted(spans)


PIECES = [
    "a", "é", "kim", "@", "x.co", ".org", "+", "1", "12", "603", "271", "4409", " ", "  ", "-", ".", "(", ")",
    "(603)", "5310726453107264", "5310 7264 5310 7264", "account", "Account no. ", "a/c", "acct.", "#", ":",
    "90817263", "0918273645546", "_", "٣", "٤١٥", " ", "\x1c", " ", "²", "½", "́", "", "",
    "𝟙𝟚𝟛", "😀", "\n", "\t", "%", "kim@host.org", "603-271-4409", "+352 27 61 35 90", "no", "number", "ACCT",
]


def test_matches_brute_force(redact):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    got = redact(*texts)
    assert sum(len(spans) for _, spans in got) > 2000
    for text, (rewritten, spans) in zip(texts, got):
        assert [(s, e, k) for s, e, k, _ in spans] == brute_spans(text), text
        rebuilt, at = [], 0
        for s, e, k, digest in spans:
            rebuilt += [text[at:s], R.TOKENS[k]]
            assert digest == hashlib.sha256(SALT + text[s:e].encode()).hexdigest()
            at = e
        assert rewritten == "".join(rebuilt) + text[at:]


def test_long_texts_stay_whole(redact):
    """Many matches, long runs that match nothing, and long gaps in the context pattern."""
    many = " ".join(f"u{i}@host.org 603-271-{i:04d}" for i in range(3000))
    runs = "a" * 200_000 + "@" + "b" * 200_000 + " account" + " " * 200_000 + "x " + "7" * 200_000
    (first, spans), (second, none), (third, one) = redact(many, runs, "z" * 300_000 + " x@y.org")
    assert len(spans) == 6000 and first.startswith("[EMAIL] [PHONE] [EMAIL]")
    assert (second, none) == (runs, [])
    assert third.endswith("z [EMAIL]") and one[0][:2] == (300_001, 300_008)


def test_longest_then_earliest_wins(redact):
    # The e-mail covers the phone number inside its local part.
    [(text, spans)] = redact("603-271-4409@host.org")
    assert text == "[EMAIL]" and len(spans) == 1


def test_candidates_keep_overlaps(spark):
    df = spark.createDataFrame([(1, "603-271-4409@host.org")], "id int, text string")
    assert candidate_spans(df, "phone", SALT).select("id", "span_start", "span_end").collect() == [(1, 0, 12)]


def test_profile_counts_spans_and_texts(spark):
    texts = ["a@b.com c@d.com", "e@f.org", "nothing", "account 90817263", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r["kind"]: (r["n_spans"], r["n_texts"]) for r in pii_profile(df, SALT).collect()}
    assert found == {"email": (3, 2), "phone": (0, 0), "card": (0, 0), "account": (1, 1)}


def test_runs_without_python_or_shuffle(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("text"))
    plan = redact_messages(df, SALT)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan

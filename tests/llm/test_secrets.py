import pickle
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from deskspark.llm import secrets as S
from deskspark.llm.automaton import Automaton

ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)


def brute(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def base_of(spans):
    return [s for s in spans if s[2] in ("assign", "access", "hex")]


def test_spans_equal_a_regex_engine():
    scanner, draw = S.Scanner(S.RULES), random.Random(3)
    parts = ["token", "Password", "api_key", "APIKEY", "secret", "passwd", '"', "'", " ", "  ", "=", ":", "==", "abc"]
    parts += ["ABCdef012", "AKIA", "AKIA0123456789ABCD", "0123456789abcdef", "é", "\n", ".", "deadbeef", "x", "abcdef0123456"]
    for _ in range(8000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 14)))
        assert base_of(scanner.spans(text.encode())) == brute(text), text


def test_other_formats():
    scanner = S.Scanner(S.RULES)
    texts = {
        "github": "x ghp_" + "aB3" * 12,
        "slack": "xoxb-1234567890-abc",
        "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.TJVA95OrM7E2cBab30RMHr",
        "key": "a\n-----BEGIN RSA PRIVATE KEY-----\n",
    }
    for kind, text in texts.items():
        assert kind in [k for _, _, k in scanner.spans(text.encode())]
    assert scanner.spans(b"ghp_short xoxb-1 eyJa.eyJb.c") == []


def test_automaton_is_minimal_and_exact():
    found = Automaton.compile(["ab|ac", "a[bc]"], anywhere=False)
    assert len(found.table) == 4  # start, after a, accepted, dead
    draw = random.Random(1)
    rules = ["(?:ab|ba)+c?", "[^a]b{2,3}", "a*b"]
    anchored = Automaton.compile(rules, anywhere=False)
    for _ in range(500):
        text = "".join(draw.choice("abc") for _ in range(draw.randint(0, 7))).encode()
        state = 0
        for byte in text:
            state = anchored.table[state, byte]
        want = sum(1 << i for i, r in enumerate(rules) if re.fullmatch(r.encode(), text))
        assert anchored.accepts[state] == want


def test_query_masks_and_odd_rows(frame, odd, prose):
    docs = [(1, f"é token = {'a1' * 10} end"), (2, prose(1)), (2, prose(1)), (3, prose(4, 3000) + " " + "f0" * 5000), *odd]
    found = S.find_secrets(frame(docs), keep_rows=True)
    rows = found.withColumn("masked", S.masked(F.col("row.text"), F.col("spans"))).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = r["row"]["text"] or ""
        spans = [(s["start"], s["end"], s["kind"]) for s in r["spans"]]
        assert base_of(spans) == brute(text)
        hidden = list(text)
        for s, e, _ in spans:
            hidden[s:e] = "*" * (e - s)
        assert (r["masked"] or "") == "".join(hidden)
    report = {r["doc_id"]: r for r in S.secret_counts(S.find_secrets(frame(docs))).collect()}
    assert (report[1]["n_assign"], report[1]["n_hex"], report[3]["n_hex"]) == (1, 1, 1)
    assert S.find_secrets(frame([])).count() == 0


def test_all_kinds_equal_a_regex_engine():
    scanner, draw = S.Scanner(S.RULES), random.Random(11)
    parts = ["eyJ", "eyJhbGci0", ".", ".eyJ", "ghp_", "gho_", "aB3" * 12, "xoxb-", "xox", "-", "1234567890", "-----BEGIN ", "RSA "]
    parts += ["PRIVATE KEY-----", "AKIA", "0123456789ABCDEF", "token=", " ", "é", "deadbeef", "_", "\n"]
    for _ in range(6000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 16)))
        got = sorted(s for s in scanner.spans(text.encode()) if s[2] != "assign")
        want = [
            (m.start(), m.end(), r.kind)
            for r in S.RULES
            if r.kind != "assign"
            for m in re.finditer(r.pattern, text)
            if len(m[0]) >= r.least
        ]
        assert got == sorted(want), text


@pytest.mark.parametrize("unit", ["eyJ", "token", "api_key=token=", "xoxb-1", "-----BEGIN ", "ghp_", "AKIA"])
def test_time_grows_with_the_length(unit):
    """A mark is a match, so no run goes over the same bytes again; these would take hours otherwise."""
    scanner = S.Scanner(S.RULES)
    took = []
    for n in (100_000, 400_000):
        text = (unit * (n // len(unit)) + " token=abcdefghijklmnop").encode()
        started = time.process_time()
        assert len(scanner.spans(text)) >= 1
        took.append(time.process_time() - started)
    assert took[1] < 10 * max(took[0], 0.1)


def test_tables_travel_as_plain_values():
    scanner = S.Scanner.from_plain(pickle.loads(pickle.dumps(S.Scanner(S.RULES).plain())))
    text = b"token=abcdefghijklmnop eyJhbGciOiJI.eyJzdWIiOiIx.TJVA95OrM7E2cBab30RMHr"
    assert scanner.spans(text) == S.Scanner(S.RULES).spans(text) != []

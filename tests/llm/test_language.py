from collections import Counter

import numpy as np
import pytest

from deskspark.llm import language as L


def brute(text):
    spaced = "".join(c if c.isalpha() else " " for c in text.lower())
    told, out = f" {' '.join(spaced.split())} ", Counter()
    for n in (1, 2, 3):
        out.update(told[i : i + n] for i in range(len(told) - n + 1))
    out.pop(" ", None)
    return dict(out) if told.strip() else {}


def spelled(code):
    out, code = "", int(code)
    while code:
        symbol = code & ((1 << 21) - 1)
        out = (" " if symbol == 1 else chr(symbol - 2)) + out
        code >>= 21
    return out


@pytest.mark.parametrize("piece", [1 << 16, 2, 3, 7])
def test_gram_counts(monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE_CHARS", piece)
    for text in ["ab", "Hello, World! ññ é1a", " x ", "a b c d e", "..a..b", "x" * 20, "a.", ".a", "日本 Ω"]:
        codes, counts = L.gram_counts(text)
        assert {spelled(c): int(n) for c, n in zip(codes, counts)} == brute(text)


def test_profile_ranks_and_distance():
    codes = np.arange(1, 7, dtype=np.uint64)
    found = L.Profiles.build({"b": codes[:3], "a": codes[2:6]}, 4)
    assert found.languages == ["a", "b"] and found.ranks[0].tolist() == [4, 4, 0, 1, 2, 3]
    assert found.predict(None) == found.predict("123 ...") == ("und", 0.0)


def test_learned_languages_and_odd_rows(frame, odd):
    words = {"x": "abra cadab", "y": "misso sippi"}
    rows = [(i, words["xy"[i % 2]] * (1 + i % 5), "xy"[i % 2]) for i in range(40)]
    docs = frame([*rows, (40, "no language here", None), *odd])
    profiles = L.learn_profiles(docs, "text", "lang", 20)
    assert profiles.languages == ["x", "y"] and (profiles.ranks < 20).sum(axis=1).max() <= 20
    got = {r["doc_id"]: r for r in L.identify(docs, profiles).collect()}
    assert len(got) == 41 + len(odd) and all(got[i]["lang_pred"] == "xy"[i % 2] for i in range(40))
    assert {got[i]["lang_pred"] for i in (900, 901, 902, 903)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = L.learn_profiles(frame([]), "text", "lang")
    assert nothing.languages == [] and L.identify(frame([(1, "abc")]), nothing).first()["lang_pred"] == "und"


def test_top_grams_equal_a_plain_count(frame):
    rows = [(i, "abc abd " * (i + 1), "x") for i in range(5)]
    total = Counter()
    for _, t, _ in rows:
        total.update(brute(t))
    found = L.learn_profiles(frame(rows), "text", "lang", 4)
    best = sorted(total.items(), key=lambda kv: -kv[1])[:4]
    assert sorted(total[spelled(c)] for c in found.codes) == sorted(n for _, n in best)

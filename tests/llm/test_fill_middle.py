import hashlib
import random

import pytest
from pyspark.sql import functions as F

from deskspark.llm import fill_middle as M


def brute(doc_id, text):
    """n, form, prefix_chars, middle_chars, output, by slicing a list of code points."""
    points = list(text or "")
    n = len(points)
    told = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(told[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not n or any(m in "".join(points) for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, "".join(points)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(points[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_rows_equal_brute_force(frame, odd):
    draw = random.Random(5)
    parts = ["a", "é", "𝄞", "é", "\n", " ", "<", "P>", "<S", ">", "<M>", "<P>", "\\1", "\x00", "\r\n"]
    docs = [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))) for i in range(300)]
    docs += [*odd, (7, docs[7][1]), (7, "other text of the same id"), (301, "x𝄞" * 3000)]
    got = M.rearrange_texts(frame(docs), keep_rows=True)
    back = M.restored(F.col("output"), F.col("form")).alias("back")
    rows = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back, "row.text").collect()
    want = sorted((repr(i), *map(repr, brute(i, t)), repr(t or "")) for i, t in docs)
    assert sorted(tuple(map(repr, r[:7])) for r in rows) == want
    assert all((r.text or "") == r.back for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_digest_columns_and_empty_table(frame):
    cut = M.rearranged_digest(M.rearrange_texts(frame([(4, "some text here"), (5, None)])))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for row, text in zip(cut.orderBy("doc_id").collect(), ("some text here", "")):
        assert row.output_sha256 == sha(brute(row.doc_id, text)[4]) and row.restored_sha256 == sha(text)
    assert M.rearranged_digest(M.rearrange_texts(frame([]))).count() == 0


def test_long_texts_are_matched_in_blocks(monkeypatch):
    whole, block = M.Rearrange().patterns()
    text = "aé𝄞\n" * 500
    want = M.unit_ends(text, whole, block).tolist()
    monkeypatch.setattr(M, "BLOCK_UNITS", 7)
    assert M.unit_ends(text, whole, M.Rearrange().patterns()[1]).tolist() == want == list(range(1, 2001))


def test_other_units_and_marks(frame):
    words = M.Rearrange(seed=9, unit=r"\S*\s+|\S+", moved_percent=100, prefix="[pre]", suffix="[suf]", middle="[mid]")
    docs = [(i, "one two  three four five six") for i in range(40)]
    rows = M.rearrange_texts(frame(docs), words).withColumn("back", M.restored(F.col("output"), F.col("form"), words))
    rows = rows.collect()
    assert all(r.n == 6 and r.back == docs[0][1] and r.form != "plain" for r in rows)
    starts = {0, 4, 9, 15, 20, 25, 28}
    assert all(r.prefix_chars in starts and r.prefix_chars + r.middle_chars in starts for r in rows)
    # Units that do not cover a text leave it as it is.
    letters = M.Rearrange(unit="[a-z]", moved_percent=100)
    assert [r.form for r in M.rearrange_texts(frame([(1, "ab c")]), letters).collect()] == ["plain"]


@pytest.mark.parametrize(
    "wrong", [{"unit": "a*"}, {"prefix": ""}, {"prefix": "<S>x"}, {"prefix": "aba"}, {"prefix": "><", "suffix": "<S>"}]
)
def test_ambiguous_plans_are_refused(wrong):
    with pytest.raises(ValueError):
        M.Rearrange(**wrong)


@pytest.mark.parametrize("seed", [1, 2])
def test_shares(seed):
    cutter = M.Cutter(M.Rearrange(seed=seed))
    forms = [cutter.cut(str(i), "a text to cut")[1] for i in range(3000)]
    assert abs(forms.count("plain") / 3000 - 0.1) < 0.03 and abs(forms.count("spm") / 3000 - 0.18) < 0.03

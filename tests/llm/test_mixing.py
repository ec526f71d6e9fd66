import random

import numpy as np
import pytest

from deskspark.llm import mixing as M


def reachable(lengths, counts):
    sums = {0}
    for length, count in zip(lengths, counts):
        sums = {s + length * k for s in sums for k in range(count + 1)}
    return sums


def test_budget_is_fitted_as_nearly_as_can_be():
    draw = random.Random(2)
    for _ in range(400):
        lengths = np.array(sorted(draw.sample(range(60), draw.randint(1, 7))))
        counts = np.array([draw.randint(1, 5) for _ in lengths])
        budget = draw.randint(0, int((lengths * counts).sum()))
        taken = M.fit_budget(lengths, counts, budget, rest_words=10**6)
        assert (taken >= 0).all() and (taken <= counts).all()
        best = min(abs(s - budget) for s in reachable(lengths.tolist(), counts.tolist()))
        assert abs(int((taken * lengths).sum()) - budget) == best
        taken = M.fit_budget(lengths, counts, budget, rest_words=20)
        assert (taken >= 0).all() and (taken <= counts).all()


@pytest.mark.parametrize("sizes", [[10, 0, 5, 100], [0, 0], [], [7], [1, 1000, 1]])
def test_targets(sizes):
    aims = M.targets(sizes)
    assert all(a <= 2 * s for a, s in zip(aims, sizes))
    assert sum(aims) == pytest.approx(1.5 * sum(sizes) if len(sizes) != 1 else 1.5 * sizes[0])


def test_mix(frame, prose, odd, monkeypatch):
    monkeypatch.setattr(M, "SLICE_ROWS", 16)
    docs = [(i, prose(i, 5 + i % 40), "en", "big") for i in range(300)]
    docs += [(300 + i, prose(i, 12), "en", "same") for i in range(200)]
    docs += [(600 + i, prose(i, 30 + i), "en", None if i % 2 else "") for i in range(40)]
    docs += [(700, prose(1, 3000), "en", "one"), docs[0], *odd]
    rows = M.mix_sources(frame(docs, 5), keep=["source"]).collect()
    again = M.mix_sources(frame(docs, 2), keep=["source"]).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again)) and len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert r["copies"] in (0, 1, 2)
    told = [(s, sum(r["size"] for r in by[s])) for s in sorted((x for x in by if x is not None)) + [None]]
    for (s, size), aim in zip(told, M.targets([n for _, n in told])):
        assert {r["source_size"] for r in by[s]} == {size}
        assert by[s][0]["target"] == pytest.approx(aim)
        taken = sum(r["copies"] * r["size"] for r in by[s])
        slack = {"same": 12, "one": 3000}.get(s, 45)
        assert abs(taken - aim) <= slack
    assert M.mix_sources(frame([])).count() == 0


@pytest.mark.parametrize("slice_rows", [7, 4096])
def test_equal_rows_are_split_where_the_cut_lies(frame, monkeypatch, slice_rows):
    """One row a thousand times: every source still comes within one document of its target."""
    monkeypatch.setattr(M, "SLICE_ROWS", slice_rows)
    docs = [(1, "ten words in all of this one text right here", "en", "a")] * 1000
    docs += [(2, "a b c", "en", "a")] * 7 + [(i, "x " * (i % 9), "en", "b") for i in range(10, 300)]
    docs += [(5, "w " * 20, "en", "c")] * 40 + [(6, None, "en", "c"), (6, "", "en", "c")]
    for keep in ([], ["source"]):
        rows = M.mix_sources(frame(docs, 5), keep=keep).collect()
        again = M.mix_sources(frame(docs, 3), keep=keep).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again)) and len(rows) == len(docs)
        sizes = {"a": 1000 * 10 + 21, "b": sum(i % 9 for i in range(10, 300)), "c": 800}
        for (name, size), aim in zip(sizes.items(), M.targets(list(sizes.values()))):
            mine = [r for r in rows if r["source_size"] == size]
            longest = max(r["size"] for r in mine)
            assert abs(sum(r["copies"] * r["size"] for r in mine) - aim) <= longest, name
            assert all(0 <= r["copies"] <= 2 for r in mine) and {r["target"] for r in mine} == {aim}
        # Some of the equal rows are due one copy more than the others.
        alike = [r["copies"] for r in rows if r["doc_id"] == 1]
        assert len(alike) == 1000 and max(alike) - min(alike) == 1

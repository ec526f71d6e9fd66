import hashlib
import random

import pytest

from deskspark.llm import suffix_dedup as S
from deskspark.llm.repeats import find_repeats


def groups_of(strings, least):
    places = {}
    for i, s in enumerate(strings):
        for a in range(len(s)):
            for b in range(a + least, len(s) + 1):
                places.setdefault(s[a:b], []).append((i, a))
    out = set()
    for w, o in places.items():
        left = {strings[i][a - 1] if a else None for i, a in o}
        right = {strings[i][a + len(w)] if a + len(w) < len(strings[i]) else None for i, a in o}
        if len(o) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
            out.add((len(w), tuple(sorted(o))))
    return out


def test_maximal_repeats_and_reach():
    draw = random.Random(5)
    for _ in range(150):
        strings = list({bytes(draw.choice(b"aab") for _ in range(draw.randint(5, 40))) for _ in range(draw.randint(1, 5))})
        owners = [draw.randint(0, 4) for _ in strings]
        found = find_repeats(strings, owners, 8)
        got = {
            (d, tuple(sorted((int(found.string[k]), int(found.offset[k])) for k in range(a, b + 1))))
            for d, a, b in found.groups
        }
        assert got == groups_of(strings, 8)
        covered = [set() for _ in strings]
        for s, o, r in zip(found.string, found.offset, found.reach):
            covered[s].update(range(o, o + r))
        least, want = {}, [set() for _ in strings]
        for s, d in zip(strings, owners):
            for a in range(len(s) - 7):
                least[s[a : a + 8]] = min(least.get(s[a : a + 8], 9), d)
        for i, (s, d) in enumerate(zip(strings, owners)):
            for a in range(len(s) - 7):
                if least[s[a : a + 8]] < d:
                    want[i].update(range(a, a + 8))
        assert covered == want


def brute(rows):
    least, out = {}, []
    told = [(d, (t or "").encode(), 1 << 63 if d is None else d) for d, t in rows]
    for _, b, k in told:
        for a in range(len(b) - 49):
            least[b[a : a + 50]] = min(least.get(b[a : a + 50], 1 << 64), k)
    for d, b, k in told:
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if least[b[a : a + 50]] < k:
                gone[a : a + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot, chunk, run", [(1000, 8 << 20, 256), (1, 3_000, 5)])
def test_removal(frame, prose, odd, monkeypatch, hot, chunk, run):
    monkeypatch.setattr(S, "HOT_CHUNKS", hot)
    monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(S, "RUN_STRETCHES", run)
    monkeypatch.setattr(S, "BLOCK_BYTES", 1 << 20 if hot > 1 else 700)
    passage, line = prose(77, 25), "One very common line, thirty bytes"
    docs = [(i, f"{prose(i, 20)}\n{passage if i % 3 == 0 else ''}{line}{prose(500 + i, 20)}") for i in range(25)]
    docs += [(40, prose(3, 60)), (41, prose(3, 60)), (41, prose(3, 60)), (42, "ab" * 400), (39, "ab" * 900), *odd]
    docs += [(43, passage[:49]), (44, "x" + passage[:50])]
    got = sorted((tuple(r) for r in S.removal_report(S.drop_repeats(frame(docs))).collect()), key=repr)
    assert got == brute(docs)


def test_empty_table(frame):
    assert S.drop_repeats(frame([])).count() == 0

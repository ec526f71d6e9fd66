"""Repeats among byte strings: an enhanced suffix array and its tree of common-prefix intervals.

The suffixes that begin a repeated stretch are sorted, and one scan over the
lengths of their common prefixes keeps a stack of open intervals. An interval
whose suffixes do not all follow the same byte cannot be extended to the left:
its prefix is a maximal repeat, and its suffixes are all places of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

_LEAF = 1 << 60
_MIXED = -2
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Odd factors, the powers of one, for up to 16 words.
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(16)], np.uint64)


def words_at(data: np.ndarray) -> np.ndarray:
    """Every position read as eight bytes."""
    n = len(data) - 7
    return np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)) if n > 0 else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x ^= x >> np.uint64(29)
    return x


def stretch_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from every position on; ``width`` is at least 8.

    A sum of the words with odd factors, mixed once.
    """
    u = words_at(data)
    n = max(len(data) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for k, at in enumerate([*range(0, width - 8, 8), width - 8]):
        out += u[at : at + n] * _FACTORS[k]
    return mixed(out)


@dataclass
class _Interval:
    """An open interval: its depth, first suffix, least owner, the byte before, and two kinds of suffixes."""

    depth: int
    first: int
    least: int
    before: int
    open: list[int] = field(default_factory=list)
    met: list[int] = field(default_factory=list)


def _suffix_order(strings: Sequence[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String and offset of the sorted suffixes, and the common prefix of each with the one before.

    Only suffixes whose first ``least`` bytes occur more than once take part.
    """
    raw = b"".join(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(lengths)
    hashes = stretch_hashes(np.frombuffer(raw, np.uint8), least)
    inside = np.zeros(len(raw) + 1, np.int64)
    long_ = lengths >= least
    np.add.at(inside, (ends - lengths)[long_], 1)
    np.add.at(inside, (ends - least + 1)[long_], -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(hashes)] > 0)
    sorted_ = np.sort(hashes[starts])
    twice = sorted_[1:][sorted_[1:] == sorted_[:-1]]
    if not len(twice):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, hashes[starts]), len(twice) - 1)
    starts = starts[twice[at] == hashes[starts]]
    owner = np.searchsorted(ends, starts, "right")
    stops = ends[owner]
    suffixes = [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    shared = np.zeros(len(order), np.int64)
    for low in range(0, len(order), 8192):
        part = order[max(0, low - 1) : low + 8192]
        width = max(len(suffixes[i]) for i in part)
        table = np.frombuffer(b"".join(suffixes[i].ljust(width, b"\0") for i in part), np.uint8).reshape(-1, width)
        size = np.array([len(suffixes[i]) for i in part], np.int64)
        same = np.minimum(np.logical_and.accumulate(table[1:] == table[:-1], axis=1).sum(axis=1), np.minimum(size[1:], size[:-1]))
        shared[max(1, low) : low + len(same) + (1 if low == 0 else 0)] = same
    picked = np.array(order, np.int64)
    return owner[picked], (starts - (stops - lengths[owner]))[picked], shared


@dataclass
class Repeats:
    """Sorted suffixes, the maximal repeats among them, and how far each repeats an earlier owner.

    ``groups`` has ``(length, first, last)``: suffixes ``first`` to ``last`` are
    all places of a maximal repeat. ``reach`` is the length from each suffix on
    that a smaller owner also has, 0 where the suffix one byte to the left says more.
    """

    string: np.ndarray
    offset: np.ndarray
    groups: list[tuple[int, int, int]]
    reach: np.ndarray


def find_repeats(strings: Sequence[bytes], owners: Sequence[int], least: int) -> Repeats:
    """Maximal repeats of at least ``least`` bytes. Bytes beyond a string's ends count as all different.

    Every suffix leaves the scan at the deepest interval that also holds a
    smaller owner, so the work is linear in the suffixes, however deeply the
    intervals nest.
    """
    string, offset, shared = _suffix_order(strings, least)
    n = len(string)
    reach = np.zeros(n, np.int64)
    groups: list[tuple[int, int, int]] = []
    owner_of = [owners[s] for s in string.tolist()]
    before = [strings[s][o - 1] if o else _MIXED for s, o in zip(string.tolist(), offset.tolist())]
    common = [*shared.tolist(), 0]
    stack: list[_Interval] = []

    def join(node: _Interval, child: _Interval) -> None:
        low, high = (node, child) if node.least <= child.least else (child, node)
        node.met += high.open if low.least < high.least else []
        if low.least == high.least:
            longer, shorter = (low, high) if len(low.open) >= len(high.open) else (high, low)
            longer.open += shorter.open
            node.open = longer.open
        else:
            node.open = low.open
        node.least = low.least
        if node.before != child.before:
            node.before = _MIXED

    def close(node: _Interval, last: int) -> None:
        if node.before == _MIXED:
            groups.append((node.depth, node.first, last))
            for i in node.met:
                reach[i] = node.depth
        node.met = []

    for i in range(n):
        current = _Interval(_LEAF, i, owner_of[i], before[i], [i])
        ahead = common[i + 1]
        while stack and stack[-1].depth >= ahead:
            top = stack.pop()
            join(top, current)
            current = top
            if top.depth == ahead:
                break
            close(top, i)
        if ahead >= least:
            if current.depth == ahead:
                stack.append(current)
            else:
                stack.append(_Interval(ahead, current.first, current.least, current.before, current.open))
    return Repeats(string, offset, groups, reach)

"""Rule regexes compiled into one minimal deterministic automaton over bytes.

``re`` is used for its parser only. Each rule becomes a non-deterministic
automaton (Thompson), all rules together are made deterministic by subset
construction over classes of equal bytes, and Moore's partition refinement
makes the result minimal. States carry the rules that accept there.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_parser, _ops = re._parser, re._constants


class _Nfa:
    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.jumps: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.jumps.append([])
        return len(self.moves) - 1

    def turn(self, start: int) -> None:
        """Turn all steps around, but for the jumps from ``start``."""
        moves, jumps = [[] for _ in self.moves], [[] for _ in self.jumps]
        for s, (steps, skips) in enumerate(zip(self.moves, self.jumps)):
            for chars, t in steps:
                moves[t].append((chars, s))
            for t in skips:
                jumps[start if s == start else t].append(t if s == start else s)
        self.moves, self.jumps = moves, jumps

    def add(self, parsed, start: int) -> int:
        """States for a parsed regex from ``start`` on; returns its end."""
        for op, arg in parsed:
            start = self._one(op, arg, start)
        return start

    def _step(self, start: int, chars: frozenset[int]) -> int:
        end = self.state()
        self.moves[start].append((chars, end))
        return end

    def _one(self, op, arg, start: int) -> int:
        if op is _ops.LITERAL:
            return self._step(start, frozenset([arg]))
        if op is _ops.NOT_LITERAL:
            return self._step(start, frozenset(range(256)) - {arg})
        if op is _ops.IN:
            return self._step(start, _members(arg))
        if op is _ops.SUBPATTERN:
            return self.add(arg[-1], start)
        if op is _ops.BRANCH:
            end = self.state()
            for branch in arg[1]:
                first = self.state()
                self.jumps[start].append(first)
                self.jumps[self.add(branch, first)].append(end)
            return end
        if op is _ops.MAX_REPEAT:
            least, most, inner = arg
            for _ in range(least):
                start = self.add(inner, start)
            if most is _ops.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.jumps[start].append(loop)
                self.jumps[self.add(inner, loop)].append(loop)
                self.jumps[loop].append(end)
                return end
            end = self.state()
            self.jumps[start].append(end)
            for _ in range(most - least):
                start = self.add(inner, start)
                self.jumps[start].append(end)
            return end
        raise ValueError(f"Rules cannot use {op}")


def _members(parts) -> frozenset[int]:
    out, negated = set(), False
    for op, arg in parts:
        if op is _ops.NEGATE:
            negated = True
        elif op is _ops.LITERAL:
            out.add(arg)
        elif op is _ops.RANGE:
            out.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"Rules cannot use {op}")
    return frozenset(range(256)) - out if negated else frozenset(out)


def _byte_classes(nfa: _Nfa) -> np.ndarray:
    """Class number of each byte; bytes of a class are in the same character sets."""
    sets = sorted({tuple(sorted(chars)) for moves in nfa.moves for chars, _ in moves})
    marks = np.zeros((256, len(sets)), bool)
    for i, chars in enumerate(sets):
        marks[list(chars), i] = True
    return np.unique(marks, axis=0, return_inverse=True)[1].reshape(-1)


@dataclass
class Automaton:
    """``table[state, byte]`` is the next state, ``accepts[state]`` a bit mask of rules, ``hopes[state]``
    the rules that can still accept from there on."""

    table: np.ndarray
    accepts: np.ndarray
    hopes: np.ndarray

    @classmethod
    def compile(
        cls, rules: Sequence[str], anywhere: bool, absorbing: bool = False, backward: bool = False
    ) -> "Automaton":
        """One automaton for all rules, matching from the first byte or from ``anywhere``.

        ``absorbing`` stays where a rule has accepted: the last state then tells
        whether any rule matched. ``backward`` reads a text from its end: a rule
        accepts where a match of it begins.
        """
        nfa = _Nfa()
        start = nfa.state()
        ends = {}
        for i, rule in enumerate(rules):
            first = nfa.state()
            end = nfa.add(_parser.parse(rule.encode()), first)
            here, there = (end, first) if backward else (first, end)
            nfa.jumps[start].append(here)
            ends[there] = i
        if backward:
            nfa.turn(start)
        classes = _byte_classes(nfa)
        sample = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]

        def closed(states: set[int]) -> frozenset[int]:
            todo, out = list(states), set(states)
            while todo:
                for s in nfa.jumps[todo.pop()]:
                    if s not in out:
                        out.add(s)
                        todo.append(s)
            return frozenset(out)

        def rules_of(states: frozenset[int]) -> int:
            return sum(1 << ends[s] for s in states if s in ends)

        origin = closed({start})
        number, order, rows = {origin: 0}, [origin], []
        for here in order:
            row = []
            mask = rules_of(here)
            for byte in sample:
                if absorbing and mask:
                    row.append(number[here])
                    continue
                onward = {t for s in here for chars, t in nfa.moves[s] if byte in chars}
                after = closed(onward | {start}) if anywhere else closed(onward)
                if after not in number:
                    number[after] = len(order)
                    order.append(after)
                row.append(number[after])
            rows.append(row)
        table = np.array(rows, np.int64)
        accepts = np.array([rules_of(s) for s in order], np.int64)
        table, accepts = _minimal(table, accepts)
        hopes = accepts.copy()
        while True:
            more = hopes | np.bitwise_or.reduce(hopes[table], axis=1)
            if (more == hopes).all():
                break
            hopes = more
        return cls(table[:, classes].astype(np.int32), accepts, hopes)

    def linked(self) -> list[list]:
        """States as lists of the next states by byte; item 256 is the accept mask, 257 the hopes."""
        states: list[list] = [[] for _ in self.table]
        for s, row in zip(states, self.table.tolist()):
            s.extend(states[t] for t in row)
        for s, accept, hope in zip(states, self.accepts.tolist(), self.hopes.tolist()):
            s += [accept, hope]
        return states


def _minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that accept the same and lead to merged states; the first state stays first."""
    block = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    _, first = np.unique(block, return_index=True)
    rank = np.argsort(np.argsort(first))
    keep = np.sort(first)
    return rank[block[table[keep]]], accepts[keep]

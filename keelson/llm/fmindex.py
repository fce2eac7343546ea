"""Bidirectional FM-index of one shard's word ids, for patterns of bounded length.

The text is a sequence of ids with 0 between pieces. Both it and its reverse are sorted by their first ``depth - 1`` symbols only; the transform of such an
order still maps the interval of a pattern to that of any extension of at most ``depth - 1`` symbols, and tells the counts of those of ``depth``. A pattern
is held as its interval in both orders at once (``Patterns``). Extending to the left is a backward step on the forward transform, which also tells,
by the symbols that come before, where the extension lies in the reverse order; extending to the right is the mirror image. One call
extends all patterns by all symbols that occur. Each order is made when it is first needed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Patterns:
    """Patterns of one length: occurrences, symbols, and first rows in the forward and in the reverse order (none for the longest)."""
    count: np.ndarray
    symbols: np.ndarray
    lo: np.ndarray | None = None
    back: np.ndarray | None = None


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    step = np.zeros(len(key), np.int64)
    np.cumsum(ordered[1:] != ordered[:-1], out=step[1:])
    out = np.empty(len(key), np.int64)
    out[order] = step
    return out


def bounded_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``text`` in the order of their first ``depth`` symbols (by doubling the sorted width)."""
    rank, width = text, 1
    while True:
        step = min(width, depth - width)
        key = rank.astype(np.int64) * (int(rank.max()) + 1) + np.roll(rank, -step) if step else rank
        width += step
        if width >= depth:
            return np.argsort(key, kind="stable")
        rank = _ranks(key)


class _Side:
    """One order of the text: which symbol precedes each row, and where a row goes when that symbol is put in front."""

    def __init__(self, text: np.ndarray, depth: int):
        self.before = text[bounded_order(text, depth) - 1]
        self._to: np.ndarray | None = None

    def step(self, rows: np.ndarray) -> np.ndarray:
        if self._to is None:
            self._to = np.empty(len(self.before), np.int64)
            self._to[np.argsort(self.before, kind="stable")] = np.arange(len(self.before))
        return self._to[rows]


class FMIndex:
    """``text`` begins and ends with 0, so no pattern runs from its end to its start."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        self.sigma = int(text.max()) + 1
        self.size = np.bincount(text, minlength=self.sigma)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self._sides: dict[bool, _Side] = {}

    def _side(self, forward: bool) -> _Side:
        if forward not in self._sides:
            self._sides[forward] = _Side(self.text if forward else self.text[::-1], max(1, self.depth - 1))
        return self._sides[forward]

    def single(self) -> Patterns:
        """All symbols but the separator."""
        s = np.flatnonzero(self.size[1:]) + 1
        return Patterns(self.size[s], s[:, None], self.first[s], self.first[s])

    def _extend(self, forward: bool, lo: np.ndarray, other: np.ndarray, count: np.ndarray, last: bool):
        """(pattern, symbol, count, interval, interval in the other order) of all extensions; no intervals for the ``last``."""
        side = self._side(forward)
        start = np.cumsum(count) - count
        which = np.repeat(np.arange(len(lo)), count)
        rows = np.arange(len(which)) + np.repeat(lo - start, count)
        key = which * self.sigma + side.before[rows]
        if last:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        times = np.diff(np.append(edge, len(key)))
        parent, sym = np.divmod(key[edge], self.sigma)
        real = sym > 0
        if last:
            return parent[real], sym[real], times[real], None, None
        to = side.step(rows[order[edge[real]]])
        return parent[real], sym[real], times[real], to, (other[parent] + edge - start[parent])[real]

    def left(self, p: Patterns) -> Patterns:
        """Every pattern with one symbol more in front."""
        parent, sym, count, lo, back = self._extend(True, p.lo, p.back, p.count, p.symbols.shape[1] + 1 == self.depth)
        return Patterns(count, np.column_stack([sym, p.symbols[parent]]), lo, back)

    def right(self, p: Patterns) -> Patterns:
        """Every pattern with one symbol more behind."""
        parent, sym, count, back, lo = self._extend(False, p.back, p.lo, p.count, p.symbols.shape[1] + 1 == self.depth)
        return Patterns(count, np.column_stack([p.symbols[parent], sym]), lo, back)

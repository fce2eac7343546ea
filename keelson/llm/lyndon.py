"""Suffix arrays by linear grouping, for many byte strings in step.

Every suffix belongs to the group of its Lyndon prefix (the longest prefix that is smaller than all of its own proper
suffixes). Grouping starts from the first characters and processes the groups from the highest to the lowest: each
member's previous-smaller pointer names the nearest position to its left that is still unprocessed, and that
position's prefix grows by the member's. Positions hit once, twice, ... leave their group for new ones just above it,
in that order. A processed group is final. The unprocessed positions form a linked list in text order, so a pointer is
the left neighbour, and members that are neighbours in the list hit one position together.

With all groups known, the order is emitted from the smallest suffix up: the suffix at each rank places, group by
group, the positions whose Lyndon prefixes end where it begins (the position before it, then along previous-smaller
pointers). Nothing is renamed or sorted again.

One string's groups must be taken one after another. Many strings don't depend on each other, so each numpy step
takes the current group of every string; the cost per suffix is a few array operations and the number of steps is that
of the string with the most groups.
"""

from __future__ import annotations

import numpy as np


def ragged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges lo..hi, one range after the other."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


def suffix_arrays(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Suffix arrays of the strings symbols[offsets[k]:offsets[k+1]], in one array of positions in ``symbols`` with each
    string's suffixes in its own slice. Symbols are non-negative integers under 2^20."""
    n, strings = len(symbols), len(offsets) - 1
    if n == 0:
        return np.empty(0, np.int64)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(strings), size)
    order = np.argsort((owner << 20) | symbols, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    key = ((owner << 20) | symbols)[order]
    first = np.append(True, key[1:] != key[:-1])
    begin = np.flatnonzero(first)
    group = np.empty(n, np.int64)                       # first rank of each position's group
    group[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    members = np.zeros(n + 1, np.int64)                 # by first rank
    members[begin] = np.diff(np.append(begin, n))
    # list of unprocessed positions; -1 is the left end of a string, n the right end
    left = np.arange(-1, n - 1)
    left[offsets[:-1][size > 0]] = -1
    right = np.arange(1, n + 2)
    right[offsets[1:][size > 0] - 1] = n
    left, right = np.append(left, -1), right
    smaller = np.full(n, -1, np.int64)                  # previous-smaller pointers
    top = offsets[1:].copy()
    live = np.flatnonzero(size > 0)
    base = offsets[:-1]
    while len(live):
        lo = group[order[top[live] - 1]]
        i = np.sort(order[ragged(lo, top[live])])
        top[live] = lo
        live = live[lo > base[live]]
        # runs of members that are neighbours in the list
        l = left[i]
        head = np.ones(len(i), bool)
        head[1:] = l[1:] != i[:-1]
        h = np.flatnonzero(head)
        times = np.diff(np.append(h, len(i)))
        j = l[h]                                        # what each run hits
        smaller[i] = np.repeat(j, times)
        after = right[i[h + times - 1]]
        left[after] = j                                 # (cell n takes writes of right ends)
        some = j >= 0
        right[j[some]] = after[some]
        j, times = j[some], times[some]
        if not len(j):
            continue
        # regroup: those hit move to the top of their group, by the number of hits
        g = group[j]
        by = np.lexsort((times, g))
        j, g, times = j[by], g[by], times[by]
        fresh = np.append(True, g[1:] != g[:-1])
        f = np.flatnonzero(fresh)
        hit = np.diff(np.append(f, len(j)))
        g0 = g[f]
        slot0 = g0 + members[g0] - hit
        slot = np.arange(len(j)) - np.repeat(f, hit) + np.repeat(slot0, hit)
        old = rank[j]
        stays = order[slot]                             # who is in those places now
        moved = np.zeros(len(j), bool)                  # ... and is not itself hit
        mark = smaller[stays]
        smaller[j] = -2
        moved = smaller[stays] != -2
        smaller[j] = -1
        del mark
        away = np.sort(old[old < np.repeat(slot0, hit)])
        gone = stays[moved]                             # slots ascend, so these match ``away`` group by group
        order[away] = gone
        rank[gone] = away
        order[slot] = j
        rank[j] = slot
        members[g0] -= hit
        part = fresh | np.append(True, times[1:] != times[:-1])
        p = np.flatnonzero(part)
        count = np.diff(np.append(p, len(j)))
        start = slot[p]
        members[start] = count
        group[j] = np.repeat(start, count)
    return _emit(n, offsets, size, group, smaller)


def _emit(n: int, offsets: np.ndarray, size: np.ndarray, group: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """The order within groups: each suffix, from the smallest up, places the positions whose prefixes it follows."""
    out = np.full(n, -1, np.int64)
    fill = np.zeros(n, np.int64)                        # next free rank of a group, less its first
    placed = np.zeros(n + 1, bool)
    base = offsets[:-1]
    live = np.flatnonzero(size > 0)
    nxt = base.copy()                                   # next rank to read, by string
    last = offsets[1:] - 1
    chain, owner = last[live], live                     # the empty suffix comes first: it is followed by nothing
    while True:
        while len(chain):
            g = group[chain]
            out[g + fill[g]] = chain
            fill[g] += 1
            placed[chain] = True
            chain = smaller[chain]
            go = (chain >= 0) & ~placed[chain]
            chain, owner = chain[go], owner[go]
        live = live[nxt[live] <= last[live]]
        if not len(live):
            return out
        s = out[nxt[live]]
        nxt[live] += 1
        chain = s - 1
        go = (chain >= base[live]) & ~placed[chain]
        chain, owner = chain[go], live[go]

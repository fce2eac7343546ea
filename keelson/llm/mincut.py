"""Minimum cut of a labelling graph: terminal capacities (a signed cost per node) and smoothness edges."""

from __future__ import annotations


def decided(unary: list[int], edges: list[tuple[int, int, int]]) -> list[bool | None]:
    """Labels that every minimum cut shares because a node's cost outweighs all its edges, carried on to its neighbours; None: open."""
    n = len(unary)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    cost, pull = list(unary), [sum(w for _, w in x) for x in near]
    label: list[bool | None] = [None] * n
    todo = [i for i in range(n) if abs(cost[i]) > pull[i]]
    while todo:
        i = todo.pop()
        if label[i] is not None:
            continue
        label[i] = cost[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                cost[j] += w if label[i] else -w
                pull[j] -= w
                if abs(cost[j]) > pull[j]:
                    todo.append(j)
    return label


def label(unary: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the source side of a minimum cut. A node on the source side pays ``-unary`` if its cost is negative, one on the sink side pays
    ``unary`` if it is positive, and an edge pays its weight if its ends differ. Of several minimum cuts the largest source side is taken."""
    known = decided(unary, edges)
    left = [i for i, x in enumerate(known) if x is None]
    if not left:
        return [bool(x) for x in known]
    place = {i: k for k, i in enumerate(left)}
    n = len(left)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a, b, forth, back):
        arcs[a].append(len(to))
        to.append(b)
        room.append(forth)
        arcs[b].append(len(to))
        to.append(a)
        room.append(back)

    cost = [unary[i] for i in left]
    for a, b, w in edges:
        if known[a] is None and known[b] is None:
            join(place[a], place[b], w, w)
        elif known[a] is None:
            cost[place[a]] += w if known[b] else -w
        elif known[b] is None:
            cost[place[b]] += w if known[a] else -w
    for k, c in enumerate(cost):
        if c > 0:
            join(source, k, c, 0)
        elif c < 0:
            join(k, sink, -c, 0)

    while True:                                     # blocking flows on level graphs
        level = [-1] * (n + 2)
        level[source] = 0
        front = [source]
        while front and level[sink] < 0:
            after = []
            for x in front:
                for e in arcs[x]:
                    if room[e] and level[to[e]] < 0:
                        level[to[e]] = level[x] + 1
                        after.append(to[e])
            front = after
        if level[sink] < 0:
            break
        tried = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if not room[e])
                x = to[path[cut] ^ 1]
                del path[cut:]
                continue
            moved = False
            while tried[x] < len(arcs[x]):
                e = arcs[x][tried[x]]
                if room[e] and level[to[e]] == level[x] + 1:
                    path.append(e)
                    x = to[e]
                    moved = True
                    break
                tried[x] += 1
            if not moved:
                if x == source:
                    break
                e = path.pop()
                x = to[e ^ 1]
                tried[x] += 1

    reach = [False] * (n + 2)                       # who can still send to the sink
    reach[sink] = True
    front = [sink]
    while front:
        y = front.pop()
        for e in arcs[y]:
            x = to[e]
            if room[e ^ 1] and not reach[x]:
                reach[x] = True
                front.append(x)
    return [not reach[place[i]] if x is None else x for i, x in enumerate(known)]


def cost_of(labels: list[bool], unary: list[int], edges: list[tuple[int, int, int]]) -> int:
    """What a labelling pays."""
    return sum(-c if x and c < 0 else c if not x and c > 0 else 0 for x, c in zip(labels, unary)) + \
        sum(w for a, b, w in edges if labels[a] != labels[b])

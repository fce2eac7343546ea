"""Plain-Python models and small tables for the corpus operators."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NON_BLANK = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def lower(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def documents(spark, rows, extra: bool = False):
    """documents rows of (doc_id, text); ``extra`` adds columns whose names clash with the operators' own."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    if extra:
        ddl += ", n long, cid string, block long, spans string, score string, keep string, label string, mark string, row int"
        full = [r + (1, "x", 2, "y", "z", "w", None, "m", 3) for r in full]
    return spark.createDataFrame(full, ddl)


def covered(docs: list[tuple[int, str | None]], length: int = 50) -> list[tuple[int, int, tuple, bytes]]:
    """(doc_id, n_bytes, removed spans, kept bytes) by brute force over all windows."""
    first: dict[bytes, int] = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w not in first or i < first[w]:
                first[w] = i
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone, done = bytearray(len(b)), 0
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                for q in range(max(p, done), p + length):
                    gone[q] = 1
                done = p + length
        spans = tuple(m.span() for m in re.finditer(b"\x01+", bytes(gone)))
        out.append((i, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def shingle_groups(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    """(doc_id, n_shingles, component_id) by brute force over all pairs that share a shingle."""
    sets = []
    for _, t in docs:
        w = NON_BLANK.findall(lower(t))
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)})
    by_shingle: dict[tuple, list[int]] = {}
    for k, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j, o in Counter(j for x in s for j in by_shingle[x] if j < k).items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                parent[find(k)] = find(j)
    low: dict[int, int] = {}
    for k, (i, _) in enumerate(docs):
        low[find(k)] = min(i, low.get(find(k), i))
    return sorted((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(docs))


def overlaps(docs, items) -> list[tuple[int, int, int, tuple]]:
    """(doc_id, n_words, n_hit, items) by looking up every window of every text."""
    windows: dict[tuple, set] = {}
    for name, t in items:
        w = WORD.findall(lower(t))
        size = min(13, len(w))
        for p in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[p:p + size]), set()).add(name)
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w = WORD.findall(lower(t))
        hit, names = set(), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                if found := windows.get(tuple(w[p:p + size])):
                    names |= found
                    hit |= set(range(p, p + size))
        out.append((i, len(w), len(hit), tuple(sorted(names))))
    return sorted(out, key=repr)

"""Suffix-array dedup: removes every byte covered by a ``LENGTH``-byte string that also starts in an earlier document.

Texts travel as compressed blocks of bounded size, and everything about them as packed arrays per (block, column
bucket), so a shuffle has few rows whatever the data.

1. *Exact copies.* A text that equals one of a smaller id is wholly covered; only the first of equal texts goes on.
2. *Anchors.* A window of ``LENGTH`` bytes belongs to the smallest hash of its ``GRAM``-byte strings, so equal windows
   have equal keys wherever they occur. Consecutive windows of one key form a run. Blocks report their distinct keys by hash
   bucket; a key in one document only cannot repeat, and its runs are out. Nothing else is ever dropped.
3. *Suffix arrays.* The distinct byte pieces of the remaining runs are dealt by key. Equal pieces (by hash, then byte by
   byte) become one; pieces of a key are cut down to the windows that another of them has too, and cut where their
   surroundings part. Of what is left, the pieces that hold a window in common are one string, sorted by ``lyndon.suffix_arrays`` (linear grouping by Lyndon
   prefixes); windows that are neighbours in the order and agree on ``LENGTH`` bytes are one class, whose smallest document
   id answers for each of its windows. A piece that holds no window in common with another is such a class by itself, which
   no order changes. A key with more than ``HOT`` occurrences is dealt on by window instead, so no key's pieces pile up in
   one task.
4. *Removal.* Each block gets its answers back and marks the bytes of windows whose answer is below the document's id.

Defined cases: a null text counts as empty; texts under ``LENGTH`` bytes are kept whole; matches never cross documents;
repetition inside one document, or between rows of one id, removes nothing; a row without an id has no place in the order, so it is kept whole and removes
nothing; overlapping windows make one span. What is
left may cut a UTF-8 character, so it is binary. Extra columns are ignored. A text is never split: memory follows the longest.

What a block says to a bucket is one row, so there are as many rows as blocks times buckets. Both grow with the input; from
``MANY`` shuffle partitions on there is one bucket to each, and blocks grow to ``WIDEST`` times ``BLOCK_BYTES``. Blocks are
worked on in steps of ``STEP_BYTES``, buckets in groups of keys of ``PLAN_BYTES``, whatever their size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import PrefixHash, known_ids, mix64, scratch_table, string_array, text_chunks
from keelson.llm.lyndon import ragged, suffix_arrays
from keelson.session import scratch_path

LENGTH = 50
GRAM = 20
HOT = 4096
BLOCK_BYTES = 2 << 20
STEP_BYTES = 128 << 10      # arrays over a step stay in a core's cache
PLAN_BYTES = 1 << 20
MANY, WIDEST = 256, 8
SORT_BYTES = 4 << 20
BROADCAST_ROWS = 500_000
_U = np.uint64
_ZSTD = pa.Codec("zstd", compression_level=3)


def _pack(a: np.ndarray | bytes) -> bytes:
    raw = a if isinstance(a, bytes) else a.tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True) if raw else b""


def _unpack(b: bytes) -> bytes:
    return _ZSTD.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True) if b else b""


def _array(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(_unpack(b), kind)


def dealing(parts: int) -> tuple[int, int]:
    """Buckets, and bytes of a block, for so many shuffle partitions."""
    buckets = min(1 << 20, max(parts, min(4 * parts, MANY)))    # as many as the hash bits kept for them can tell apart
    return buckets, BLOCK_BYTES * min(WIDEST, max(1, WIDEST * parts // (2 * MANY)))


def _blocks(block_bytes: int):
    """Documents packed into blocks: ids, sizes in bytes, compressed text."""
    def run(batches):
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, _ = known_ids(b.column(0))
            for at, buf, off in text_chunks(string_array(b, "text"), block_bytes):
                block += 1
                n = len(off) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([_pack(ids[at:at + n])], pa.binary()),
                     pa.array([_pack(np.diff(off))], pa.binary()), pa.array([_pack(buf.tobytes())], pa.binary())],
                    ["block", "ids", "sizes", "text"])
    return run


def _steps(off: np.ndarray):
    """(first, end) of the documents of a block that are worked on at a time: one, or at most ``STEP_BYTES``."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + STEP_BYTES, side="right")) - 1))
        yield i, j
        i = j


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bytes and offsets of a block."""
    off = np.concatenate([[0], np.cumsum(_array(row["sizes"], np.int64))])
    return _array(row["ids"], np.int64), np.frombuffer(_unpack(row["text"]), np.uint8), off


def runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, key) of the maximal runs of windows with one key."""
    none = np.empty(0, np.int64)
    if len(buf) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    low = PrefixHash(buf).windows(GRAM)
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:                            # minima of 2, 4, 8, ... neighbours, then of ``width``
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:len(low)]
    whole = np.arange(len(low)) + LENGTH <= off[1:][row]
    new = np.append(True, (low[1:] != low[:-1]) | (row[1:] != row[:-1]))
    start = np.flatnonzero(new & whole)
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    windows = np.add.reduceat(whole.astype(np.int64), start)
    return row[start], start, windows, low[start]


def block_runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``runs`` of a whole block, step by step."""
    out = [(i, off[i], *runs(buf[off[i]:off[j]], off[i:j + 1] - off[i])) for i, j in _steps(off)]
    return (np.concatenate([row + i for i, _, row, _, _, _ in out]), np.concatenate([start + at for _, at, _, start, _, _ in out]),
            np.concatenate([x[4] for x in out]), np.concatenate([x[5] for x in out]))


def block_hashes(buf: np.ndarray, off: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of spans of a block's documents, step by step."""
    out = np.empty(len(start), np.uint64)
    for i, j in _steps(off):
        mine = np.flatnonzero((row >= i) & (row < j))
        at = start[mine] - off[i]
        out[mine] = PrefixHash(buf[off[i]:off[j]]).spans(at, at + size[mine])
    return out


def _stable_order(values: np.ndarray, bits: int) -> np.ndarray:
    """``argsort`` of non-negative integers of so many bits, equal ones in their order; sorted with their places in the low bits where
    these fit, as that is several times faster."""
    low = max(1, len(values)).bit_length()
    if bits + low > 64:
        return np.argsort(values, kind="stable")
    return (np.sort(values.astype(np.uint64) << _U(low) | np.arange(len(values), dtype=np.uint64)) & _U((1 << low) - 1)).astype(np.int64)


def _sieve_keys(row: np.ndarray, key: np.ndarray, buckets: int):
    """Distinct keys of a block by bucket, with their document counts; ``which`` maps runs (by ascending document) to them."""
    short = (key >> _U(24)).astype(np.uint32)
    bucket = ((key & _U(0xFFFFFF)) % _U(buckets)).astype(np.int64)
    full = (bucket << 32) | short
    order = _stable_order(full, 32 + buckets.bit_length())
    full, row = full[order], row[order]
    new = np.append(True, full[1:] != full[:-1])[:len(full)]
    first = np.flatnonzero(new)
    which = np.empty(len(full), np.int64)
    which[order] = np.cumsum(new) - 1
    fresh = new.copy()
    fresh[1:] |= row[1:] != row[:-1]
    docs = np.add.reduceat(fresh.astype(np.int64), first) if len(first) else first
    return full[first], which, docs


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[list[int], np.ndarray]:
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    return [k for k in range(buckets) if cut[k] < cut[k + 1]], cut


def _ask_keys(buckets: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                _, buf, off = _open(r)
                row, _, _, key = block_runs(buf, off)
                distinct, _, docs = _sieve_keys(row, key, buckets)
                used, cut = _by_bucket(distinct >> 32, buckets)
                keys = (distinct & 0xFFFFFFFF).astype(np.uint32)
                docs = np.minimum(docs, 0xFFFF).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([r["block"]] * len(used), pa.int64()),
                     pa.array([keys[cut[k]:cut[k + 1]].tobytes() for k in used], pa.binary()),
                     pa.array([docs[cut[k]:cut[k + 1]].tobytes() for k in used], pa.binary())],
                    ["bucket", "block", "keys", "docs"])
    return run


def _count_keys(hot: int):
    """Per block and bucket: 0 for keys of one document, 1 for repeated ones, 2 for those with over ``hot`` documents."""
    def run(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in t.column("keys").to_pylist()]
        docs = np.concatenate([np.frombuffer(x, np.uint16) for x in t.column("docs").to_pylist()]).astype(np.int64)
        _, inv = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inv, weights=docs)[inv]
        flags = (total > 1).astype(np.uint8) + (total > max(1, hot))
        cut = np.cumsum([len(p) for p in parts])[:-1]
        return pa.table([t.column("block"), t.column("bucket"),
                         pa.array([_pack(f.astype(np.uint8)) for f in np.split(flags, cut)], pa.binary())],
                        names=["block", "bucket", "flags"])
    return run


_PIECES = "block long, bucket int, keys binary, sizes binary, lows binary, text binary"
_PIECE_NAMES = ["block", "bucket", "keys", "sizes", "lows", "text"]


def _cut_pieces(buckets: int):
    """Distinct pieces of a block's repeated runs, by bucket, and one row (bucket -1) of where they occur."""
    def run(packed: pa.Table, flags: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in _PIECE_NAMES}
        for r in packed.to_pylist():
            ids, buf, off = _open(r)
            row, start, windows, key = block_runs(buf, off)
            _, which, _ = _sieve_keys(row, key, buckets)
            flag = np.concatenate([np.empty(0, np.uint8), *[_array(f, np.uint8) for f in
                                                           flags.sort_by("bucket").column("flags").to_pylist()]])[which]
            calm, hot = flag == 1, flag == 2
            row_h, at_h = np.repeat(row[hot], windows[hot]), ragged(start[hot], start[hot] + windows[hot])
            row = np.concatenate([row[calm], row_h])
            size = np.concatenate([windows[calm] + LENGTH - 1, np.full(len(at_h), LENGTH)])
            start = np.concatenate([start[calm], at_h])
            if not len(row):
                continue
            content = block_hashes(buf, off, row, start, size)
            key = np.concatenate([key[calm], mix64(content[len(content) - len(at_h):] + _U(1))])
            bucket = (mix64(key) % _U(buckets)).astype(np.int64)
            # distinct pieces, ordered by bucket (a piece is named by its key's upper half: keys that share it only make a
            # longer string to sort)
            key = key >> _U(32) << _U(32)
            order = np.lexsort((size, content, key, bucket))
            same = ((key[order][1:] == key[order][:-1]) & (content[order][1:] == content[order][:-1])
                    & (size[order][1:] == size[order][:-1]))
            first = np.append(True, ~same)
            piece = np.empty(len(row), np.int64)
            piece[order] = np.cumsum(first) - 1
            rep = order[first]
            low = np.full(len(rep), np.iinfo(np.int64).max)
            np.minimum.at(low, piece, ids[row])
            used, cut = _by_bucket(bucket[rep], buckets)
            for k in used:
                some = rep[cut[k]:cut[k + 1]]
                cells = (r["block"], k, (key[some] >> _U(32)).astype(np.uint32).tobytes(), _pack(size[some].astype(np.int32)),
                         _pack(low[cut[k]:cut[k + 1]]), _pack(buf[ragged(start[some], start[some] + size[some])].tobytes()))
                for c, v in zip(_PIECE_NAMES, cells):
                    out[c].append(v)
            cells = (r["block"], -1, _pack(start.astype(np.int64)), _pack(size[rep].astype(np.int32)),
                     _pack(piece.astype(np.int32)), _pack(row.astype(np.int32)))
            for c, v in zip(_PIECE_NAMES, cells):
                out[c].append(v)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(out[c], k) for c, k in zip(_PIECE_NAMES, kinds)], names=_PIECE_NAMES)
    return run


def _distinct(text: np.ndarray, begin: np.ndarray, size: np.ndarray, low: np.ndarray, key: np.ndarray):
    """Which distinct piece each piece is, a piece for each of them (ordered by key), and their smallest ids. Pieces are one if they
    agree in key, hash and size and in every byte."""
    content = PrefixHash(text).spans(begin, begin + size)
    order = np.lexsort((size, content, key))
    k, c, n = key[order], content[order], size[order]
    lead = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1]))
    again = np.flatnonzero(~lead)
    for i in np.split(again, np.flatnonzero(np.diff(np.cumsum(n[again]) // STEP_BYTES)) + 1) if len(again) else ():
        a, b, m = begin[order[i]], begin[order[i - 1]], n[i]
        differ = text[ragged(a, a + m)] != text[ragged(b, b + m)]
        lead[i] = np.logical_or.reduceat(differ, np.cumsum(m) - m)
    piece = np.empty(len(order), np.int64)
    piece[order] = np.cumsum(lead) - 1
    return piece, order[lead], np.minimum.reduceat(low[order], np.flatnonzero(lead))


def _linked(of: np.ndarray, piece: np.ndarray, pieces: int) -> np.ndarray:
    """A label for each piece, the same for those that an entry of one class ``of`` links, directly or through others."""
    label = np.arange(pieces)
    while True:
        low = np.full(of.max() + 1, pieces)
        np.minimum.at(low, of, label[piece])
        new = label.copy()
        np.minimum.at(new, piece, low[of])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _parted(of: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the neighbours (``after - 1``, ``after``) have classes that some other neighbours part: the one is followed, or the other
    preceded, by several classes."""
    a, b = of[after - 1], of[after]
    out = np.zeros(len(after), bool)
    for x, y in ((a, b), (b, a)):
        low, high = np.full(of.max() + 1, len(of)), np.full(of.max() + 1, -1)
        np.minimum.at(low, x, y)
        np.maximum.at(high, x, y)
        out |= low[x] != high[x]
    return out


def sort_plan(text: np.ndarray, size: np.ndarray, low: np.ndarray, key: np.ndarray):
    """Which window of which pieces must be sorted to find, for every window of every piece (in order), the smallest id among the
    pieces of its key that hold the same ``LENGTH`` bytes. Equal pieces become one. These are cut down to the windows that some
    other piece of the key has too (by hash; a window in one piece only has that piece's id as its answer), and cut where the
    windows before or after a window differ, so that common passages in many surroundings don't make a piece of each two
    surroundings; equal cuts become one again. What then has a window in common is one string to sort.

    (values, each window's place in them, places that ``window_answers`` fills, its arguments)"""
    windows = size - LENGTH + 1
    piece, rep, least = _distinct(text, np.cumsum(size) - size, size, low, key)
    begin, key, per = (np.cumsum(size) - size)[rep], key[rep], windows[rep]
    own = np.cumsum(per) - per
    values, place = np.repeat(least, per), np.arange(per.sum())
    fill = np.empty(0, np.int64)
    strings = (np.empty(0, np.uint8), fill, fill, fill)
    head = np.append(True, key[1:] != key[:-1])
    some = np.flatnonzero(~(head & np.append(head[1:], True)))        # distinct pieces whose key has others
    at = ragged(begin[some], begin[some] + per[some])                # their windows
    owner = np.repeat(some, per[some])
    hashes = mix64(key[owner]) ^ PrefixHash(text).spans(at, at + LENGTH)
    order = np.argsort(hashes)
    new = np.append(True, np.diff(hashes[order]) != 0)[:len(order)]
    of = np.empty(len(at), np.int64)
    of[order] = np.cumsum(new) - 1
    held, first = owner[order], np.flatnonzero(new)
    shared = (np.minimum.reduceat(held, first) != np.maximum.reduceat(held, first))[of] if len(first) else new
    if shared.any():
        # maximal runs of shared windows, cut where they part
        new = shared & np.append(True, ~shared[:-1] | (owner[1:] != owner[:-1]))
        after = np.flatnonzero(shared & ~new)
        new[after[_parted(of, after)]] = True
        cut = np.flatnonzero(new)
        n = np.bincount(np.cumsum(new)[shared] - 1)
        mine = owner[cut]
        which, one, low = _distinct(text, at[cut], n + LENGTH - 1, least[mine], key[mine])
        n_one = n[one]
        first = len(values) + np.cumsum(n_one) - n_one
        values = np.append(values, np.repeat(low, n_one))
        place[ragged(own[some], own[some] + per[some])[shared]] = ragged(first[which], first[which] + n)
        label = _linked(of[ragged(cut[one], cut[one] + n_one)], np.repeat(np.arange(len(one)), n_one), len(one))
        among = np.flatnonzero(np.bincount(label)[label] > 1)
        among = among[np.argsort(label[among], kind="stable")]
        a, n = at[cut[one]][among], n_one[among]
        fill = ragged(first[among], first[among] + n)
        strings = (text[ragged(a, a + n + LENGTH - 1)], n + LENGTH - 1, low[among], label[among])
    return values, place[ragged(own[piece], own[piece] + windows)], fill, strings


def piece_answers(text: np.ndarray, size: np.ndarray, low: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For every window of every piece (in order) the smallest id among the pieces of its key that hold the same ``LENGTH``
    bytes: planned for some keys at a time, with the strings of all of them sorted together."""
    begin = np.cumsum(size) - size
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    full = (np.cumsum(size[order]) // PLAN_BYTES)[head]
    groups = np.split(order, head[1:][np.diff(full) > 0])
    plans = [sort_plan(text[ragged(begin[p], begin[p] + size[p])], size[p], low[p], key[p]) for p in groups]
    texts, sizes, lows, labels = zip(*[x[3] for x in plans])
    labels = [(k << 40) | x for k, x in enumerate(labels)]
    found = window_answers(np.concatenate(texts), np.concatenate(sizes), np.concatenate(lows), np.concatenate(labels))
    end = np.cumsum(size - LENGTH + 1)
    out = np.empty(end[-1], np.int64)
    at = 0
    for p, (values, place, fill, _) in zip(groups, plans):
        values[fill] = found[at:at + len(fill)]
        at += len(fill)
        out[ragged(end[p] - size[p] + LENGTH - 1, end[p])] = values[place]
    return out


def window_answers(text: np.ndarray, size: np.ndarray, low: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For every window of every piece (in order) the smallest id among the pieces of its key that hold the same
    ``LENGTH`` bytes. Pieces of one key must be neighbours."""
    end = np.cumsum(size)
    begin = end - size
    windows = size - LENGTH + 1
    out = np.empty(windows.sum(), np.int64)
    w_begin = np.cumsum(windows) - windows
    if not len(key):
        return out
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    tail = np.append(head[1:], len(key))
    # strings of similar length together, a bounded amount at a time
    length = end[tail - 1] - begin[head]
    by_size = np.argsort(length, kind="stable")
    batch = np.cumsum(length[by_size]) // SORT_BYTES
    for group in np.split(by_size, np.flatnonzero(np.diff(batch)) + 1):
        p = ragged(head[group], tail[group])                 # pieces of the batch
        n = size[p] + 1                                      # each is followed by a separator below all bytes
        p_end = np.cumsum(n)
        p_begin = p_end - n
        symbols = np.zeros(p_end[-1], np.int64)
        cells = ragged(p_begin, p_end - 1)
        symbols[cells] = text[ragged(begin[p], end[p])].astype(np.int64) + 1
        pieces_in = tail[group] - head[group]
        offsets = np.concatenate([[0], p_end[np.cumsum(pieces_in) - 1]])
        sa = suffix_arrays(symbols, offsets)
        piece_at = np.repeat(np.arange(len(p)), n)
        starts = np.arange(len(symbols)) <= (p_end - 1 - LENGTH)[piece_at]
        sa = sa[starts[sa]]
        owner = np.repeat(np.arange(len(group)), pieces_in)[piece_at[sa]]
        equal = np.zeros(len(sa), bool)
        equal[1:] = owner[1:] == owner[:-1]
        for k in range(LENGTH):                              # agreement on LENGTH bytes, byte by byte on what is left
            i = np.flatnonzero(equal)
            if not len(i):
                break
            equal[i] = symbols[sa[i] + k] == symbols[sa[i - 1] + k]
        first = np.flatnonzero(~equal)
        least = np.minimum.reduceat(low[p][piece_at[sa]], first)
        value = np.repeat(least, np.diff(np.append(first, len(sa))))
        where = w_begin[p][piece_at[sa]] + sa - p_begin[piece_at[sa]]
        out[where] = value
    return out


def _answer(t: pa.Table) -> pa.Table:
    """All pieces of one bucket: answers per block in the order asked (run lengths and values)."""
    rows = t.to_pylist()
    key = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows]).astype(np.uint64)
    size = np.concatenate([_array(r["sizes"], np.int32) for r in rows]).astype(np.int64)
    low = np.concatenate([_array(r["lows"], np.int64) for r in rows])
    text = np.frombuffer(b"".join(_unpack(r["text"]) for r in rows), np.uint8)
    answers = piece_answers(text, size, low, key)
    end = np.cumsum(size - LENGTH + 1)
    lengths, values = [], []
    at = 0
    for r in rows:
        n = len(r["keys"]) // 4
        v = answers[end[at] - size[at] + LENGTH - 1:end[at + n - 1]]
        at += n
        cut = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        lengths.append(_pack(np.diff(np.append(cut, len(v))).astype(np.int32)))
        values.append(_pack(v[cut]))
    none = pa.array([b""] * len(rows), pa.binary())
    return pa.table([t.column("block"), t.column("bucket"), pa.array(lengths, pa.binary()), pa.array(values, pa.binary()), none, none],
                    names=_PIECE_NAMES)


def removed_bytes(ids: np.ndarray, off: np.ndarray, row: np.ndarray, start: np.ndarray, piece: np.ndarray,
                  sizes: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """Which bytes of some documents lie in a window whose answer is below the document's id."""
    windows = sizes.astype(np.int64) - LENGTH + 1
    w_begin = np.cumsum(windows) - windows
    n = windows[piece]
    value = answers[ragged(w_begin[piece], w_begin[piece] + n)]
    at = ragged(start, start + n)[value < np.repeat(ids[row], n)]
    delta = np.zeros(off[-1] + 1, np.int64)
    delta += np.bincount(at, minlength=len(delta))
    delta -= np.bincount(at + LENGTH, minlength=len(delta))
    return np.cumsum(delta[:-1]) > 0


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _remove(packed: pa.Table, found: pa.Table) -> pa.Table:
    out: list[list] = [[], [], [], []]
    for r in packed.to_pylist():
        ids, buf, off = _open(r)
        gone = np.zeros(len(buf), bool)
        rows = found.sort_by("bucket").to_pylist()
        if rows:
            where, rest = rows[0], rows[1:]
            answers = np.concatenate([np.repeat(_array(x["sizes"], np.int64), _array(x["keys"], np.int32)) for x in rest])
            row, start = _array(where["text"], np.int32), _array(where["keys"], np.int64)
            piece, sizes = _array(where["lows"], np.int32), _array(where["sizes"], np.int32)
            for i, j in _steps(off):
                mine = np.flatnonzero((row >= i) & (row < j))
                gone[off[i]:off[j]] = removed_bytes(ids[i:j], off[i:j + 1] - off[i], row[mine] - i, start[mine] - off[i], piece[mine], sizes, answers)
        for k in range(len(ids)):
            g = gone[off[k]:off[k + 1]]
            text = buf[off[k]:off[k + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
            out[0].append(int(ids[k]))
            out[1].append(len(g))
            out[2].append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            out[3].append(text[~g].tobytes() if len(edge) else text.tobytes())
    kinds = (pa.int64(), pa.int64(), _SPANS, pa.binary())
    return pa.table([pa.array(v, k) for v, k in zip(out, kinds)], names=["doc_id", "n_bytes", "spans", "kept"])


def _bucketed(blocks: DataFrame, parts: int) -> DataFrame:
    """The blocks written once, hash-bucketed, so that neither of the two steps that meet them by block moves them. The
    catalog entry is only needed to write and open the files and goes at once; the files are in the scratch folder."""
    spark = blocks.sparkSession
    path = scratch_path(spark, "dedup-blocks")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    blocks.write.bucketBy(parts, "block").option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    table.schema
    spark.sql(f"DROP TABLE {name}")
    return table


_RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (removed, in bytes, end exclusive) and kept (binary) per row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, block_bytes = dealing(parts)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = every.where("doc_id IS NOT NULL")
    size = F.octet_length("text").cast("long")
    unknown = every.where("doc_id IS NULL").select("doc_id", size.alias("n_bytes"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
                                                   F.col("text").cast("binary").alias("kept"))
    digest = scratch_table(src.where(F.octet_length("text") >= LENGTH).select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.xxhash64("text").alias("mark"),
        F.octet_length("text").cast("long").alias("n_bytes")), "dedup-digests")
    firsts = digest.groupBy("sha").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copies = scratch_table(digest.join(firsts, "sha").where("doc_id > low").select("doc_id", "mark", "n_bytes"), "dedup-copies")
    marks = copies.select("doc_id", "mark").distinct()
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    rest = src.withColumn("mark", F.xxhash64("text")).join(marks, ["doc_id", "mark"], "left_anti").select("doc_id", "text")

    packed = _bucketed(rest.mapInArrow(_blocks(block_bytes), "block long, ids binary, sizes binary, text binary"), parts)
    asked = packed.mapInArrow(_ask_keys(buckets), "bucket int, block long, keys binary, docs binary").repartition(parts, "bucket")
    flags = asked.groupBy("bucket").applyInArrow(_count_keys(hot), "block long, bucket int, flags binary")
    pieces = scratch_table(packed.groupBy("block").cogroup(flags.groupBy("block"))
                           .applyInArrow(_cut_pieces(buckets), _PIECES), "dedup-pieces")
    answers = (pieces.where("bucket >= 0").repartition(parts, "bucket").groupBy("bucket").applyInArrow(_answer, _PIECES))
    found = pieces.where("bucket < 0").unionByName(answers)
    judged = packed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_remove, _RESULT)
    whole = copies.select("doc_id", "n_bytes", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans"),
                          F.lit(b"").alias("kept"))
    return judged.unionByName(whole).unionByName(unknown)

"""Benchmark decontamination: word suffix arrays over the training texts, searched for every benchmark window.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A window is ``WINDOW`` consecutive words
of a benchmark item (a shorter item is one window). Each task takes its documents in shards of bounded size, builds
the suffix array of the shard's word sequence and looks up every window by binary search; the interval found holds all
of its occurrences, whose words are then marked. Only suffixes that start with the first words of some window enter
the suffix array: no other suffix can match. Windows are compared as word hashes of 64 bits.

The plan is map-only. The benchmark is split into blocks of ``BLOCK_BYTES`` of text; ``MAX_BLOCKS`` blocks at a time are
broadcast, so the size sent is bounded whatever the benchmark's size. Usually that is one pass; a larger benchmark takes
several passes over the documents whose hits are merged by row, so the result is the same.

Defined cases: a null or empty text has no words and is not contaminated; a null benchmark text has no windows; items
with equal texts are all reported; repeated documents repeat; an empty benchmark or table gives no hits or no rows;
extra columns are ignored by ``find_overlaps`` and kept by ``remove_contaminated``. Texts of any length are judged whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import (bounded_batches, PrefixHash, byte_class, enter_task, lowered_values, mix64, releasing, scratch_table, sha256_hex,
                                string_array, text_chunks, word_spans)

WINDOW = 13
LEAD = 4                                # words by which suffixes are admitted to the suffix array
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 2 << 20
MAX_BLOCKS = 4
_WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_VALUES = lowered_values()


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (never 0) of all rows and the first word of each row."""
    start, end, first = word_spans(buf, off, _WORD)
    return PrefixHash(buf, _VALUES).spans(start, end) | np.uint64(1), first


def _lead_keys(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    h = words[at].copy()
    for j in range(1, k):
        h = mix64(h) + words[at + j]
    return h


@dataclass
class WindowIndex:
    """The distinct windows of a block of items."""
    items: list[str]
    matrix: np.ndarray                  # windows x WINDOW word hashes, 0 after the end
    size: np.ndarray                    # words of each window
    item_start: np.ndarray              # window -> its items, in compressed rows
    item_of: np.ndarray
    follows: np.ndarray                 # sorted (window << 32 | next window) of neighbours in an item
    leads: dict[int, np.ndarray]        # sorted keys of the first words, by how many there are
    at_start: np.ndarray                # window -> its occurrences (item, word), in compressed rows
    at_item: np.ndarray
    at_word: np.ndarray

    @classmethod
    def build(cls, ids: list[str], texts: list[str]) -> "WindowIndex":
        rows, sizes, owner = [], [], []
        for _, (buf, off, first_row) in enumerate(_all_chunks(texts)):
            words, first = _words(buf, off)
            for r in range(len(off) - 1):
                w = words[first[r]:first[r + 1]]
                if not len(w):
                    continue
                if len(w) < WINDOW:
                    rows.append(np.pad(w, (0, WINDOW - len(w)))[None, :])
                    sizes.append(np.array([len(w)]))
                else:
                    rows.append(np.lib.stride_tricks.sliding_window_view(w, WINDOW))
                    sizes.append(np.full(len(w) - WINDOW + 1, WINDOW))
                owner.append(np.full(len(rows[-1]), first_row + r))
        if not rows:
            none = np.empty(0, np.int64)
            return cls(ids, np.empty((0, WINDOW), np.uint64), none, np.zeros(1, np.int64), none, none, {}, np.zeros(1, np.int64), none, none)
        m, size, own = np.concatenate(rows), np.concatenate(sizes), np.concatenate(owner)
        matrix, at, inv = np.unique(m, axis=0, return_index=True, return_inverse=True)
        inv = inv.ravel()
        pairs = np.unique(np.stack([inv, own], axis=1), axis=0)
        same = own[1:] == own[:-1]
        follows = np.unique((inv[:-1][same].astype(np.int64) << 32) | inv[1:][same])
        leads = {}
        for k in sorted(set(np.minimum(size[at], LEAD).tolist())):
            sel = matrix[np.minimum(size[at], LEAD) == k]
            leads[k] = np.unique(_lead_keys(sel.ravel(), np.arange(len(sel)) * WINDOW, k))
        order = np.argsort(inv, kind="stable")
        word = np.concatenate([np.arange(len(x)) for x in owner])
        return cls(ids, matrix, size[at], np.searchsorted(pairs[:, 0], np.arange(len(matrix) + 1)), pairs[:, 1], follows, leads,
                   np.searchsorted(inv[order], np.arange(len(matrix) + 1)), own[order], word[order])


def _all_chunks(texts: list[str]):
    for first, buf, off in text_chunks(pa.array(texts, pa.large_string())):
        yield buf, off, first


def _member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted table: a bit map of key prefixes first, then bisection of what is left."""
    bits = np.zeros(1 << 16, bool)
    bits[(table >> np.uint64(48)).astype(np.int64)] = True
    out = bits[(keys >> np.uint64(48)).astype(np.int64)]
    some = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(table, keys[some]), len(table) - 1)
    out[some] = table[at] == keys[some]
    return out


def _suffix_array(words: np.ndarray, end: np.ndarray, index: WindowIndex) -> tuple[np.ndarray, np.ndarray]:
    """(positions, first WINDOW words) of the admitted suffixes in lexicographic order."""
    admit = np.zeros(len(words), bool)
    for k, table in index.leads.items():
        at = np.flatnonzero(np.arange(len(words)) + k <= end)
        admit[at[_member(_lead_keys(words, at, k), table)]] = True
    pos = np.flatnonzero(admit)
    cols = pos[:, None] + np.arange(WINDOW)
    m = np.where(cols < end[pos][:, None], words[np.minimum(cols, len(words) - 1)], np.uint64(0))
    order = np.lexsort(m.T[::-1])
    return pos[order], m[order]


def _bound(m: np.ndarray, index: WindowIndex, upper: bool) -> np.ndarray:
    """For every window the first suffix that is not below it (or, ``upper``, that is above all it begins)."""
    n = len(index.matrix)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(m), np.int64)
    inside = np.arange(WINDOW) < index.size[:, None]
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        a, q = m[mid], index.matrix[live]
        differ = (a != q) & inside[live]
        at = differ.argmax(axis=1)
        row = np.arange(len(live))
        below = np.where(differ[row, at], a[row, at] < q[row, at], upper)
        lo[live[below]] = mid[below] + 1
        hi[live[~below]] = mid[~below]
        live = live[lo[live] < hi[live]]
    return lo


def _ragged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of all ranges lo..hi."""
    n = hi - lo
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _occurrences(words: np.ndarray, end: np.ndarray, index: WindowIndex) -> tuple[np.ndarray, np.ndarray]:
    """(window, word) of all places where a window of the index occurs."""
    pos, m = _suffix_array(words, end, index)
    window, at = _ragged(_bound(m, index, False), _bound(m, index, True))
    return window, pos[at]


def shard_matches(words: np.ndarray, first: np.ndarray, index: WindowIndex) -> np.ndarray:
    """Maximal verbatim matches of a shard: rows of (row, first word in it, item, first word there, words)."""
    if not len(index.matrix) or not len(words):
        return np.empty((0, 5), np.int64)
    end = np.repeat(first[1:], np.diff(first))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    window, where = _occurrences(words, end, index)
    of, at = _ragged(index.at_start[window], index.at_start[window + 1])
    place, item, word, size = where[of], index.at_item[at], index.at_word[at], index.size[window[of]]
    order = np.lexsort((place, place - word, item))         # along the diagonals of each item
    place, item, word, size = place[order], item[order], word[order], size[order]
    joined = np.zeros(len(place), bool)
    joined[1:] = ((place[1:] == place[:-1] + 1) & (word[1:] == word[:-1] + 1) & (item[1:] == item[:-1]) & (doc[place[1:]] == doc[place[:-1]])
                  & (size[1:] == WINDOW))
    begin = np.flatnonzero(~joined)
    runs = np.diff(np.append(begin, len(place)))
    row = doc[place[begin]]
    return np.column_stack([row, place[begin] - first[row], item[begin], word[begin], size[begin] + runs - 1])


def shard_overlaps(words: np.ndarray, first: np.ndarray, indexes: list[WindowIndex]):
    """Hit flag of every word, [row, item] pairs by index, and each row's longest chain of matched words."""
    rows = len(first) - 1
    end = np.repeat(first[1:], np.diff(first))
    doc = np.repeat(np.arange(rows), np.diff(first))
    delta = np.zeros(len(words) + 1, np.int64)
    longest = np.zeros(rows, np.int64)
    pairs = []
    for index in indexes:
        if not len(index.matrix) or not len(words):
            pairs.append(np.empty((0, 2), np.int64))
            continue
        window, where = _occurrences(words, end, index)
        np.add.at(delta, where, 1)
        np.add.at(delta, where + index.size[window], -1)
        dw = np.unique(np.stack([doc[where], window], axis=1), axis=0) if len(where) else np.empty((0, 2), np.int64)
        row, item = _ragged(index.item_start[dw[:, 1]], index.item_start[dw[:, 1] + 1])
        pairs.append(np.unique(np.stack([dw[row, 0], index.item_of[item]], axis=1), axis=0) if len(row) else np.empty((0, 2), np.int64))
        if len(where):                 # chains: neighbouring positions whose windows are neighbours in an item
            order = np.lexsort((window, where))
            p, g = where[order], window[order]
            np.maximum.at(longest, doc[p], index.size[g])
            full = index.size[g] == WINDOW
            p, g = p[full], g[full]
            if len(p):
                link = np.zeros(len(p), bool)
                if len(index.follows):
                    key = (g[:-1].astype(np.int64) << 32) | g[1:]
                    k = np.minimum(np.searchsorted(index.follows, key), len(index.follows) - 1)
                    link[1:] = (p[1:] == p[:-1] + 1) & (index.follows[k] == key) & (doc[p[1:]] == doc[p[:-1]])
                run = np.arange(len(p)) - np.maximum.accumulate(np.where(link, 0, np.arange(len(p))))
                np.maximum.at(longest, doc[p], run + WINDOW)
    return np.cumsum(delta[:-1]) > 0, pairs, longest


def _item_indexes(benchmark: DataFrame, item_col: str, text_col: str):
    """Indexes of blocks of items, each of a bounded amount of text (or one item)."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        if ids and size + len(text) > BLOCK_BYTES:
            yield WindowIndex.build(ids, texts)
            ids, texts, size = [], [], 0
        ids.append("" if item is None else item)
        texts.append(text)
        size += len(text)
    if ids:
        yield WindowIndex.build(ids, texts)


def _passes(benchmark: DataFrame, item_col: str, text_col: str) -> list:
    """Broadcast lists of at most MAX_BLOCKS indexes."""
    sc = benchmark.sparkSession.sparkContext
    out, held = [], []
    for index in _item_indexes(benchmark, item_col, text_col):
        held.append(index)
        if len(held) == MAX_BLOCKS:
            out.append(sc.broadcast(held))
            held = []
    if held or not out:
        out.append(sc.broadcast(held))
    return out


def _judge(arr: pa.Array, indexes: list[WindowIndex]):
    """Per shard: words, hits per word, item names per row, longest chain."""
    for first_row, buf, off in text_chunks(arr, SHARD_BYTES):
        words, first = _words(buf, off)
        hit, pairs, longest = shard_overlaps(words, first, indexes)
        names: list[list[str]] = [[] for _ in range(len(first) - 1)]
        for index, p in zip(indexes, pairs):
            for row, item in p.tolist():
                names[row].append(index.items[item])
        yield first_row, first, hit, names, longest


def _hits(first: np.ndarray, hit: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[first[1:]] - total[first[:-1]]


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


_OUT = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long")
_OUT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64())


def _columns(n_words: list[int], n_hit: list[int], names: list[list[str]], longest: list[int]) -> list[pa.Array]:
    names = [sorted(set(x)) for x in names]
    cols = (n_words, n_hit, [len(x) for x in names], [sha256_hex(",".join(x).encode()) for x in names],
            [is_contaminated(h, w) for h, w in zip(n_hit, n_words)], longest)
    return [pa.array(c, t) for c, t in zip(cols, _OUT_TYPES)]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match per document."""
    return _overlaps(docs, _passes(benchmark, item_col, item_text_col), id_col, text_col)


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Where the benchmark occurs: doc_id, item_id, doc_word, item_word (first words, from 0) and n_words of every maximal verbatim match of at least
    ``WINDOW`` words, or of a whole shorter item. Map-only; a large benchmark takes a pass per group of blocks."""
    src = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "item_id", "doc_word", "item_word", "n_words"]

    def located(held):
        def run(batches):
            for b in batches:
                for at, buf, off in text_chunks(string_array(b, "text"), SHARD_BYTES):
                    words, first = _words(buf, off)
                    for index in held.value:
                        m = shard_matches(words, first, index)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(m[:, 0] + at)), pa.array([index.items[k] for k in m[:, 2].tolist()], pa.string()),
                             *(pa.array(m[:, k]) for k in (1, 3, 4))], names)
        return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, item_id string, doc_word long, item_word long, n_words long")

    out = None
    for held in _passes(benchmark, item_col, item_text_col):
        out = located(held) if out is None else out.unionByName(located(held))
    return out


_ROW = "_decontam_row"


def _overlaps(docs: DataFrame, passes: list, id_col: str, text_col: str) -> DataFrame:
    src = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"]
    ddl = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {_OUT}"
    if len(passes) == 1:
        held = passes[0]

        def run(batches):
            for b in batches:
                for at, first, hit, items, longest in _judge(string_array(b, "text"), held.value):
                    cols = _columns(np.diff(first).tolist(), _hits(first, hit).tolist(), items, longest.tolist())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(items)), *cols], names)

        return src.mapInArrow(run, ddl)

    # a large benchmark: one pass per group of blocks, merged by row
    rows = scratch_table(src.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")

    def partial(held):
        def run(batches):
            for b in batches:
                for at, first, hit, items, longest in _judge(string_array(b, "text"), held.value):
                    bits = [np.packbits(hit[x:y]).tobytes() for x, y in zip(first, first[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(2).slice(at, len(items)), b.column(0).slice(at, len(items)),
                         pa.array(np.diff(first)), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string())),
                         pa.array(longest)], ["row", "doc_id", "n_words", "bits", "items", "longest"])
        return rows.mapInArrow(run, f"row long, doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, "
                                    "bits binary, items array<string>, longest long")

    merged = partial(passes[0])
    for held in passes[1:]:
        merged = merged.unionByName(partial(held))
    merged = merged.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                       F.collect_list("bits").alias("bits"), F.flatten(F.collect_list("items")).alias("items"),
                                       F.max("longest").alias("longest"))

    def finish(batches):
        for b in batches:
            n_hit = []
            for bits in b.column(3).to_pylist():
                x = np.zeros(len(bits[0]), np.uint8)
                for y in bits:
                    x |= np.frombuffer(y, np.uint8)
                n_hit.append(int(np.unpackbits(x).sum()))
            cols = _columns(b.column(2).to_pylist(), n_hit, b.column(4).to_pylist(), b.column(5).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(1), *cols], names)

    return merged.mapInArrow(finish, ddl)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns unchanged; each row is judged by its own text, whatever its id. Map-only for one
    pass; for a benchmark that takes several, rows are written with a number first and the contaminated numbers go."""
    passes = _passes(benchmark, item_col, item_text_col)
    if len(passes) > 1:
        rows = scratch_table(docs.withColumn(_ROW, F.monotonically_increasing_id()), "decontam-numbered")
        bad = _overlaps(rows, passes, _ROW, text_col).where("contaminated").select(F.col("doc_id").alias(_ROW))
        return rows.join(bad, _ROW, "left_anti").drop(_ROW)
    held = passes[0]

    def run(batches):
        enter_task("decontam")
        for b in releasing(batches):
            keep = []
            for _, first, hit, _, _ in _judge(string_array(b, text_col), held.value):
                keep += [not is_contaminated(h, w) for h, w in zip(_hits(first, hit).tolist(), np.diff(first).tolist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)

"""Byte-level BPE by speculation: greedy longest match proposes tokens, adjacent pairs are verified in bulk, and only
words with an incompatible pair are merged exactly.

Two neighbouring tokens are compatible when no merge across their border would have happened before one of the two
was complete. The tokens that ever touched the border are the right spine of the left token (itself, its right part,
the right part of that, down to a byte) and the left spine of the right one. A spine element exists from its own merge
rank until its parent's, so the pair is incompatible if some merge of (left element, right element) has a rank lower
than both parents' ranks (on equal rank the leftmost pair goes first, which is the crossing one unless the parent on
the left makes the same merge). A token sequence whose tokens are each their own encoding and whose neighbours are all
compatible is the encoding. ``_incompatible`` walks all distinct pairs of a batch at once in numpy.

Texts are cut in bulk, by the classes of neighbouring bytes, where the pre-tokeniser's pattern has a border whatever else is
in the text (``cut_places``), so a piece can be encoded by itself. Pieces of at most ``KEY_BYTES`` bytes are found again, all pieces of a block
at once, in a bounded table of arrays (``PieceTable``, ``CACHE_PIECES``; dropping an entry costs time but changes nothing), longer
ones in a dictionary, which is bounded by its bytes too. A piece's entry is its ids. What leaves is made from the ids of a
text alone: their decimal text and the decoded bytes are looked up id by id in tables of the vocabulary.

Defined cases: a null text is an empty text; an empty text has no tokens; repeated rows repeat; extra input columns
are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import bounded_batches, enter_task, id_type, keeps_cache, releasing, sha256_hex, string_array

CACHE_PIECES = 600_000
LONG_PIECES, LONG_BYTES = 100_000, 1 << 10     # kept pieces that are longer than KEY_BYTES, and what is too long to keep
LONG_CACHE = 16 << 20                          # bytes of such pieces and their ids
KEY_BYTES = 23
BLOCK = 1 << 18                     # pieces that are looked up together
NEVER = np.int64(1) << 40
LONG_WORD = 48
_NO_RANK = (1 << 31) - 1

_WS = "\t-\r\x20\x85\xa0  -     　"
_PRE = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")

# classes of bytes in the pre-tokeniser's pattern: letter, digit, other, apostrophe, space, other white space, not ASCII
_L, _N, _O, _Q, _S, _T, _X = range(7)
_CLASS = np.full(256, _O, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _L
_CLASS[48:58] = _N
_CLASS[39] = _Q
_CLASS[32] = _S
_CLASS[9:14] = _T
_CLASS[128:] = _X
_RUN = _CLASS.copy()                # alike in one token
_RUN[39] = _O
# a border wherever the second class follows the first
_BORDER = np.zeros(64, bool)
_BORDER[[a * 8 + b for a, after in ((_L, (_N, _O, _Q, _S, _T)), (_N, (_L, _O, _Q, _S, _T)), (_O, (_L, _N, _S, _T)), (_Q, (_N, _S, _T))) for b in after]] = True
# bytes that begin a character which is certainly not white space
_SOLID = _CLASS < _S
_SOLID[0xC0:] = True
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by rule: printable Latin-1
    bytes stand for themselves, the others take code points from 256 on, in byte order."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in keep}
    shift = 256
    for b in range(256):
        if b not in keep:
            table[chr(shift)] = b
            shift += 1
    return table


class IntTable:
    """A fixed map from int64 keys to int64 values with array lookups: open addressing, linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, -1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            first = np.unique(slot, return_index=True)[1]          # one claimant of each slot
            first = first[self.keys[slot[first]] < 0]
            self.keys[slot[first]] = keys[left[first]]
            self.values[slot[first]] = values[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values by key; -1 where a key is absent."""
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], -1)
        todo = np.flatnonzero((at != keys) & (at >= 0))
        mask = len(self.keys) - 1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            at = self.keys[slot[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (at >= 0)]
        return out


def cut_places(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces of the rows buf[offsets[i]:offsets[i + 1]]. A piece has the tokens it would have as a text of its own: it begins where
    a row does, where ASCII letters, digits and others end, before a space that something else than white space follows,
    and after a single other white space. An apostrophe stays with letters after it; beside other bytes than ASCII nothing is cut."""
    n = len(buf)
    kind = _CLASS[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    cut = edge[:-1].copy()
    cut[1:] |= _BORDER[kind[:-1] * np.uint8(8) + kind[1:]]
    at = np.flatnonzero(kind[:-1] == _S)
    cut[at[_SOLID[buf[at + 1]] & ~edge[at + 1]]] = True
    at = np.flatnonzero((kind[:-1] == _T) & (kind[1:] < _S))
    cut[at[edge[at] | (kind[at - 1] < _S)] + 1] = True
    return np.flatnonzero(cut)


class PieceTable:
    """Ids of byte strings of at most ``KEY_BYTES`` bytes, found in bulk: three words (the bytes and their number) are the key, open
    addressing and linear probing lead to an entry, and an entry is a span of one array of ids."""

    def __init__(self, type_: np.dtype):
        self.n, self.used = 0, 0
        self.slots = np.full(1 << 10, -1, np.int32)
        self.keys = np.empty((3, 512), np.uint64)
        self.first, self.count = np.empty(512, np.int64), np.empty(512, np.int64)
        self.hit = np.empty(512, bool)
        self.ids = np.empty(1024, type_)

    @staticmethod
    def key(padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Keys of spans of a buffer that goes on for ``KEY_BYTES`` bytes after the last."""
        word = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        out = np.empty((3, len(start)), np.uint64)
        for k in range(3):
            out[k] = word[start + 8 * k] & _MASK[np.clip(size - 8 * k, 0, 8)]
        out[2] |= size.astype(np.uint64) << np.uint64(56)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        h = ((h ^ (h >> np.uint64(29))) + keys[1]) * np.uint64(0xBF58476D1CE4E5B9)
        h = ((h ^ (h >> np.uint64(32))) + keys[2]) * np.uint64(0x94D049BB133111EB)
        return ((h ^ (h >> np.uint64(31))) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entries by key; -1 where a key is absent."""
        slot = self._slot(keys)
        out = self.slots[slot]
        todo = np.flatnonzero((out >= 0) & ~self._same(out, keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            e = self.slots[slot[todo]]
            out[todo] = e
            todo = todo[(e >= 0) & ~self._same(e, keys[:, todo])]
        self.hit[out[out >= 0]] = True
        return out

    def _same(self, entries: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return (self.keys[0][entries] == keys[0]) & (self.keys[1][entries] == keys[1]) & (self.keys[2][entries] == keys[2])

    def room(self, ids: int) -> None:
        """Makes room for so many more ids."""
        if self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(self.used + ids, self.ids.dtype)])

    def add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """New entries of absent, distinct keys, with their ids one after another."""
        new = np.arange(self.n, self.n + len(count))
        if new.size and new[-1] >= len(self.first):
            grown = 2 * int(new[-1] + 1) - self.n
            more = grown - len(self.first)
            self.keys = np.concatenate([self.keys, np.empty((3, more), np.uint64)], axis=1)
            self.first, self.count = (np.concatenate([a, np.empty(more, np.int64)]) for a in (self.first, self.count))
            self.hit = np.concatenate([self.hit, np.empty(more, bool)])
        self.room(len(ids))
        self.keys[:, new], self.count[new], self.hit[new] = keys, count, True
        self.first[new] = self.used + np.cumsum(count) - count
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.n += len(new)
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (2 * self.n).bit_length(), -1, np.int32)
            self._enter(np.arange(self.n))
        else:
            self._enter(new)
        return new

    def _enter(self, entries: np.ndarray) -> None:
        slot = self._slot(self.keys[:, entries])
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]              # one of those that claim a slot stays
            left = self.slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & (len(self.slots) - 1)

    def trim(self, most: int) -> None:
        """Where there are more than ``most`` entries, those not asked for since the last time go; then the oldest, down to half."""
        if self.n <= most:
            return
        keep = np.flatnonzero(self.hit[:self.n])[-(most // 2 + 1):]
        old, count = self.ids, self.count[keep]
        ids = old[spread(self.first[keep], count)]
        keys = self.keys[:, keep]
        self.__init__(old.dtype)
        self.add(keys, ids, count)
        self.hit[:self.n] = False


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices first[i], first[i] + 1, ... (count[i] of them) of all i."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class BpeCodec:
    """Encoder and decoder of one byte-level BPE file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        model = spec["model"]
        ids = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(max(ids.values()), max((a["id"] for a in spec["added_tokens"]), default=0)) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in ids.items():
            self.bytes_of[i] = b
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for text, i in self.added.items():
            # the decoder reads added tokens like others: by characters that stand for bytes, if all of them do
            self.bytes_of[i] = bytes(chars[c] for c in text) if all(c in chars for c in text) else text.encode()
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.vocab = ids
        self.byte_id = [ids.get(bytes([b]), -1) for b in range(256)]
        self.longest = max(map(len, ids))
        # parts and rank of the merge that makes each token; single bytes have rank -1 and no parts
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = [], []
        for r, (a, b) in enumerate(merges):
            x, y = (ids[bytes(chars[c] for c in s)] for s in (a, b))
            z = ids[self.bytes_of[x] + self.bytes_of[y]]
            if (x, y) not in self.merge:
                self.merge[(x, y)] = (r, z)
                keys.append((x << 32) | y)
                ranks.append(r)
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        self.rank_table = IntTable(np.array(keys, np.int64), np.array(ranks, np.int64))
        made = [self.merge[(k >> 32, k & 0xFFFFFFFF)][1] for k in keys]
        self.made_by = np.full(len(merges) + 1, -1, np.int64)      # token made by the merge of each rank
        self.made_by[ranks] = made
        if min(self.byte_id) < 0:
            raise ValueError("not a byte-level vocabulary: a byte has no token")
        self.single = np.array(self.byte_id, np.int64)
        self.type = id_type(size)
        self.token_bytes = pa.array(self.bytes_of, pa.large_binary())
        self.token_text = pa.array([b"%d," % i for i in range(size)], pa.large_binary())
        self.trie, self.accepts = self._trie()
        self.own: dict[int, bool] = {}                     # is the token its own encoding?
        self.table = PieceTable(self.type)
        self.long: list[dict[bytes, bytes]] = [{}, {}]     # two generations
        self.long_size = 0                                 # bytes in the young one

    def _trie(self) -> tuple[IntTable, np.ndarray]:
        """Edges (node, byte) -> node of the vocabulary's prefix tree, and the token that ends at each node."""
        edges: dict[int, int] = {}
        accepts = [-1]
        for word, token in self.vocab.items():
            node = 0
            for c in word:
                key = (node << 8) | c
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(accepts)
                    accepts.append(-1)
                node = nxt
            accepts[node] = token
        return (IntTable(np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges))),
                np.array(accepts, np.int64))

    def _rank_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        r = self.rank_table.get((x << 32) | y)
        return np.where(r >= 0, r, NEVER)

    def _incompatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: would a merge across the border come first?"""
        bad = np.zeros(len(a), bool)
        x, y = a.copy(), b.copy()
        until_x = np.full(len(a), NEVER)                   # rank at which the spine element's parent is made
        until_y = np.full(len(a), NEVER)
        live = np.arange(len(a))
        while len(live):
            xs, ys = x[live], y[live]
            r = self._rank_of(xs, ys)
            bad[live] = (r < NEVER) & (r < until_x[live]) & (r <= until_y[live])
            # the younger of the two elements is undone: that is the next earlier state of the border
            down_x = (self.rank[xs] > self.rank[ys]) | ((self.rank[xs] == self.rank[ys]) & (self.rank[xs] >= 0))
            gone = (self.rank[xs] < 0) & (self.rank[ys] < 0)
            i = live[down_x & ~gone]
            until_x[i] = self.rank[x[i]]
            x[i] = self.right[x[i]]
            j = live[~down_x & ~gone]
            until_y[j] = self.rank[y[j]]
            y[j] = self.left[y[j]]
            live = live[~gone & ~bad[live]]
        return bad

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first."""
        return self._exact_long(word)

    def _exact_long(self, word: bytes) -> list[int]:
        """A heap over a linked list: O(n log n)."""
        ids = [self.byte_id[c] for c in word]
        n = len(ids)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            m = self.merge.get((ids[i], ids[i + 1]))
            if m:
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, z = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = z, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            if prev[i] >= 0 and (m := self.merge.get((ids[prev[i]], z))):
                heapq.heappush(heap, (m[0], prev[i], ids[prev[i]], z, m[1]))
            if nxt[i] < n and (m := self.merge.get((z, ids[nxt[i]]))):
                heapq.heappush(heap, (m[0], i, z, ids[nxt[i]], m[1]))
        return [x for x in ids if x >= 0]

    def _greedy(self, word: bytes) -> list[int]:
        vocab, out, i, n = self.vocab, [], 0, len(word)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                t = vocab.get(word[i:j])
                if t is not None:
                    break
            out.append(t)
            i = j
        return out

    def _greedy_all(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of all words at once: (word, token) in order."""
        cursor = start.copy()
        live = np.flatnonzero(cursor < end)
        out_w, out_t = [], []
        while len(live):
            walk, node, pos = np.arange(len(live)), np.zeros(len(live), np.int64), cursor[live]
            best, best_end, stop = np.full(len(live), -1), pos.copy(), end[live]
            while len(walk):
                node = self.trie.get((node << 8) | buf[pos[walk]])
                ok = node >= 0
                walk, node = walk[ok], node[ok]
                pos[walk] += 1
                token = self.accepts[node]
                hit = token >= 0
                best[walk[hit]] = token[hit]
                best_end[walk[hit]] = pos[walk[hit]]
                more = pos[walk] < stop[walk]
                walk, node = walk[more], node[more]
            out_w.append(live)
            out_t.append(best)
            cursor[live] = best_end
            live = live[best_end < stop]
        if not out_w:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        w, t = np.concatenate(out_w), np.concatenate(out_t)
        order = np.argsort(w, kind="stable")
        return w[order], t[order]

    def _exact_all(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words in step: each round merges the first lowest-ranked pair of every word. All ids, and
        the number of each word's."""
        width = int(size.max())
        col = np.arange(width)
        inside = col < size[:, None]
        ids = np.where(inside, self.single[buf[np.minimum(start[:, None] + col, len(buf) - 1)]], -1)
        ranks = np.full(ids.shape, _NO_RANK, np.int32)
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self._rank_of(ids[:, :-1][pair], ids[:, 1:][pair]).clip(max=_NO_RANK)
        # a chain of tokens in each row; the place ``width`` stands for none
        after = np.tile(np.append(col + 1, width).astype(np.int16), (len(size), 1))
        after[np.arange(len(size)), size - 1] = width
        before = np.tile(np.append(col - 1, width).astype(np.int16), (len(size), 1))
        before[:, 0] = width
        out, live = ids, np.arange(len(size))
        while len(live):
            row = np.arange(len(live))
            j = ranks.argmin(axis=1)
            low = ranks[row, j]
            go = low < _NO_RANK
            if 4 * go.sum() <= 3 * len(live):
                # finished rows are put aside
                out[live[~go]] = ids[~go]
                live, ids, ranks, after, before = live[go], ids[go], ranks[go], after[go], before[go]
                continue
            row, j, low = row[go], j[go], low[go]
            made = self.made_by[low]
            right = after[row, j]
            end = after[row, right]
            ids[row, j] = made
            ids[row, right] = -1
            after[row, j] = end
            before[row, end] = j
            ranks[row, right] = _NO_RANK
            ranks[row, j] = _NO_RANK
            k = np.flatnonzero(end < width)
            ranks[row[k], j[k]] = self._rank_of(made[k], ids[row[k], end[k]]).clip(max=_NO_RANK)
            left = before[row, j]
            k = np.flatnonzero(left < width)
            ranks[row[k], left[k]] = self._rank_of(ids[row[k], left[k]], made[k]).clip(max=_NO_RANK)
        kept = out >= 0
        return out[kept], kept.sum(axis=1)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of pre-tokens: speculate, verify all adjacent pairs at once, repair the failures."""
        size = np.array([len(w) for w in words], np.int64)
        long = np.flatnonzero(size > LONG_WORD).tolist()
        if long:
            short = [words[i] if size[i] <= LONG_WORD else b"" for i in range(len(words))]
            out = self._encode_short(short)
            for i in long:
                out[i] = self._encode_long(words[i])
            return out
        return self._encode_short(words)

    def _encode_long(self, word: bytes) -> list[int]:
        guess = np.array(self._greedy(word), np.int64)
        return self.exact(word) if self._suspect(guess, np.ones(len(guess), bool)).any() else guess.tolist()

    def _suspect(self, flat: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Tokens that are not their own encoding or, where ``inner``, do not go with the next token."""
        own = self.own
        uniq, inv = np.unique(flat, return_inverse=True)
        for t in uniq.tolist():
            if t not in own:
                own[t] = self.exact(self.bytes_of[t]) == [t]
        fail = ~np.array([own[t] for t in uniq.tolist()], bool)[inv]
        at = np.flatnonzero(inner[:-1])
        if len(at):
            pairs, pinv = np.unique((flat[at] << 32) | flat[at + 1], return_inverse=True)
            fail[at] |= self._incompatible(pairs >> 32, pairs & 0xFFFFFFFF)[pinv]
        return fail

    def _encode_short(self, words: list[bytes]) -> list[list[int]]:
        size = np.array([len(w) for w in words], np.int64)
        ids, count = self._encode_spans(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
        ids, end = ids.tolist(), np.cumsum(count).tolist()
        return [ids[a:b] for a, b in zip([0, *end], end)]

    def _encode_spans(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words buf[start:start + size], and the number of each word's."""
        word, flat = self._greedy_all(buf, start, start + size)
        if not len(flat):
            return flat, np.zeros(len(start), np.int64)
        last = np.append(word[1:] != word[:-1], True)
        fail = np.unique(word[self._suspect(flat, ~last)])
        good = np.ones(len(start), bool)
        good[fail] = False
        count = np.bincount(word, minlength=len(start))
        mended = []
        for lo, hi in ((0, 8), (8, 12), (12, 16), (16, 24), (24, LONG_WORD)):
            some = fail[(size[fail] > lo) & (size[fail] <= hi)]
            for k in range(0, len(some), 1 << 13):
                part = some[k:k + (1 << 13)]
                ids, count[part] = self._exact_all(buf, start[part], size[part])
                mended.append((part, ids))
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        out[spread(first[good], count[good])] = flat[good[word]]
        for part, ids in mended:
            out[spread(first[part], count[part])] = ids
        return out, count

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Encode pieces of any kind: their packed ids."""
        words: dict[str, int] = {}
        split = [[words.setdefault(w, len(words)) for w in _PRE.findall(str(p, "utf-8"))] for p in pieces]
        enc = self.encode_words([w.encode() for w in words])
        end = np.cumsum([0] + [len(e) for e in enc]) * self.type.itemsize
        raw = np.fromiter(chain.from_iterable(enc), self.type).tobytes()
        ids = [raw[a:b] for a, b in zip(end.tolist(), end[1:].tolist())]
        return [b"".join([ids[w] for w in ws]) for ws in split]

    def _long(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of long pieces. The cache has two generations: when the young one is full, the old one goes; an entry found in
        the old one moves to the young one."""
        young, old = self.long
        got = {p: young.get(p) or old.get(p) for p in set(pieces)}
        new = [p for p, e in got.items() if e is None]
        got.update(zip(new, self._learn(new)))
        for p, e in got.items():
            if len(p) <= LONG_BYTES and p not in young:
                young[p] = e
                self.long_size += len(p) + len(e)
                if len(young) > LONG_PIECES // 2 or self.long_size > LONG_CACHE // 2:
                    self.long, self.long_size = [{}, young], 0
                    young = self.long[0]
        return [got[p] for p in pieces]

    def _new(self, padded: np.ndarray, start: np.ndarray, size: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short pieces, and the number of each one's. ``turns``: how often the class has changed up to each byte."""
        head = start + ((padded[start] == 32) & (size > 1))
        # ASCII letters, digits or others alone, with or without a space before them, are one word
        plain = (turns[start + size - 1] == turns[head]) & (_RUN[padded[head]] < _S)
        odd = np.flatnonzero(~plain)
        ids, count = self._encode_spans(padded, start[plain], size[plain])
        if not len(odd):
            return ids, count
        rest = [np.frombuffer(x, self.type) for x in self._learn([padded[a:a + n].tobytes() for a, n in zip(start[odd].tolist(), size[odd].tolist())])]
        all_count = np.empty(len(start), np.int64)
        all_count[plain] = count
        all_count[odd] = [len(x) for x in rest]
        first = np.cumsum(all_count) - all_count
        out = np.empty(int(all_count.sum()), np.int64)
        out[spread(first[plain], count)] = ids
        out[spread(first[odd], all_count[odd])] = np.concatenate(rest)
        return out, all_count

    def _block(self, padded: np.ndarray, start: np.ndarray, size: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and the number of each one's."""
        table = self.table
        at = np.flatnonzero(size <= KEY_BYTES)
        keys = table.key(padded, start[at], size[at])
        entry = table.find(keys)
        absent = np.flatnonzero(entry < 0)
        if len(absent):
            order = absent[np.lexsort(keys[:, absent])]
            sorted_ = keys[:, order]
            lead = np.append(True, (sorted_[:, 1:] != sorted_[:, :-1]).any(axis=0))
            new = order[lead]
            made = table.add(keys[:, new], *self._new(padded, start[at[new]], size[at[new]], turns))
            entry[order] = made[np.cumsum(lead) - 1]
        first, count = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        first[at], count[at] = table.first[entry], table.count[entry]
        far = np.flatnonzero(size > KEY_BYTES)
        if len(far):
            # for this block alone, behind the table's ids
            rows = self._long([padded[a:a + n].tobytes() for a, n in zip(start[far].tolist(), size[far].tolist())])
            count[far] = [len(r) // self.type.itemsize for r in rows]
            first[far] = table.used + np.cumsum(count[far]) - count[far]
            ids = np.frombuffer(b"".join(rows), self.type)
            table.room(len(ids))
            table.ids[table.used:table.used + len(ids)] = ids
        out = table.ids[spread(first, count)]
        table.trim(CACHE_PIECES)
        return out, count

    def _rows(self, rows: list[bytes]) -> list[bytes]:
        """The packed ids of UTF-8 texts without added tokens."""
        offsets = np.cumsum([0] + [len(r) for r in rows])
        n = int(offsets[-1])
        if not n:
            return [b""] * len(rows)
        padded = np.frombuffer(b"".join([*rows, bytes(KEY_BYTES + 8)]), np.uint8)
        start = cut_places(padded[:n], offsets)
        size = np.diff(np.append(start, n))
        run = _RUN[padded[:n]]
        turns = np.cumsum(np.append(False, run[1:] != run[:-1]), dtype=np.int32 if n < 1 << 31 else np.int64)
        ids, count = zip(*[self._block(padded, start[k:k + BLOCK], size[k:k + BLOCK], turns) for k in range(0, len(start), BLOCK)])
        raw = memoryview(np.concatenate(ids)).cast("B")
        end = np.append(0, np.cumsum(np.concatenate(count))) * self.type.itemsize
        end = end[np.searchsorted(start, offsets)].tolist()
        return [bytes(raw[a:b]) for a, b in zip(end, end[1:])]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, packed."""
        if self.split_added is None or not any(a in t for t in texts for a in self.added):
            return self._rows([t.encode() for t in texts])
        parts = [self.split_added.split(t) for t in texts]              # every second part is an added token
        got = iter(self._rows([p.encode() for row in parts for p in row[::2]]))
        added = {a: np.array([i], self.type).tobytes() for a, i in self.added.items()}
        return [b"".join([added[p] if k % 2 else next(got) for k, p in enumerate(row)]) for row in parts]

    def _looked_up(self, table: pa.Array, rows: list[bytes]) -> list[memoryview]:
        """Per row of packed ids what ``table`` has for them, joined."""
        ids = np.frombuffer(b"".join(rows), self.type)
        if not len(ids):
            return [memoryview(b"")] * len(rows)
        got = table.take(pa.array(ids))
        offsets, data = np.frombuffer(got.buffers()[1], np.int64)[got.offset:], memoryview(got.buffers()[2])
        ends = offsets[np.cumsum([0] + [len(r) for r in rows]) // self.type.itemsize].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def ids_text(self, rows: list[bytes]) -> list[memoryview]:
        """Per row of packed ids these in decimal, joined by commas."""
        return [x[:-1] for x in self._looked_up(self.token_text, rows)]

    def decoded(self, rows: list[bytes]) -> list[str]:
        """What rows of packed ids decode to."""
        return [str(x, "utf-8", "replace") for x in self._looked_up(self.token_bytes, rows)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed([text])[0], self.type).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decoded([np.array(ids, self.type).tobytes()])[0]


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """The codec of a file, made once in each Python worker and kept, with its caches, until a task of another operator comes."""
    enter_task("bpe")
    keeps_cache("bpe", _CODECS.clear)
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def vocab_size(path: str) -> int:
    """Number of ids of a tokenizer file, added tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec["added_tokens"])]) + 1


def _groups(arr: pa.Array, max_chars: int = 1 << 20):
    """Slices of rows holding a bounded amount of text (one row at least)."""
    row, size = [], 0
    for x in arr:
        t = x.as_py()
        row.append(t)
        size += len(t)
        if size >= max_chars:
            yield row
            row, size = [], 0
    if row:
        yield row


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and the decoded text of every document. Map-only."""
    src = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        c = codec(path)
        for b in releasing(batches):
            at = 0
            for texts in _groups(string_array(b, "text")):
                rows = c.packed(texts)
                ids = [np.frombuffer(r, c.type).astype(np.int32) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array(c.decoded(rows), pa.string())],
                    ["doc_id", "ids", "decoded"])
                at += len(texts)

    ddl = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {ddl}, ids array<int>, decoded string")


def packed_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: packed as ``id_type`` of the vocabulary) of every document. Map-only."""
    src = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        c = codec(path)
        for b in releasing(batches):
            at = 0
            for texts in _groups(string_array(b, "text")):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(c.packed(texts), pa.binary())], ["doc_id", "ids"])
                at += len(texts)

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids binary")


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: the ids are decoded again, and their
    lists never leave the task."""
    src = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        c = codec(path)
        for b in releasing(batches):
            n, ids, dec = [], [], []
            for texts in _groups(string_array(b, "text")):
                rows = c.packed(texts)
                n += [len(r) // c.type.itemsize for r in rows]
                ids += [sha256_hex(x) for x in c.ids_text(rows)]
                dec += [sha256_hex(x.encode()) for x in c.decoded(rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ddl = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {ddl}, n_tokens long, ids_sha256 string, decoded_sha256 string")

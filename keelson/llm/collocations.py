"""Phrase collocations: phrases of 2 to 5 words that are more frequent than their parts suggest, by language.

1. Texts become shards: about ``SHARD_TOKENS`` words of one language from one task's rows, as word ids of the shard with 0 between pieces, and the
   shard's dictionary, both compressed, written once.
2. In two rounds (words and pairs, then 3 to 5 words) each shard enumerates its phrases with ``fmindex``, extending intervals in turn to the right and to
   the left. First hashes of words and language are summed over all shards (``Sieve``); phrases whose hash reaches ``MIN_COUNT`` are then reported with
   their counts and a second hash. A phrase is no more frequent than its parts, so what is too rare breaks the text, and the second round
   indexes what remains. No count is cut off before the sum over all shards; hashes only spare phrases that cannot matter.
3. Counts are summed by both hashes, and frequent phrases get their words from one shard each. Cuts, scores and the choice of each language's best are joins over
   these phrases, in decimals of 38 digits.

Hashes, digests and counts travel as packed arrays by (shard, bucket), so a shuffle has few rows.

A candidate is dropped if a longer one holds it with the same count: then one that is longer by one word does, so one extension decides.

Defined cases: a null text is empty, a null language is ``und``; empty tables give no rows; a text is cut between pieces only, so
a shard is larger than ``SHARD_TOKENS`` where one piece is; extra columns are ignored. Two different phrases are taken for one only if they agree in length
and in all of at least 40 + 7 bits of hash, more the more words there are (80 for a terabyte of text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import byte_class, mix64, release_memory, scratch_table, string_array, text_chunks, word_spans
from keelson.llm.fmindex import FMIndex, Patterns

MIN_COUNT, MOST_WORDS, TOP = 100, 5, 2000
SHARD_TOKENS = 2_000_000
BUCKET_ROWS = 1_000_000
SALTS = 64                                          # a language's phrases are ranked in so many parts first

_SPACE = byte_class((0x20, 0x20), (0x09, 0x09))
_BREAK = np.zeros(256, bool)
_BREAK[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
_WORD = ~(_SPACE | _BREAK)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODEC = pa.Codec("zstd", compression_level=3)


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True) if raw else b""


def _unpack(b: bytes) -> bytes:
    return _CODEC.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True) if b else b""


def _planes(a: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: high bytes of small numbers cost nothing."""
    return _pack(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def _unplanes(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(_unpack(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


# ------------------------------------------------------------------------------------------------ shards

def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a chunk of texts, and whether a piece begins with each."""
    buf = _LOWER[buf]
    start, end, first = word_spans(buf, offsets, _WORD)
    broken = np.concatenate([[0], np.cumsum(_BREAK[buf])])
    begins = np.ones(len(start), bool)
    begins[1:] = broken[start[1:]] != broken[end[:-1]]
    begins[first[first < len(start)]] = True
    size = np.concatenate([[0], np.cumsum(end - start)])
    data = buf[_WORD[buf]]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(data)]), begins


def _shard(words: list[pa.Array], begins: list[np.ndarray]) -> tuple[np.ndarray, pa.Array]:
    """Ids of the words in order, with 0 before each piece and at the end, and the dictionary."""
    coded = pa.concat_arrays(words).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(ids, minlength=len(coded.dictionary)), kind="stable")       # frequent words get small ids
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(1, len(order) + 1)
    ids = place[ids]
    new = np.concatenate(begins)
    new[0] = True
    at = np.arange(len(ids)) + np.cumsum(new)
    text = np.zeros(len(ids) + int(new.sum()) + 1, np.int32)
    text[at] = ids
    return text, coded.dictionary.take(pa.array(order))


class _Held:
    """Words of one language that wait for their shard."""

    def __init__(self):
        self.words, self.begins, self.n = [], [], 0

    def add(self, words, begins):
        self.words.append(words)
        self.begins.append(begins)
        self.n += len(words)

    def take(self, size: int) -> tuple[list, list]:
        """About ``size`` words, up to where a piece begins."""
        if self.n <= size * 3 // 2:
            out = self.words, self.begins
            self.__init__()
            return out
        words, begins = pa.concat_arrays(self.words), np.concatenate(self.begins)
        later = np.flatnonzero(begins[size:])
        cut = size + int(later[0]) if len(later) else len(begins)
        self.__init__()
        if cut < len(begins):
            self.add(words.slice(cut), begins[cut:])
        return [words.slice(0, cut)], [begins[:cut]]


def _shards(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        held: dict[str, _Held] = {}

        def made(lang):
            nonlocal number
            text, words = _shard(*held[lang].take(most))
            if not held[lang].n:
                del held[lang]
            size = np.diff(np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]).astype(np.int32)
            row = [pa.array([number], pa.int64()), pa.array([lang]), pa.array([int((text > 0).sum())], pa.int64()),
                   pa.array([_planes(text)], pa.binary()), pa.array([_planes(size)], pa.binary()),
                   pa.array([_pack(b"".join(words.to_pylist()))], pa.binary())]
            number += 1
            return pa.RecordBatch.from_arrays(row, names=["shard", "lang", "tokens", "text", "sizes", "words"])

        for b in batches:
            langs = b.column(b.schema.get_field_index("lang"))
            for lang in pc.unique(langs).to_pylist():
                rows = b.filter(pc.equal(langs, lang))
                for _, buf, off in text_chunks(string_array(rows, "text")):
                    words, begins = words_of(buf, off)
                    if len(words):
                        held.setdefault(lang, _Held()).add(words, begins)
                    while sum(h.n for h in held.values()) > 3 * most // 2:
                        yield made(max(held, key=lambda k: held[k].n))
        while held:
            yield made(next(iter(held)))

    return run


# rows of the one table that a step writes: texts after pruning, hashes to be summed, phrases with their counts
_KEPT, _ASKED, _COUNTED = range(3)
_STEP = "kind int, shard long, lang string, bucket int, text binary, words binary, sizes binary, digests binary"
_STEP_ARROW = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("lang", pa.string()), ("bucket", pa.int32()), ("text", pa.binary()),
                         ("words", pa.binary()), ("sizes", pa.binary()), ("digests", pa.binary())])
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _step_rows(kind: int, shard: int, rows: list[tuple], *names: str) -> pa.Table:
    cols = dict(zip(names, zip(*rows))) if rows else {}
    n = len(rows)
    cols |= {"kind": [kind] * n, "shard": [shard] * n}
    return pa.table([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _STEP_ARROW], schema=_STEP_ARROW)


def _cuts(of: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of the runs of a sorted array."""
    edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    return [(int(of[x]), int(x), int(y)) for x, y in zip(edge, np.append(edge[1:], len(of)))]


def _rising(a: np.ndarray) -> bytes:
    """A sorted array as differences."""
    step = a.copy()
    step[1:] -= a[:-1]
    return _planes(step)


class Sieve:
    """Hashes of phrases, ``bits`` long, in ``buckets`` ranges. Phrases of one hash are summed together over all shards, so a hash below the least
    count holds no frequent phrase; the few others get a rank in their bucket and are counted one by one afterwards."""

    def __init__(self, occurrences: int, least: int, parts: int):
        self.bits = min(64, max(2, occurrences).bit_length() + 6)
        self.buckets = max(parts, -(-occurrences // BUCKET_ROWS))
        self.least = least

    def hashes(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        """Range of a hash; grows with it."""
        top = min(32, self.bits)
        return ((h >> np.uint64(self.bits - top)) * np.uint64(self.buckets)) >> np.uint64(top)

    def asked(self, shard: int, h: np.ndarray, count: np.ndarray) -> pa.Table:
        """One row for each bucket: sorted hashes as differences, and counts."""
        h = self.hashes(h)
        order = np.argsort(h)
        h, count = h[order], count[order].astype(np.uint32)
        out = [(k, _rising(h[x:y]), _planes(count[x:y])) for k, x, y in _cuts(self.bucket(h))]
        return _step_rows(_ASKED, shard, out, "bucket", "text", "words")

    def sum(self, rows: pa.Table) -> pa.Table:
        """One bucket of all shards: to each shard those of its hashes whose sum reaches the least count, with their ranks."""
        shards = rows.column("shard").to_pylist()
        hashes = [np.cumsum(_unplanes(b, np.uint64)) for b in rows.column("text").to_pylist()]
        counts = np.concatenate([_unplanes(b, np.uint32) for b in rows.column("words").to_pylist()]).astype(np.float64)
        every, at = np.unique(np.concatenate(hashes), return_inverse=True)
        enough = np.bincount(at, weights=counts) >= self.least              # exact: below 2^53
        rank = np.cumsum(enough) - 1
        out, start = [], 0
        bucket = rows.column("bucket")[0].as_py()
        for shard, h in zip(shards, hashes):
            mine = np.unique(at[start:start + len(h)])
            start += len(h)
            mine = mine[enough[mine]]
            if len(mine):
                out.append((shard, bucket, _rising(every[mine]), _rising(rank[mine].astype(np.uint32))))
        cols = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                        names=["shard", "bucket", "hashes", "ranks"])


class _Good:
    """The hashes of a shard that reach the least count, sorted, with bucket and rank."""

    def __init__(self, sieve: Sieve, answers: pa.Table):
        self.sieve = sieve
        rows = answers.sort_by("bucket").to_pylist()
        hashes = [np.cumsum(_unplanes(r["hashes"], np.uint64)) for r in rows]
        self.hashes = np.concatenate(hashes)
        self.ranks = np.concatenate([np.cumsum(_unplanes(r["ranks"], np.uint32), dtype=np.uint32) for r in rows])
        self.buckets = np.repeat([r["bucket"] for r in rows], [len(h) for h in hashes])

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which phrases have such a hash, and where it stands."""
        h = self.sieve.hashes(h)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        good = self.hashes[at] == h
        return good, at[good]


class _Shard:
    """One shard as its row holds it: the text and the digests of its word ids; the words themselves where they are asked for."""

    def __init__(self, row: dict):
        self.number, self.lang = row["shard"], row["lang"]
        self.text = _unplanes(row["text"], np.int32) if row.get("text") else np.empty(0, np.int32)
        self._sizes, self._words, self._digests = row.get("sizes"), row.get("words"), row.get("digests")

    def dictionary(self) -> tuple[list[int], bytes]:
        """Where each word ends, and all words."""
        return [0, *np.cumsum(_unplanes(self._sizes, np.int32), dtype=np.int64).tolist()], _unpack(self._words)

    def digests(self) -> np.ndarray:
        """128 bits for each word id, by id; those of full shards are made from their words."""
        if self._digests:
            return np.frombuffer(_unpack(self._digests), np.uint64).reshape(-1, 2)
        ends, words = self.dictionary()
        seed, digest = xxhash.xxh3_64_intdigest(self.lang.encode()), xxhash.xxh3_128_digest
        raw = b"".join([digest(words[x:y], seed) for x, y in zip(ends, ends[1:])])
        return np.concatenate([np.zeros((1, 2), np.uint64), np.frombuffer(raw, np.uint64).reshape(-1, 2)])


def _phrase_hash(symbols: np.ndarray, digests: np.ndarray, lane: int) -> np.ndarray:
    """64 bits of each phrase from the digests of its words."""
    h = np.full(len(symbols), symbols.shape[1], np.uint64)
    for k in range(symbols.shape[1]):
        h = mix64(h * _ODD[lane] + digests[symbols[:, k], lane])
    return h


_CHECK = np.uint64(24)       # the second half of a digest tells phrases of one hash apart, by its first 40 bits


def _counted(shard: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], digests: np.ndarray, good: _Good) -> pa.Table:
    """Phrases (word ids) with their counts and the places of their hashes, one row for each bucket and length."""
    out = []
    for symbols, count, at in found:
        order = np.argsort(at, kind="stable")
        symbols, count, at = symbols[order], count[order].astype(np.uint32), at[order]
        check = _phrase_hash(symbols, digests, 1) >> _CHECK
        for k, x, y in _cuts(good.buckets[at]):
            out.append((k, _rising(good.ranks[at[x:y]]), _planes(check[x:y]), _planes(count[x:y]),
                        bytes([symbols.shape[1]]) + _planes(np.ascontiguousarray(symbols[x:y].T, np.int32).ravel())))
    return _step_rows(_COUNTED, shard, out, "bucket", "text", "words", "sizes", "digests")


def _sum_counts(least: int):
    """One bucket of all shards: the phrases whose counts sum up to ``least``, each told to one of the shards that hold it."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        ranks = [np.cumsum(_unplanes(r["text"], np.uint32), dtype=np.uint32) for r in rows]
        sizes = [len(x) for x in ranks]
        length = np.repeat(np.array([r["digests"][0] for r in rows], np.uint64), sizes)
        check = (np.concatenate([_unplanes(r["words"], np.uint64) for r in rows]) << np.uint64(8)) | length
        rank = np.concatenate(ranks)
        count = np.concatenate([_unplanes(r["sizes"], np.uint32) for r in rows]).astype(np.int64)
        which = np.repeat(np.arange(len(rows)), sizes)
        draw = mix64(check ^ mix64(np.array([r["shard"] for r in rows], np.int64).view(np.uint64))[which])
        order = np.lexsort((draw, check, rank))
        rank, check, count, which = rank[order], check[order], count[order], which[order]
        edge = np.flatnonzero(np.concatenate([[True], (rank[1:] != rank[:-1]) | (check[1:] != check[:-1])]))
        total = np.add.reduceat(count, edge)
        enough = total >= least
        first, total = edge[enough], total[enough]
        row, at = which[first], order[first] - np.concatenate([[0], np.cumsum(sizes)])[which[first]]
        out = []
        for k in np.unique(row):
            ids = _unplanes(rows[k]["digests"][1:], np.int32).reshape(rows[k]["digests"][0], -1)
            mine = row == k
            out.append((rows[k]["shard"], rows[k]["digests"][0], _planes(np.ascontiguousarray(ids[:, at[mine]].T).ravel()), _planes(total[mine])))
        cols = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["shard", "size", "ids", "totals"])
    return run


# ------------------------------------------------------------------------------------------------ rounds

def kept_words(text: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The text (``keep`` by id) with rare words made breaks; breaks do not repeat."""
    out = np.where(keep[text], text, 0).astype(np.int32)
    out = out[np.concatenate([[True], (out[1:] > 0) | (out[:-1] > 0)])]
    return out if out[-1] == 0 else np.append(out, np.int32(0))


def kept_pairs(text: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The runs of at least three words in which every pair is one of ``pairs``, with one break around each."""
    top = int(text.max()) + 1
    joined = np.isin(text[:-1].astype(np.int64) * top + text[1:], pairs[:, 0].astype(np.int64) * top + pairs[:, 1]) & (text[:-1] > 0) & (text[1:] > 0)
    edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    long = end - start >= 3
    start, end = start[long], end[long]
    size = end - start + 1
    at = np.cumsum(size) - size
    where = np.arange(int(size.sum())) - np.repeat(at, size)            # 0: the break before a run
    out = np.where(where > 0, text[np.repeat(start, size) + where - 1], 0)
    return np.append(out, 0).astype(np.int32)


def phrases(text: np.ndarray, shortest: int, longest: int) -> Iterator[Patterns]:
    """All phrases of a text by length; the index grows them to the right and to the left in turn."""
    if not text.any():
        return
    used = np.unique(text)
    index = FMIndex(np.searchsorted(used, text).astype(np.int32), longest)
    p = index.single()
    for length in range(2, longest + 1):
        p = index.right(p) if length % 2 == 0 else index.left(p)
        if length >= shortest:
            yield Patterns(p.count, used[p.symbols])


def _one(shards: pa.Table, answers: pa.Table) -> _Shard | None:
    return _Shard(shards.to_pylist()[0]) if shards.num_rows and answers.num_rows else None


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words as phrases, and their hashes."""
    ids = np.arange(1, len(digests), dtype=np.int32)[:, None]
    return ids, _phrase_hash(ids, digests, 0)


def _ask_words_and_pairs(sieve: Sieve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard = _Shard(row)
                digests = shard.digests()
                hashes, counts = [_words(digests)[1]], [np.bincount(shard.text, minlength=len(digests))[1:]]
                for p in phrases(shard.text, 2, 2):
                    hashes.append(_phrase_hash(p.symbols, digests, 0))
                    counts.append(p.count)
                yield from sieve.asked(shard.number, np.concatenate(hashes), np.concatenate(counts)).to_batches()
                release_memory()
    return run


def _after_pairs(given: Sieve, then: Sieve, longest: int):
    """The counts of a shard's words and pairs, the runs of such pairs in its text, and the hashes of the longer phrases in them."""
    def run(shards: pa.Table, answers: pa.Table) -> pa.Table:
        shard = _one(shards, answers)
        if shard is None:
            return _STEP_ARROW.empty_table()
        digests, good = shard.digests(), _Good(given, answers)
        ids, h = _words(digests)
        some, at = good.place(h)
        size = np.bincount(shard.text, minlength=len(digests))
        keep = np.concatenate([[False], some])
        counted, out = [(ids[some], size[keep], at)], []
        for p in phrases(kept_words(shard.text, keep), 2, 2):
            some, at = good.place(_phrase_hash(p.symbols, digests, 0))
            pairs = p.symbols[some]
            counted.append((pairs, p.count[some], at))
            runs = kept_pairs(shard.text, pairs)
            used = np.unique(runs)                              # the ids stay, the digests of others go
            if len(used) > 1:
                few = np.zeros_like(digests)
                few[used] = digests[used]
                out.append(_step_rows(_KEPT, shard.number, [(shard.lang, _planes(runs), _pack(few.tobytes()))], "lang", "text", "digests"))
                longer = [(_phrase_hash(q.symbols, digests, 0), q.count) for q in phrases(runs, 3, longest)]
                if longer:
                    out.append(then.asked(shard.number, np.concatenate([x for x, _ in longer]), np.concatenate([n for _, n in longer])))
        out.append(_counted(shard.number, counted, digests, good))
        release_memory()
        return pa.concat_tables(out)
    return run


def _last(given: Sieve, longest: int):
    """The counts of a shard's phrases of three words and more."""
    def run(shards: pa.Table, answers: pa.Table) -> pa.Table:
        shard = _one(shards, answers)
        if shard is None:
            return _STEP_ARROW.empty_table()
        digests, good, counted = shard.digests(), _Good(given, answers), []
        for p in phrases(shard.text, 3, longest):
            some, at = good.place(_phrase_hash(p.symbols, digests, 0))
            counted.append((p.symbols[some], p.count[some], at))
        release_memory()
        return _counted(shard.number, counted, digests, good)
    return run


def _spell(shards: pa.Table, told: pa.Table) -> pa.Table:
    """Phrases by their words."""
    texts, n, f, lang = [], [], [], None
    shard = _one(shards, told)
    if shard is not None:
        lang = shard.lang
        ends, words = shard.dictionary()
        for row in told.to_pylist():
            f.append(_unplanes(row["totals"], np.int64))
            for ids in _unplanes(row["ids"], np.int32).reshape(-1, row["size"]).tolist():
                texts.append(b" ".join(words[ends[i - 1]:ends[i]] for i in ids).decode())
                n.append(row["size"])
    total = np.concatenate(f) if f else np.empty(0, np.int64)
    return pa.table([pa.array([lang] * len(texts), pa.string()), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(total)],
                    names=["lang", "phrase", "size", "f"])


def frequent_phrases(docs: DataFrame, least: int = MIN_COUNT, longest: int = MOST_WORDS, shard_tokens: int = SHARD_TOKENS,
                     text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all words and phrases with at least ``least`` occurrences, and (lang, n) with each language's number of words."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    full = scratch_table(src.mapInArrow(_shards(shard_tokens), "shard long, lang string, tokens long, text binary, sizes binary, words binary"),
                         "phrase-shards")
    occurrences = full.agg(F.sum("tokens")).first()[0] or 0
    short, long = Sieve(2 * occurrences, least, parts), Sieve(max(1, longest - 2) * occurrences, least, parts)

    def by_bucket(step: DataFrame, kind: int, fn, ddl: str, *columns: str) -> DataFrame:
        rows = step.where(F.col("kind") == kind).select("shard", "bucket", *columns)
        return rows.repartition(parts, "bucket").groupBy("bucket").applyInArrow(fn, ddl)

    def by_shard(shards: DataFrame, answers: DataFrame, fn, ddl: str = _STEP) -> DataFrame:
        return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(fn, ddl)

    def answers(step: DataFrame, sieve: Sieve) -> DataFrame:
        return by_bucket(step, _ASKED, lambda rows: sieve.sum(rows), "shard long, bucket int, hashes binary, ranks binary",
                         "text", "words")

    asked = full.mapInArrow(_ask_words_and_pairs(short), _STEP)
    one = scratch_table(by_shard(full.drop("tokens"), answers(asked, short), _after_pairs(short, long, longest)), "phrase-pairs")
    runs = one.where(F.col("kind") == _KEPT).select("shard", "lang", "text", "digests")
    two = by_shard(runs, answers(one, long), _last(long, longest))
    told = None
    for step in (one, two):
        rows = by_bucket(step, _COUNTED, _sum_counts(least), "shard long, size int, ids binary, totals binary", "text", "words", "sizes", "digests")
        told = rows if told is None else told.unionByName(rows)
    spelt = by_shard(full.select("shard", "lang", "sizes", "words"), told, _spell, "lang string, phrase string, size int, f long")
    return scratch_table(spelt, "phrases"), scratch_table(full.groupBy("lang").agg(F.sum("tokens").alias("n")), "phrase-totals")


# ------------------------------------------------------------------------------------------------ scores

def _joined(words, start, size):
    return F.array_join(F.slice(words, start, size), " ")


def collocations(phrases: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` candidates, from all frequent words and phrases."""
    words = F.split("phrase", " ", -1)
    inner = phrases.where("size > 2").withColumn("w", words).select("lang", "f", F.explode(F.array(
        _joined(F.col("w"), F.lit(1), F.col("size") - 1), _joined(F.col("w"), F.lit(2), F.col("size") - 1))).alias("phrase")).distinct()
    left = phrases.where("size > 1").join(inner, ["lang", "phrase", "f"], "left_anti")
    cuts = left.withColumn("w", words).select("lang", "phrase", F.col("f").alias("a"), "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("w"), F.lit(1), F.col("k")).alias("head"),
                       _joined(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]) \
        .join(phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.join(totals, "lang").withColumn(
        "score", F.expr("(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * 1000) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")) \
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = best.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))) \
        .where(F.col("rank") <= top).drop("salt", "rank")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

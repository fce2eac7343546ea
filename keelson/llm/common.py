"""Helpers shared by the corpus operators.

* ``scratch_table`` writes a DataFrame to the shared folder and reads it back (a lineage cut that survives lost
  executors and costs one copy); ``frees_shuffles`` drops the shuffle files of queries that run once.
* ``text_chunks`` walks an Arrow batch in slices of bounded size, as one byte buffer plus row offsets, so numpy
  can work on many documents at once without holding more than one slice. A single text is never split.
* ``PrefixHash`` gives the 64-bit hash of any byte span of a buffer: of short spans in constant time (a polynomial over random
  byte values modulo 2^64, finished by a bit mixer), of long ones, for which such polynomials have known collisions, by xxh3. ``word_spans``
  finds words by byte class.
* ``enter_task`` lets one operator's tasks give back what another operator cached in the same Python worker; ``releasing`` walks batches
  and gives back after each what its work has freed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from keelson.session import scratch_path

CHUNK_BYTES = 1 << 20

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
# odd multiplier and its inverse modulo 2^64, so that powers can be divided out of prefix sums
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)


def scratch_table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the session's checkpoint folder and return it as read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def frees_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside give up their shuffle files as soon as they end; else these stay until the driver happens to collect its
    garbage. For queries that run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (splitmix steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, kept between calls up to a few chunks' length."""
    if len(_POWERS["p"]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, _BASE_INV):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        if size > 8 * CHUNK_BYTES:
            return out[0], out[1]
        _POWERS["p"], _POWERS["inv"] = out
    return _POWERS["p"], _POWERS["inv"]


LONG_SPAN = 64      # a polynomial modulo 2^64 maps certain pairs of 1,024 bytes and more to one value, whatever its base; none so short


class PrefixHash:
    """Hashes of byte spans of one buffer. With ``lowered_values`` A-Z count as a-z."""

    def __init__(self, buf: np.ndarray, values: np.ndarray = _BYTE_VALUE):
        p, self._inv = _powers(len(buf) + 1)
        self._buf, self._values = buf, values
        self._c = np.empty(len(buf) + 1, np.uint64)
        self._c[0] = 0
        np.cumsum(values[buf] * p[: len(buf)], out=self._c[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of buf[start:end] for arrays of positions."""
        out = mix64((self._c[end] - self._c[start]) * self._inv[start])
        long = np.flatnonzero(end - start > LONG_SPAN)
        if len(long):
            same = self._values[65] == self._values[97]
            data = (_LOWERED[self._buf] if same else np.ascontiguousarray(self._buf)).data
            out[long] = [xxhash.xxh3_64_intdigest(data[x:y]) for x, y in zip(start[long].tolist(), end[long].tolist())]
        return out

    def windows(self, width: int) -> np.ndarray:
        """Hash of every window of ``width`` (at most ``LONG_SPAN``) bytes, by start position."""
        n = len(self._c) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix64((self._c[width:] - self._c[:n]) * self._inv[:n])


_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def lowered_values() -> np.ndarray:
    """Byte values for ``PrefixHash`` under which A-Z equal a-z."""
    v = _BYTE_VALUE.copy()
    v[65:91] = v[97:123]
    return v


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a:b + 1] = True
    return table


def word_spans(buf: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes that never cross a row: (start, end, first word of each row + total)."""
    flag = np.zeros(len(buf) + 2, bool)
    flag[1:-1] = in_word[buf]
    inner = flag[1:-1]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    begins = inner & (~flag[:-2] | edge[:-1])
    ends = inner & (~flag[2:] | edge[1:])
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def string_array(batch: pa.RecordBatch, col: str) -> pa.Array:
    """The column as large strings with nulls as empty texts."""
    a = batch.column(batch.schema.get_field_index(col))
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    return pc.fill_null(a.cast(pa.large_string()), "")


def text_chunks(arr: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive row slices, each of one row or of at most ``max_bytes``."""
    n = len(arr)
    if n == 0:
        return
    _, off_buf, data_buf = arr.buffers()
    off = np.frombuffer(off_buf, np.int64)[arr.offset:arr.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1)
        j = min(j, n)
        yield i, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def bounded_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """``df``, with the session's Arrow batches limited to ``rows`` rows (fewer if it is set so): a batch of long texts is
    held several times over, by the JVM and by the Python worker."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def id_type(vocab_size: int) -> np.dtype:
    """How token ids are packed: two bytes each where the vocabulary and two marks beyond it fit, else four."""
    return np.dtype("<u2" if vocab_size + 2 <= 1 << 16 else "<i4")


def release_memory() -> None:
    """Gives freed memory back to the system. Python workers outlive their tasks, and what one operator needed for a
    moment would otherwise stay with the executor during the next one."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):       # not glibc
        pass


def releasing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each one, what its work has freed goes back to the system. Else a worker holds the most that any of its batches took,
    in pieces between what is kept."""
    for b in batches:
        yield b
        release_memory()


_CACHES: dict[str, Callable[[], None]] = {}
_TASKS = {"owner": ""}


def keeps_cache(owner: str, clear: Callable[[], None]) -> None:
    """Says how to drop what ``owner`` keeps in this Python worker between tasks."""
    _CACHES[owner] = clear


def enter_task(owner: str) -> None:
    """To be called at the start of a task: caches of other operators, which may never be asked for again, go, and so does memory that the
    last operator's tasks have freed."""
    others = [k for k in _CACHES if k != owner]
    for k in others:
        _CACHES.pop(k)()
    if others or owner != _TASKS["owner"]:
        _TASKS["owner"] = owner
        _POWERS.update(p=np.ones(1, np.uint64), inv=np.ones(1, np.uint64))
        release_memory()


def known_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An id column as int64 (0 where null, which no float touches) and where it is not null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    known = np.asarray(column.is_valid())
    return np.asarray(pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), np.int64), known


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

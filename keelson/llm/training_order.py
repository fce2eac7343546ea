"""Training-order materialisation: every token sequence gets a global slot, and shards hold the slots in order.

Documents are token ids, then an end mark, cut into sequences of ``length`` tokens, the last one padded. The ids are those
of a token column (``tokens_col``: an array, or binary packed as ``id_type``) of a vocabulary of ``vocab_size`` ids, packed in two or
four bytes each; the end mark is the id ``vocab_size``, the padding the next one. Without a token column they are the UTF-8 bytes of the
text, ended by ``END`` and padded with ``PAD``; neither value occurs in UTF-8. Sequences are numbered in (doc_id, part) order, and a keyed
Feistel permutation of 0..n-1 sends each number to its slot: rounds of a keyed mixer over two halves of a domain of 4^k
numbers, repeated on results outside 0..n-1 (cycle-walking). The order is a pseudo-random function of the key alone, needs
no sort of random numbers and no state, and can be inverted.

Slots are range-partitioned and written ``shard_rows`` to a shard, one file each, as records of ``length`` ids and a
line end as wide as an id: fixed stride, so slot s is at byte (s mod shard_rows) * stride of shard s div shard_rows, and a reader can
stop anywhere and resume. Spark's own committer writes the files, so a lost or repeated task leaves no partial shard. The shards are written in
``WRITES`` jobs, a range of slots each, that drop their shuffle files: beside the shards and the ids there is only a part of the ids once more.

Defined cases: a null or empty text (or null or empty ids) is one sequence holding just ``END``; rows without an id come first, ordered like rows of one id; repeated rows get slots of their own (rows of one id
are ordered by a hash of their tokens); an empty table makes no shards; extra columns are ignored; an id outside the vocabulary
fails the run. Texts are kept whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from keelson.llm.common import bounded_batches, frees_shuffles, id_type, mix64, scratch_table
from keelson.session import delete_folder, scratch_path

LENGTH = 512
SHARD_ROWS = 1 << 16
ROUNDS = 6
END, PAD = 0xFE, 0xFF
BROADCAST_ROWS = 1_000_000
PACK_BYTES = 16 << 20               # text that is packed together by one task
PACK_ROWS = 4096
WRITES = 3
_ZSTD = pa.Codec("zstd", compression_level=3)
_U = np.uint64


def _half_bits(n: int) -> int:
    return max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))


def _feistel(x: np.ndarray, bits: int, key: int, rounds: range) -> np.ndarray:
    mask = _U((1 << bits) - 1)
    left, right = x >> _U(bits), x & mask
    for r in rounds:
        salt = _U((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        if rounds.step > 0:
            left, right = right, left ^ (mix64(right ^ salt) & mask)
        else:
            left, right = right ^ (mix64(left ^ salt) & mask), left
    return (left << _U(bits)) | right


def _walk(x: np.ndarray, n: int, key: int, rounds: range) -> np.ndarray:
    bits = _half_bits(n)
    out = _feistel(x.astype(np.uint64), bits, key, rounds)
    while len(outside := np.flatnonzero(out >= _U(n))):
        out[outside] = _feistel(out[outside], bits, key, rounds)
    return out.astype(np.int64)


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of the numbers x (each in 0..n-1)."""
    return _walk(x, n, key, range(ROUNDS))


def unpermute(slots: np.ndarray, n: int, key: int) -> np.ndarray:
    """Numbers of the slots: the inverse of ``permute``."""
    return _walk(slots, n, key, range(ROUNDS - 1, -1, -1))


@dataclass(frozen=True)
class Layout:
    """All a reader needs."""
    path: str
    sequences: int
    length: int
    shard_rows: int
    vocab_size: int | None = None       # None: bytes

    @property
    def type(self) -> np.dtype:
        return np.dtype(np.uint8) if self.vocab_size is None else id_type(self.vocab_size)

    @property
    def end(self) -> int:
        return END if self.vocab_size is None else self.vocab_size

    @property
    def pad(self) -> int:
        return PAD if self.vocab_size is None else self.vocab_size + 1

    @property
    def stride(self) -> int:
        return (self.length + 1) * self.type.itemsize


def _packed_column(docs: DataFrame, type_: np.dtype) -> DataFrame:
    """doc_id and payload: the arrays of ids in the second column, packed."""
    def run(batches):
        for b in batches:
            rows = []
            for x in b.column(1):
                if x.values is not None and x.values.null_count:
                    raise ValueError("a token array holds a null")
                ids = np.empty(0, np.int64) if x.values is None else x.values.to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() > np.iinfo(type_).max):
                    raise ValueError("a token id is outside the vocabulary")
                rows.append(ids.astype(type_).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["doc_id", "payload"])

    return docs.mapInArrow(run, "doc_id long, payload binary")


def _numbered(docs: DataFrame, length: int) -> tuple[DataFrame, int]:
    """doc_id, mark, n_ids, parts and first number of every document, and the total: sums within ranges of ids, then
    over the ranges (one row per partition)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = docs.select("doc_id", "mark", "n_ids")
    counts = counts.withColumn("parts", F.expr(f"div(n_ids + {length}, {length})"))      # with the end mark, rounded up
    dealt = counts.repartitionByRange(n, "doc_id", "mark").sortWithinPartitions("doc_id", "mark")
    names = ["doc_id", "mark", "n_ids", "parts"]

    def run(batches):
        from pyspark import TaskContext
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            p = b.column(3).to_numpy()
            end = np.cumsum(p) + total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(end - p), pa.array(np.full(len(p), part, np.int32))],
                                             [*names, "at", "range"])
            total = int(end[-1]) if len(end) else total

    rows = scratch_table(dealt.mapInArrow(run, "doc_id long, mark long, n_ids long, parts long, at long, range int"), "order-counts")
    sums = rows.groupBy("range").agg(F.sum("parts").alias("size"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    total = sums.agg(F.sum("size")).first()[0] or 0
    # one row per partition: a bounded broadcast
    out = rows.join(F.broadcast(starts), "range").select(*names, (F.col("at") + F.col("before")).alias("first"))
    return out, int(total)


def materialize(docs: DataFrame, key: int, path: str | None = None, length: int = LENGTH, shard_rows: int = SHARD_ROWS,
                id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None,
                vocab_size: int | None = None) -> tuple[DataFrame, Layout]:
    """Writes the shards under ``path`` (a new folder of the shared scratch space by default). Returns the slot of every
    sequence (doc_id, part, seq, slot, shard, byte_offset, n_tokens) and the layout."""
    if (tokens_col is None) != (vocab_size is None):
        raise ValueError("tokens_col and vocab_size go together")
    spark = docs.sparkSession
    bounded_batches(docs)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tokens_col or text_col).alias("payload"))
    if isinstance(src.schema["payload"].dataType, ArrayType):
        src = _packed_column(src, id_type(vocab_size))
    src = src.withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    width = 1 if vocab_size is None else id_type(vocab_size).itemsize
    src = src.select("doc_id", F.xxhash64("payload").alias("mark"), F.expr(f"div(octet_length(payload), {width})").alias("n_ids"), "payload")
    with frees_shuffles(spark):
        written = None
        if tokens_col is not None:          # encoded once: the ids are read several times
            written = scratch_path(spark, "order-ids")
            src.write.parquet(written, compression="zstd")
            src = spark.read.schema(src.schema).parquet(written)
        numbered, total = _numbered(src, length)
        layout = Layout(path or scratch_path(spark, "shards"), total, length, shard_rows, vocab_size)
        if total:
            _write(src, numbered, layout, key, written)

    def slots(batches):
        for b in batches:
            ids = b.column(0)
            size, parts, first = (b.column(k).to_numpy() for k in (2, 3, 4))
            for lo in range(0, len(ids), 4096):
                sl = slice(lo, lo + 4096)
                n = parts[sl]
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                seq = np.repeat(first[sl], n) + part
                slot = permute(seq, total, key)
                tokens = np.minimum(np.repeat(size[sl] + 1, n) - part * length, length)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(np.arange(lo, lo + len(n)), n))), pa.array(part), pa.array(seq), pa.array(slot), pa.array(slot // shard_rows),
                     pa.array(slot % shard_rows * layout.stride), pa.array(tokens)],
                    ["doc_id", "part", "seq", "slot", "shard", "byte_offset", "n_tokens"])

    return numbered.mapInArrow(slots, "doc_id long, part long, seq long, slot long, shard long, byte_offset long, n_tokens long"), layout


def _write(src: DataFrame, numbered: DataFrame, layout: Layout, key: int, written: str | None) -> None:
    """The shards. ``written``: where ``src`` is stored, if nothing else needs it."""
    length, total, shard_rows = layout.length, layout.sequences, layout.shard_rows
    spark = src.sparkSession
    first = numbered.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list("first")).alias("firsts"))
    small = first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if small:
        first = F.broadcast(first)
    # rows of one id and text have one entry with several numbers: the first row to come writes all of them
    dealt = src.join(first, src["doc_id"].eqNullSafe(first["doc_id"]) & (src["mark"] == first["mark"])).select("payload", "firsts")
    # rows that repeat (same id and text) carry the same list of numbers; each number is written once
    repeated = not numbered.groupBy("doc_id", "mark").count().where("count > 1").isEmpty()
    if repeated:
        dealt = dealt.dropDuplicates(["firsts"])
    if repeated or not small:           # every job that writes shards would shuffle the ids for this again
        dealt = scratch_table(dealt, "order-rows", "zstd")
        if written is not None:
            delete_folder(spark, written)
    type_, vocab_size, record = layout.type, layout.vocab_size, length * layout.type.itemsize
    end, pad = (np.array([x], type_).tobytes() for x in (layout.end, layout.pad))

    def cut(batches, shards):
        for b in batches:
            seq, payload = [], []
            held = 0
            for t, firsts in zip(b.column(0), b.column(1)):
                raw = t.as_py()
                if vocab_size is not None and len(raw):
                    ids = np.frombuffer(raw, type_)
                    if ids.min() < 0 or ids.max() >= vocab_size:
                        raise ValueError("a token id is outside the vocabulary")
                raw += end
                pieces = [raw[i:i + record] for i in range(0, len(raw), record)]
                pieces[-1] += pad * ((record - len(pieces[-1])) // len(pad))
                for f in firsts.as_py():
                    seq.append((f, len(pieces)))
                    payload += pieces
                    held += len(raw)
                if held > PACK_BYTES:
                    yield _packed(seq, payload, total, key, shard_rows, shards)
                    seq, payload, held = [], [], 0
            if seq:
                yield _packed(seq, payload, total, key, shard_rows, shards)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(max(int(before), PACK_ROWS)))
    try:
        n = -(-total // shard_rows)
        bounds = [n * k // WRITES for k in range(WRITES + 1)]
        done = False
        for shards in (range(a, b) for a, b in zip(bounds, bounds[1:]) if a < b):
            packs = dealt.mapInArrow(lambda batches, shards=shards: cut(batches, shards), "shard long, slots binary, payload binary")
            parts = min(len(shards), int(spark.conf.get("spark.sql.shuffle.partitions")))
            # ranges of shards of equal length: known beforehand, so nothing is sampled
            part = F.expr(f"cast(div((shard - {shards.start}) * {parts}, {len(shards)}) as int)")
            rows = packs.repartitionById(parts, part).mapInArrow(_unpacked(record), "shard long, slot long, payload binary")
            ordered = rows.sortWithinPartitions("shard", "slot")
            ordered = ordered.select("shard", F.col("payload").cast("string").alias("value"))
            ordered.write.mode("append" if done else "errorifexists").partitionBy("shard").text(layout.path, lineSep="\n" * type_.itemsize)
            done = True
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _packed(seq: list[tuple[int, int]], payload: list[bytes], total: int, key: int, shard_rows: int, shards: range) -> pa.RecordBatch:
    """Those sequences of one task that go to ``shards``, packed by shard, compressed together: what moves is far smaller than the sequences."""
    first, n = np.array(seq, np.int64).T
    s = permute(np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()), total, key)
    order = np.argsort(s, kind="stable")
    order = order[slice(*np.searchsorted(s[order], [shards.start * shard_rows, shards.stop * shard_rows]))]
    shard = s[order] // shard_rows
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[:len(shard)])
    ends = np.append(cut[1:], len(shard))
    # within a shard the text order compresses better than the slot order
    groups = [np.sort(order[a:b]) for a, b in zip(cut, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[cut]), pa.array([s[g].tobytes() for g in groups], pa.binary()),
         pa.array([_ZSTD.compress(b"".join([payload[i] for i in g.tolist()]), asbytes=True) for g in groups], pa.binary())],
        ["shard", "slots", "payload"])


def _unpack(payload: bytes, size: int) -> bytes:
    return _ZSTD.decompress(payload, size, asbytes=True)


def _unpacked(record: int):
    def run(batches):
        for b in batches:
            for shard, slots, payload in zip(*(c.to_pylist() for c in b.columns)):
                slot = np.frombuffer(slots, np.int64)
                raw = _unpack(payload, len(slot) * record)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), shard)), pa.array(slot),
                     pa.array([raw[i:i + record] for i in range(0, len(raw), record)], pa.binary())], ["shard", "slot", "payload"])
    return run


def read_slots(spark: SparkSession, layout: Layout, start: int = 0, stop: int | None = None) -> Iterator[bytes | np.ndarray]:
    """Token ids of the slots from ``start`` on (an array each; bytes for byte-level ids), one shard at a time and in order, without
    padding. The files are opened
    through Spark's file system layer; each read begins at its byte, so a job resumes where it stopped."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    stop = layout.sequences if stop is None else min(stop, layout.sequences)
    slot = start
    while slot < stop:
        shard = slot // layout.shard_rows
        folder = jvm.org.apache.hadoop.fs.Path(f"{layout.path}/shard={shard}")
        fs = folder.getFileSystem(conf)
        status = [s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
        stream = fs.open(status[0].getPath())
        try:
            end = min(stop, (shard + 1) * layout.shard_rows)
            stream.seek((slot - shard * layout.shard_rows) * layout.stride)
            while slot < end:
                n = min(end - slot, 1024)
                raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(
                    jvm.org.apache.commons.io.input.BoundedInputStream(stream, n * layout.stride)))
                ids = np.frombuffer(raw, layout.type).reshape(n, layout.length + 1)[:, :-1]
                for row, size in zip(ids, (ids != layout.pad).sum(axis=1).tolist()):
                    yield row[:size].tobytes() if layout.vocab_size is None else row[:size]
                slot += n
        finally:
            stream.close()

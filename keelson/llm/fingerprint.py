"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every window of four bytes adds three hashed triplets (bytes 1-2-3, 1-2-4 and 1-3-4) to ``BUCKETS`` counters. The
digest holds one byte for the length (a logarithmic code), one for the ratios of the count quartiles and two bits per
bucket: between which quartiles its count lies. Two digests differ by at most ``MAX_DIFF``; ``likeness`` is one minus
the difference over that bound.

``fingerprints`` needs only a projection. ``neighbour_fingerprints`` also compares each document with an edited copy
of itself that borrows from the next document in id order: documents are range-partitioned and sorted by id, each task
streams its range with a look-ahead of one row, and only the first and last row of each range (one pair per
partition, whatever the data) are matched up in a second small step.

Defined cases: a null text counts as empty; texts under four bytes have no triplets, so they differ in length only;
equal texts have equal digests. Rows with one id are ordered by text; the last row's next one is the first, so a
single row is its own neighbour; an empty table gives no rows. Extra input columns are ignored. A text of any length
is counted in slices.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import bounded_batches, CHUNK_BYTES, scratch_table, string_array, text_chunks

BUCKETS = 256
_BITS = 8
_WEIGHT = np.array([0, 1, 2, 6], np.int64)          # cost of codes that lie this far apart
LENGTH_CAP = 32
MAX_DIFF = 6 * BUCKETS + LENGTH_CAP + 2 * 7
DIGEST_BYTES = 2 + BUCKETS // 4
_SALTS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _count(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Triplet counts per row and bucket. A long row is counted slice by slice."""
    rows = len(offsets) - 1
    total = np.zeros((rows, BUCKETS), np.int64)
    if len(buf) > 4 * CHUNK_BYTES and rows == 1:
        for a in range(0, len(buf) - 3, CHUNK_BYTES):
            part = buf[a:a + CHUNK_BYTES + 3]
            total += _count(part, np.array([0, len(part)]))
        return total
    n = len(buf) - 3
    if n <= 0:
        return total
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))[:n]
    inside = np.ones(len(buf) + 3, bool)
    for back in (1, 2, 3):                          # windows that would leave their row
        inside[np.maximum(offsets[1:] - back, 0)] = False
    # rows shorter than three bytes are marked through their neighbours: keep only windows that end in their row
    keep = inside[:n] & (np.arange(n) + 4 <= offsets[1:][row])
    b = [buf[k:n + k].astype(np.uint32) for k in range(4)]
    base = (row.astype(np.int64) * BUCKETS)[keep]
    for salt, (i, j, k) in zip(_SALTS, ((0, 1, 2), (0, 1, 3), (0, 2, 3))):
        h = ((b[i] | (b[j] << np.uint32(8)) | (b[k] << np.uint32(16))) + salt) * np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x297A2D39)
        total += np.bincount(base + (h >> np.uint32(32 - _BITS))[keep], minlength=rows * BUCKETS).reshape(rows, -1)
    return total


def digests(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One digest (uint8 row) per text of the buffer."""
    counts = _count(buf, offsets)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1][:, None] for k in (1, 2, 3))
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = code[:, 0::4] | (code[:, 1::4] << 2) | (code[:, 2::4] << 4) | (code[:, 3::4] << 6)
    size = np.diff(offsets)
    length = np.minimum(np.rint(8 * np.log2(size + 1.0)), 255).astype(np.uint8)
    top = np.maximum(q3, 1)
    ratios = ((q1 * 15 // top) * 16 + q2 * 15 // top).astype(np.uint8)
    return np.concatenate([length[:, None], ratios, body.astype(np.uint8)], axis=1)


def _codes(d: np.ndarray) -> np.ndarray:
    body = d[:, 2:]
    return np.stack([(body >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(d), -1).astype(np.int64)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounded difference of digests, row by row: 0 .. MAX_DIFF."""
    body = _WEIGHT[np.abs(_codes(a) - _codes(b))].sum(axis=1)
    length = np.minimum(np.abs(a[:, 0].astype(np.int64) - b[:, 0]), LENGTH_CAP)

    def wheel(x, y):                                # ratios are compared around a wheel of 16
        d = np.abs(x.astype(np.int64) - y)
        return np.minimum(np.minimum(d, 16 - d), 7)

    ratio = wheel(a[:, 1] >> 4, b[:, 1] >> 4) + wheel(a[:, 1] & 15, b[:, 1] & 15)
    return body + length + ratio


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - difference(a, b) / MAX_DIFF


def text_digests(texts: list[bytes]) -> np.ndarray:
    out = []
    arr = pa.array(texts, pa.large_binary())
    for _, buf, off in text_chunks(arr):
        out.append(digests(buf, off))
    return np.concatenate(out) if out else np.zeros((0, DIGEST_BYTES), np.uint8)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (binary) of every document. Map-only."""
    src = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            for first, buf, off in text_chunks(string_array(b, "text")):
                d = digests(buf, off)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(d)), pa.array([x.tobytes() for x in d], pa.binary())],
                    ["doc_id", "fingerprint"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fingerprint binary")


def edited_copy(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by as many (or all) of the following text's first."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def _compare(ids: list, texts: list[str], following: list[str], fp: np.ndarray, fp_next: np.ndarray) -> dict[str, list]:
    edited = [edited_copy(t, n).encode() for t, n in zip(texts, following)]
    efp = text_digests(edited)
    return {"doc_id": ids, "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(e).digest() for e in edited],
            "fingerprint": [x.tobytes() for x in fp], "edited_fingerprint": [x.tobytes() for x in efp],
            "near_edited": likeness(fp, efp).tolist(), "near_next": likeness(fp, fp_next).tolist()}


_FIELDS = (("n_chars", "long"), ("edited_sha256", "binary"), ("fingerprint", "binary"),
           ("edited_fingerprint", "binary"), ("near_edited", "double"), ("near_next", "double"))
_ARROW = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and its edited copy, with the likenesses to that copy and to the next document."""
    src = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = src.schema["doc_id"].dataType
    parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = src.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    fields = ", ".join(f"{n} {t}" for n, t in _FIELDS)

    def stream(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        id_arrow = None

        def table(cols: dict, edge: str | None, text: list | None) -> pa.RecordBatch:
            n = len(cols["doc_id"])
            arrays = [pa.array(cols["doc_id"], id_arrow)]
            arrays += [pa.array(cols.get(f, [None] * n), _ARROW[t]) for f, t in _FIELDS]
            arrays += [pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()),
                       pa.array(text or [None] * n, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", *[f for f, _ in _FIELDS], "part", "edge", "text"])

        held = None                                  # the last row seen: (id, text, digest)
        for b in batches:
            id_arrow = b.schema.field(0).type
            ids, arr = b.column(0).to_pylist(), string_array(b, "text")
            for first, buf, off in text_chunks(arr):
                fp = digests(buf, off)
                n = len(fp)
                texts = arr.slice(first, n).to_pylist()
                here = ids[first:first + n]
                if held is None:
                    yield table({"doc_id": here[:1]}, "head", texts[:1])
                    held_ids, held_texts, held_fp = here, texts, fp
                else:
                    held_ids, held_texts = [held[0], *here], [held[1], *texts]
                    held_fp = np.concatenate([held[2][None, :], fp])
                if len(held_ids) > 1:
                    yield table(_compare(held_ids[:-1], held_texts[:-1], held_texts[1:], held_fp[:-1], held_fp[1:]),
                                None, None)
                held = (held_ids[-1], held_texts[-1], held_fp[-1])
        if held is not None:
            yield table({"doc_id": [held[0]]}, "tail", [held[1]])

    ddl = f"doc_id {id_type.simpleString()}, {fields}, part int, edge string, text string"
    rows = scratch_table(dealt.mapInArrow(stream, ddl), "fingerprints")

    # one head and one tail per non-empty range; ranges are few, their number is a setting
    heads = rows.where("edge = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    order = heads.select(F.col("next_part").alias("part"))
    w = Window.orderBy("part")
    order = order.select("part", F.coalesce(F.lead("part").over(w), F.first("part").over(w)).alias("next_part"))
    tails = (rows.where("edge = 'tail'").select("doc_id", "part", "text").join(order, "part")
             .join(heads, "next_part").select("doc_id", "text", "following"))

    def finish(batches):
        for b in batches:
            texts, nxt = (string_array(b, c).to_pylist() for c in ("text", "following"))
            if texts:
                cols = _compare(b.column(0).to_pylist(), texts, nxt, text_digests([t.encode() for t in texts]),
                                text_digests([t.encode() for t in nxt]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *[pa.array(cols[f], _ARROW[t]) for f, t in _FIELDS]], ["doc_id", *[f for f, _ in _FIELDS]])

    last = tails.mapInArrow(finish, f"doc_id {id_type.simpleString()}, {fields}")
    return rows.where("edge IS NULL").select("doc_id", *[f for f, _ in _FIELDS]).unionByName(last)


def digest_text(rows: DataFrame) -> DataFrame:
    """Binary digests as lowercase hex."""
    hexed = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return rows.withColumns(hexed)

"""Event wire codec (I5): proto3 binary encoding of the event message.

Where the session has Spark's protobuf package, ``encode_events`` and ``decode_events`` use it (``sources.protobuf``). Otherwise the public proto3
wire format is coded here.  Decoding is vectorized over Arrow
batches (``decode_arrow``: numpy over the binary buffers, one field step at a
time for all rows); ``decode_one`` is the per-row reference it is fuzz-tested
against.  Encoding is vectorized the same way (``encode_arrow`` against
``encode_one``).

Decoding follows proto3 parsing: fields may come in any order, the last value
wins, unknown fields are skipped by wire type, absent fields take their
defaults ("" / 0 / empty bytes).  Malformed input (truncated varint or length,
bad UTF-8 in a string field, group wire types) gives ``decode_ok = false`` and
NULL fields - a reject row the pipeline counts, never a half-filled event.
Encoding omits default values, as proto3 serializers do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.schema import EVENT
from keelson.sources import protobuf

# field numbers of the event message (fixed values of the format)
_STRING_FIELDS = {1: "event_id", 2: "user_id", 3: "platform", 4: "event_type"}
_TS_FIELD = 5
_PAYLOAD_FIELD = 6

DECODED = T.StructType([T.StructField(f.name, f.dataType, True) for f in EVENT.fields]
                       + [T.StructField("decode_ok", T.BooleanType(), False)])


class Malformed(Exception):
    pass


def _varint(value: int) -> bytes:
    value &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while True:
        b = value & 0x7F
        value >>= 7
        if value:
            out.append(b | 0x80)
        else:
            out.append(b)
            return bytes(out)


def _read_varint(buf: bytes, pos: int) -> tuple[int, int]:
    result = shift = 0
    for i in range(10):
        if pos >= len(buf):
            raise Malformed("truncated varint")
        b = buf[pos]
        pos += 1
        result |= (b & 0x7F) << shift
        if not b & 0x80:
            return result & 0xFFFFFFFFFFFFFFFF, pos
        shift += 7
    raise Malformed("varint too long")


def encode_one(event_id: str, user_id: str, platform: str, event_type: str, ts: int,
               payload: bytes) -> bytes:
    out = bytearray()
    for num, val in ((1, event_id), (2, user_id), (3, platform), (4, event_type)):
        if val:
            data = val.encode("utf-8")
            out += _varint((num << 3) | 2) + _varint(len(data)) + data
    if ts:
        out += _varint((_TS_FIELD << 3) | 0) + _varint(ts)
    if payload:
        out += _varint((_PAYLOAD_FIELD << 3) | 2) + _varint(len(payload)) + bytes(payload)
    return bytes(out)


def decode_one(buf: bytes) -> dict:
    ev = {"event_id": "", "user_id": "", "platform": "", "event_type": "", "ts": 0, "payload": b""}
    pos, n = 0, len(buf)
    while pos < n:
        key, pos = _read_varint(buf, pos)
        num, wt = key >> 3, key & 7
        if num == 0:
            raise Malformed("field number 0")
        if wt == 0:
            val, pos = _read_varint(buf, pos)
            if num == _TS_FIELD:
                ev["ts"] = val - (1 << 64) if val >= (1 << 63) else val
        elif wt == 2:
            ln, pos = _read_varint(buf, pos)
            if pos + ln > n:
                raise Malformed("truncated field")
            data = buf[pos:pos + ln]
            pos += ln
            if num in _STRING_FIELDS:
                try:
                    ev[_STRING_FIELDS[num]] = data.decode("utf-8")
                except UnicodeDecodeError as e:
                    raise Malformed("invalid utf-8") from e
            elif num == _PAYLOAD_FIELD:
                ev["payload"] = bytes(data)
        elif wt == 1:
            if pos + 8 > n:
                raise Malformed("truncated fixed64")
            pos += 8
        elif wt == 5:
            if pos + 4 > n:
                raise Malformed("truncated fixed32")
            pos += 4
        else:
            raise Malformed("unsupported wire type")
    return ev


@F.pandas_udf(T.BinaryType())
def _encode_udf(event_id: pd.Series, user_id: pd.Series, platform: pd.Series, event_type: pd.Series,
                ts: pd.Series, payload: pd.Series) -> pd.Series:
    return pd.Series([encode_one(a or "", b or "", c or "", d or "", int(e or 0), f or b"")
                      for a, b, c, d, e, f in zip(event_id, user_id, platform, event_type, ts, payload)])


@F.pandas_udf(DECODED)
def _decode_udf(wire: pd.Series) -> pd.DataFrame:
    rows = []
    for buf in wire:
        try:
            ev = decode_one(bytes(buf) if buf is not None else b"")
            ev["decode_ok"] = buf is not None
        except Malformed:
            ev = {"event_id": None, "user_id": None, "platform": None, "event_type": None,
                  "ts": None, "payload": None, "decode_ok": False}
        rows.append(ev)
    out = pd.DataFrame(rows, columns=[f.name for f in DECODED.fields])
    out["ts"] = out["ts"].astype("Int64")
    return out


def encode_expr(prefix: str = "", vectorized: bool = True) -> Column:
    c = lambda n: F.col(prefix + n)
    udf = _encode_arrow_udf if vectorized else _encode_udf
    return udf(c("event_id"), c("user_id"), c("platform"), c("event_type"), c("ts"), c("payload"))


def encode_events(df: DataFrame, out_col: str = "wire", keep: tuple[str, ...] = ()) -> DataFrame:
    """Event columns -> one BINARY column of wire bytes."""
    if protobuf.connector_present(df.sparkSession):
        return df.select(*keep, protobuf.encode_column().alias(out_col))
    return df.select(*keep, encode_expr().alias(out_col))


def decode_events(df: DataFrame, wire_col: str = "wire", keep: tuple[str, ...] = (),
                  vectorized: bool = True) -> DataFrame:
    """Wire bytes -> event columns + ``decode_ok``, by Spark's protobuf functions where the session has them.

    Without them, ``vectorized`` (default) decodes whole Arrow batches with numpy, one field
    step at a time for all rows (105,000 messages: 0.14 s against 0.85 s for the
    per-row decoder, single core); ``False`` uses the per-row reference decoder.
    """
    if vectorized and protobuf.connector_present(df.sparkSession):
        return protobuf.decode_events(df, wire_col, keep)
    udf = _decode_arrow_udf if vectorized else _decode_udf
    return df.select(*keep, udf(F.col(wire_col)).alias("_ev")).select(*keep, "_ev.*")


def encode_batch_one(events: list[bytes]) -> bytes:
    """EventBatch: repeated Event events = 1."""
    out = bytearray()
    for e in events:
        out += _varint((1 << 3) | 2) + _varint(len(e)) + e
    return bytes(out)


# --------------------------------------------------------------------------- vectorized decoder
_FIELD_SLOTS = {1: 0, 2: 1, 3: 2, 4: 3, 6: 4}       # length-delimited fields -> slot (event_id .. payload)


def _read_varints(data: np.ndarray, pos: np.ndarray, end: np.ndarray, rows: np.ndarray):
    """Varints at ``pos[rows]``; returns (values, new_pos, bad) for those rows."""
    val = np.zeros(len(rows), dtype=np.uint64)
    p = pos[rows].copy()
    e = end[rows]
    cont = np.ones(len(rows), dtype=bool)
    bad = np.zeros(len(rows), dtype=bool)
    for i in range(10):
        need = cont & ~bad
        if not need.any():
            break
        short = need & (p >= e)
        bad |= short
        take = need & ~short
        b = data[p[take]].astype(np.uint64)
        val[take] |= (b & np.uint64(0x7F)) << np.uint64(7 * i)
        p[take] += 1
        cont[take] = (b & np.uint64(0x80)) != 0
    bad |= cont & ~bad                                   # more than 10 bytes
    return val, p, bad


def decode_arrow(wire: pa.Array) -> pa.StructArray:
    """Decode a whole Arrow batch of wire messages at once (same rules as ``decode_one``)."""
    if isinstance(wire, pa.ChunkedArray):
        wire = wire.combine_chunks()
    if not pa.types.is_large_binary(wire.type):
        wire = wire.cast(pa.large_binary())
    n = len(wire)
    bufs = wire.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[wire.offset:wire.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    pos, end = offs[:-1].copy(), offs[1:].copy()
    null_in = np.asarray(wire.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    bad = null_in.copy()
    starts = np.zeros((5, n), dtype=np.int64)
    lens = np.zeros((5, n), dtype=np.int64)
    ts = np.zeros(n, dtype=np.uint64)
    given = np.zeros((5, n), dtype=bool)
    active = np.nonzero(~bad & (pos < end))[0]
    while len(active):
        key, p, kbad = _read_varints(data, pos, end, active)
        num, wt = (key >> np.uint64(3)).astype(np.int64), (key & np.uint64(7)).astype(np.int64)
        kbad |= num == 0
        pos[active] = p
        # varint fields
        m = ~kbad & (wt == 0)
        if m.any():
            r = active[m]
            v, p2, vbad = _read_varints(data, pos, end, r)
            pos[r] = p2
            is_ts = (num[m] == _TS_FIELD) & ~vbad
            ts[r[is_ts]] = v[is_ts]
            kbad[np.nonzero(m)[0][vbad]] = True
        # length-delimited fields
        m = ~kbad & (wt == 2)
        if m.any():
            r = active[m]
            ln, p2, lbad = _read_varints(data, pos, end, r)
            # compare unsigned and before adding: a length near 2^63 must not wrap
            over = lbad | (ln > np.maximum(end[r] - p2, 0).astype(np.uint64))
            okr = ~over
            ln = np.where(over, 0, ln).astype(np.int64)
            for fnum, slot in _FIELD_SLOTS.items():
                sel = okr & (num[m] == fnum)
                # every occurrence of a string must be valid UTF-8, not only the last one, which is checked below
                again = sel & given[slot, r]
                if slot < 4 and again.any():
                    for k in np.nonzero(again)[0]:
                        i = r[k]
                        try:
                            data[starts[slot, i]:starts[slot, i] + lens[slot, i]].tobytes().decode("utf-8")
                        except UnicodeDecodeError:
                            kbad[np.nonzero(m)[0][k]] = True
                given[slot, r[sel]] = True
                starts[slot, r[sel]] = p2[sel]
                lens[slot, r[sel]] = ln[sel]
            pos[r[okr]] = p2[okr] + ln[okr]
            kbad[np.nonzero(m)[0][over]] = True
        # fixed-width fields
        for wtype, width in ((1, 8), (5, 4)):
            m = ~kbad & (wt == wtype)
            if m.any():
                r = active[m]
                over = pos[r] + width > end[r]
                pos[r[~over]] += width
                kbad[np.nonzero(m)[0][over]] = True
        kbad |= ~np.isin(wt, (0, 1, 2, 5))
        bad[active[kbad]] = True
        active = active[~kbad]
        active = active[pos[active] < end[active]]

    def column(slot: int, as_text: bool) -> pa.Array:
        ln = np.where(bad, 0, lens[slot])
        out_offs = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(ln, out=out_offs[1:])
        total = int(out_offs[-1])
        gather = np.repeat(starts[slot] - out_offs[:-1], ln) + np.arange(total, dtype=np.int64)
        body = data[gather] if total else np.zeros(0, np.uint8)
        arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(out_offs),
                                                                      pa.py_buffer(body.tobytes())])
        if as_text:
            try:
                arr = arr.cast(pa.large_string())
            except pa.ArrowInvalid:                      # rare: find the rows with bad UTF-8
                vals = []
                for i, v in enumerate(arr.to_pylist()):
                    try:
                        vals.append(v.decode("utf-8"))
                    except UnicodeDecodeError:
                        bad[i] = True
                        vals.append("")
                arr = pa.array(vals, pa.large_string())
        return arr

    cols = [column(0, True), column(1, True), column(2, True), column(3, True)]
    payload = column(4, False)
    mask = pa.array(bad)
    fields = [pc.if_else(mask, pa.scalar(None, a.type), a) for a in cols]
    ts_arr = pc.if_else(mask, pa.scalar(None, pa.int64()), pa.array(ts.view(np.int64)))
    payload = pc.if_else(mask, pa.scalar(None, payload.type), payload)
    names = ["event_id", "user_id", "platform", "event_type", "ts", "payload", "decode_ok"]
    arrays = [a.cast(pa.string()) for a in fields] + [ts_arr, payload.cast(pa.binary()), pa.array(~bad)]
    return pa.StructArray.from_arrays(arrays, names=names)


@F.arrow_udf(DECODED)
def _decode_arrow_udf(wire: pa.Array) -> pa.Array:
    return decode_arrow(wire)


# --------------------------------------------------------------------------- vectorized encoder
def _varint_len(v: np.ndarray) -> np.ndarray:
    """Bytes needed for each unsigned 64-bit value as a varint (1..10)."""
    n = np.ones(len(v), dtype=np.int64)
    x = v.copy()
    for _ in range(9):
        x = x >> np.uint64(7)
        n += (x > 0)
    return n


def _write_varints(out: np.ndarray, pos: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Write varints at ``pos`` (vectorized); returns the positions after them."""
    p = pos.copy()
    x = v.copy()
    active = np.ones(len(v), dtype=bool)
    while active.any():
        low = (x[active] & np.uint64(0x7F)).astype(np.uint8)
        nxt = x[active] >> np.uint64(7)
        more = nxt > 0
        out[p[active]] = low | (more.astype(np.uint8) << 7)
        p[active] += 1
        x[active] = nxt
        idx = np.nonzero(active)[0]
        active[idx[~more]] = False
    return p


def _slices(arr: pa.Array):
    """(offsets start, lengths, data) of a binary/string array as numpy views."""
    arr = arr.cast(pa.large_binary()) if not pa.types.is_large_binary(arr.type) else arr
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lens = np.diff(offs)
    if arr.null_count:
        lens = np.where(np.asarray(arr.is_null().to_numpy(zero_copy_only=False), dtype=bool), 0, lens)
    return offs[:-1], lens, data


def encode_arrow(event_id: pa.Array, user_id: pa.Array, platform: pa.Array, event_type: pa.Array,
                 ts: pa.Array, payload: pa.Array) -> pa.Array:
    """Encode a whole Arrow batch (same bytes as ``encode_one``; defaults omitted)."""
    n = len(event_id)
    parts = []                                              # (tag, starts, lens, data) per length-delimited field
    for num, col in ((1, event_id), (2, user_id), (3, platform), (4, event_type)):
        parts.append((num, *_slices(pa.compute.cast(col, pa.large_string()).cast(pa.large_binary()))))
    ts_v = np.asarray(pc.fill_null(ts, 0).to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)
    pay = _slices(payload)
    size = np.zeros(n, dtype=np.int64)
    for _, _, ln, _ in parts:
        size += np.where(ln > 0, 1 + _varint_len(ln.astype(np.uint64)) + ln, 0)
    size += np.where(ts_v != 0, 1 + _varint_len(ts_v), 0)
    size += np.where(pay[1] > 0, 1 + _varint_len(pay[1].astype(np.uint64)) + pay[1], 0)
    offs = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(size, out=offs[1:])
    out = np.zeros(int(offs[-1]), dtype=np.uint8)
    pos = offs[:-1].copy()

    def put_bytes(tag: int, starts, lens, data):
        has = np.nonzero(lens > 0)[0]
        if not len(has):
            return
        out[pos[has]] = tag
        p = _write_varints(out, pos[has] + 1, lens[has].astype(np.uint64))
        total = int(lens[has].sum())
        csum = np.concatenate([[0], np.cumsum(lens[has])[:-1]])
        src = np.repeat(starts[has] - csum, lens[has]) + np.arange(total, dtype=np.int64)
        dst = np.repeat(p - csum, lens[has]) + np.arange(total, dtype=np.int64)
        out[dst] = data[src]
        pos[has] = p + lens[has]

    for num, starts, lens, data in parts:
        put_bytes((num << 3) | 2, starts, lens, data)
    has_ts = np.nonzero(ts_v != 0)[0]
    if len(has_ts):
        out[pos[has_ts]] = (_TS_FIELD << 3) | 0
        pos[has_ts] = _write_varints(out, pos[has_ts] + 1, ts_v[has_ts])
    put_bytes((_PAYLOAD_FIELD << 3) | 2, *pay)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offs),
                                                                  pa.py_buffer(out.tobytes())]).cast(pa.binary())


@F.arrow_udf(T.BinaryType())
def _encode_arrow_udf(event_id: pa.Array, user_id: pa.Array, platform: pa.Array, event_type: pa.Array,
                      ts: pa.Array, payload: pa.Array) -> pa.Array:
    return encode_arrow(event_id, user_id, platform, event_type, ts, payload)

import random

from pyspark.sql import functions as F

from keelson.sources.codec import decode_events, decode_one, encode_events, encode_one, Malformed
from keelson.sources.ingest import admit_batch_arrays, admit_events, batch_acks, filter_compatible
import pytest

EV = "event_id string, user_id string, platform string, event_type string, ts bigint, payload binary"


def test_payload_size_boundary(spark):
    df = spark.createDataFrame([(1, b"x" * 65536), (2, b"x" * 65537)], "id int, payload binary")
    got = {r.id: (r.admitted, r.message) for r in admit_events(df).collect()}
    assert got == {1: (True, "ok"), 2: (False, "payload too large (>64KB)")}


def test_batch_boundaries_flat(spark):
    rows = [("b1000", i, 10) for i in range(1000)] + [("b1001", i, 10) for i in range(1001)] \
        + [("mixed", 0, 70000), ("mixed", 1, 5)]
    acks = {r.batch_id: r for r in batch_acks(spark.createDataFrame(rows, "batch_id string, seq int, payload_size int")).collect()}
    assert acks["b1000"].success and acks["b1000"].message == "batch:1000"
    assert not acks["b1001"].success and acks["b1001"].message == "batch too large (>1000 events)"
    assert acks["mixed"].message == "batch:1"


def test_batch_arrays_empty_and_oversize(spark):
    ev = ("e", "u", "web", "click", 1, b"x")
    big = ("e2", "u", "web", "click", 1, b"x" * 70000)
    df = spark.createDataFrame([(1, []), (2, [ev, big]), (3, [ev] * 1001)],
                               f"id int, events array<struct<{EV.replace(' string', ':string').replace(' bigint', ':bigint').replace(' binary', ':binary')}>>")
    got = {r.id: (r.success, r.message) for r in admit_batch_arrays(df).collect()}
    assert got == {1: (True, "batch:0"), 2: (True, "batch:1"), 3: (False, "batch too large (>1000 events)")}


def test_versions(spark):
    df = spark.createDataFrame([(v,) for v in range(6)], "schema_version int")
    assert sorted(r.schema_version for r in filter_compatible(df).collect()) == [1, 2, 3]
    assert sorted(r.schema_version for r in filter_compatible(df, rejects=True).collect()) == [0, 4, 5]
    table = spark.createDataFrame([(1, True), (2, True), (3, True)], "version int, compatible boolean")
    assert sorted(r.schema_version for r in filter_compatible(df, versions=table).collect()) == [1, 2, 3]


def test_codec_roundtrip_and_rejects(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        rows.append((f"e{i}", f"u{rnd.randrange(9)}", rnd.choice(["ios", "", "web"]), "click",
                     rnd.choice([0, 1, -5, 2**62, -(2**63)]), bytes(rnd.randrange(256) for _ in range(rnd.randrange(40)))))
    df = spark.createDataFrame(rows, EV)
    back = decode_events(encode_events(df, keep=("event_id",)).withColumnRenamed("event_id", "k"), keep=("k",))
    got = {r.k: (r.event_id, r.user_id, r.platform, r.event_type, r.ts, bytes(r.payload), r.decode_ok)
           for r in back.collect()}
    for r in rows:
        assert got[r[0]] == tuple(r) + (True,)


def test_decode_rules():
    good = encode_one("e1", "u1", "web", "click", 5, b"pay")
    assert decode_one(good)["event_id"] == "e1"
    # unknown field 9 (varint) is skipped; last value wins
    extra = good + bytes([9 << 3 | 0, 1]) + bytes([1 << 3 | 2, 2]) + b"e2"
    d = decode_one(extra)
    assert d["event_id"] == "e2" and d["payload"] == b"pay"
    with pytest.raises(Malformed):
        decode_one(good[:-1])
    with pytest.raises(Malformed):
        decode_one(bytes([1 << 3 | 2, 2, 0xff, 0xfe]))
    assert decode_one(b"") == {"event_id": "", "user_id": "", "platform": "", "event_type": "", "ts": 0,
                               "payload": b""}


def test_vectorized_decoder_fuzz_equals_reference():
    import pyarrow as pa
    from keelson.sources.codec import _varint, decode_arrow
    rnd = random.Random(3)
    msgs = []
    for i in range(3000):
        ev = (f"e{i}", rnd.choice(["", "u1", "é日"]), rnd.choice(["ios", ""]), "click",
              rnd.choice([0, 5, -1, 2**63 - 1, -(2**63)]), bytes(rnd.randrange(256) for _ in range(rnd.randrange(50))))
        b = encode_one(*ev)
        k = rnd.random()
        if k < 0.15:
            b = b[:rnd.randrange(0, len(b) + 1)]                      # truncated
        elif k < 0.25:
            b = bytes(rnd.randrange(256) for _ in range(rnd.randrange(20)))   # garbage
        elif k < 0.35:
            b += _varint((9 << 3) | rnd.choice([0, 1, 2, 5])) + bytes(rnd.randrange(256) for _ in range(rnd.randrange(10)))
        elif k < 0.45:
            b += _varint((1 << 3) | 2) + _varint(2) + b"zz"             # repeated field: last wins
        elif k < 0.5:
            b += _varint((2 << 3) | 2) + _varint(2) + b"\xff\xfe"       # bad UTF-8
        msgs.append(b)
    msgs.append(None)
    got = decode_arrow(pa.array(msgs, pa.binary())).to_pylist()
    for m, g in zip(msgs, got):
        try:
            exp = None if m is None else dict(decode_one(m), decode_ok=True)
        except Malformed:
            exp = None
        if exp is None:
            assert g["decode_ok"] is False and g["event_id"] is None and g["payload"] is None
        else:
            assert g == exp


def test_vectorized_encoder_equals_reference():
    import pyarrow as pa
    from keelson.sources.codec import encode_arrow
    rnd = random.Random(8)
    rows = [(rnd.choice([f"e{i}", "", "é日本" * rnd.randrange(60)]), rnd.choice(["u1", ""]), rnd.choice(["ios", "", None]),
             "click", rnd.choice([0, 1, -1, 127, 128, 2**63 - 1, -(2**63), None]),
             rnd.choice([b"", None, bytes(rnd.randrange(256) for _ in range(rnd.randrange(300)))])) for i in range(3000)]
    cols = list(zip(*rows))
    types = [pa.string()] * 4 + [pa.int64(), pa.binary()]
    got = encode_arrow(*[pa.array(c, t) for c, t in zip(cols, types)]).to_pylist()
    exp = [encode_one(a or "", b or "", c or "", d or "", int(e or 0), f or b"") for a, b, c, d, e, f in rows]
    assert got == exp


def test_descriptor_and_codec_agree_with_a_protobuf_library():
    """The hand-written descriptor compiles, and messages of a class made from it equal the codec's, byte by byte."""
    import random

    import pytest
    pb = pytest.importorskip("google.protobuf.descriptor_pb2")
    from google.protobuf import descriptor_pool, message_factory
    from keelson.sources.codec import decode_arrow, encode_one
    from keelson.sources.protobuf import event_descriptor
    import pyarrow as pa
    files = pb.FileDescriptorSet.FromString(event_descriptor())
    assert files.SerializeToString() == event_descriptor()
    pool = descriptor_pool.DescriptorPool()
    for f in files.file:
        pool.Add(f)
    event, batch = (message_factory.GetMessageClass(pool.FindMessageTypeByName(n)) for n in ("Event", "EventBatch"))
    rnd = random.Random(1)
    rows = [(*(rnd.choice(["", "a", "é日", "x" * 200]) for _ in range(4)), rnd.choice([0, 1, -1, 2**63 - 1, -(2**63)]), rnd.choice([b"", b"\x00\xff", b"p" * 300]))
            for _ in range(200)]
    wires = [event(event_id=a, user_id=b, platform=c, event_type=d, ts=t, payload=p).SerializeToString() for a, b, c, d, t, p in rows]
    assert wires == [encode_one(*r) for r in rows]
    got = decode_arrow(pa.array(wires, pa.binary())).to_pylist()
    assert [tuple(g[k] for k in ("event_id", "user_id", "platform", "event_type", "ts", "payload")) for g in got] == rows
    assert batch(events=[event(event_id="q")]).SerializeToString() == b"\x0a\x03\x0a\x01q"


def test_connector_absent_here(spark):
    from keelson.sources.protobuf import connector_present
    assert connector_present(spark) is False

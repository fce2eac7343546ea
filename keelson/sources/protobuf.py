"""The event codec by Spark's own protobuf functions, where the session has their package.

``event_descriptor`` is the compiled form of the fixed event schema, which these functions need: a descriptor set written by its
public format (a message of messages), so that no compiler and no file is involved. ``connector_present`` tells whether the functions can run;
``sources.codec`` uses them then, and its Arrow codec otherwise. Both follow proto3: absent fields take defaults, defaults are not
written, a malformed message gives ``decode_ok = false`` and NULL fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.schema import EVENT

MESSAGE = "Event"
# fixed values of the descriptor format
_LABEL_OPTIONAL, _LABEL_REPEATED = 1, 3
_TYPES = {"string": 9, "long": 3, "binary": 12}
_MESSAGE_TYPE = 11


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _text(number: int, value: str | bytes) -> bytes:
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _field(name: str, number: int, label: int, kind: int, message: str = "") -> bytes:
    return _text(2, _text(1, name) + _number(3, number) + _number(4, label) + _number(5, kind) + (_text(6, message) if message else b""))


def event_descriptor() -> bytes:
    """Descriptor set of ``Event`` (its six fields, numbered from 1) and ``EventBatch`` (repeated events, field 1)."""
    fields = b"".join(_field(f.name, k, _LABEL_OPTIONAL, _TYPES[f.dataType.typeName()]) for k, f in enumerate(EVENT.fields, 1))
    event = _text(4, _text(1, MESSAGE) + fields)
    batch = _text(4, _text(1, "EventBatch") + _field("events", 1, _LABEL_REPEATED, _MESSAGE_TYPE, f".{MESSAGE}"))
    return _text(1, _text(1, "event.proto") + event + batch + _text(12, "proto3"))


def connector_present(spark: SparkSession) -> bool:
    """Whether Spark's protobuf functions are on the session's classpath."""
    try:
        loader = spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader()
        loader.loadClass("org.apache.spark.sql.protobuf.ProtobufDataToCatalyst")
        return True
    except Exception:           # not there, or a session without a JVM view (Spark Connect)
        return False


def encode_column(prefix: str = "") -> Column:
    """Event columns as one binary column of wire bytes."""
    from pyspark.sql.protobuf.functions import to_protobuf
    event = F.struct(*[F.col(prefix + f.name).alias(f.name) for f in EVENT.fields])
    return to_protobuf(event, MESSAGE, binaryDescriptorSet=event_descriptor())


def decode_events(df: DataFrame, wire_col: str = "wire", keep: tuple[str, ...] = ()) -> DataFrame:
    """Wire bytes -> event columns + ``decode_ok``, in the JVM."""
    from pyspark.sql.protobuf.functions import from_protobuf
    event = from_protobuf(F.col(wire_col), MESSAGE, options={"mode": "PERMISSIVE", "emit.default.values": "true"},
                          binaryDescriptorSet=event_descriptor())
    rows = df.select(*keep, event.alias("_ev"))
    return rows.select(*keep, *[F.col("_ev")[f.name].alias(f.name) for f in EVENT.fields], F.col("_ev").isNotNull().alias("decode_ok"))

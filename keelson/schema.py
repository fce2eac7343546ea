"""Fixed schemas (never inferred) and fixed values of the event model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values that must equal the reference's behaviour ---------------
# Event field numbers of the wire format: event_id=1, user_id=2, platform=3,
# event_type=4, ts=5, payload=6.  Batch: repeated Event events=1.
# Ack: success=1, message=2.
MAX_PAYLOAD_BYTES = 65536            # larger payloads are refused
MAX_BATCH_EVENTS = 1000              # larger batches are refused whole
PAYLOAD_TOO_LARGE = "payload too large (>64KB)"
BATCH_TOO_LARGE = "batch too large (>1000 events)"
ACK_OK = "ok"
BATCH_ACK_PREFIX = "batch:"
COMPATIBLE_VERSIONS = (1, 2, 3)      # latest schema version is 1
LATEST_VERSION = 1
MAC_BYTES = 32                       # HMAC-SHA256 length appended to the body
DRIFT_WINDOW = 1000                  # rolling median over the last 1000 rows
DRIFT_WARMUP = 10                    # fewer rows than this pass unconditionally
DRIFT_TOLERANCE_MS = 3600000
DEDUP_TTL_MS = 3600 * 1000           # idle expiry of the shared id set
DEDUP_LAST_N = 100000                # in-memory FIFO of accepted ids
KNOWN_PLATFORMS = ("ios", "android", "web")
HOT_EVENT_TYPES = ("click", "view", "purchase", "add_to_cart")
DEFAULT_TENANTS = ("tenant_a", "tenant_b", "tenant_c")
VIRTUAL_NODES = 150
BREAKER_FAILURE_THRESHOLD = 5
BREAKER_TIMEOUT_MS = 30000
BREAKER_SUCCESS_THRESHOLD = 2
STAGE_DEDUP, STAGE_WATERMARK, STAGE_HMAC = "dedup", "watermark", "hmac"
REASON_DUPLICATE_PREFIX = "duplicate event_id: "
REASON_WATERMARK = "timestamp too far from watermark"
REASON_HMAC = "hmac verification failed"
SINK_RETRIES = 3
SINK_RETRY_PAUSE_S = 0.1
FLUSH_INTERVAL = "200 milliseconds"
STATS_INTERVAL = "5 seconds"
# ---------------------------------------------------------------------------

EVENT = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("platform", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("ts", T.LongType(), False),
    T.StructField("payload", T.BinaryType(), False),
])
EVENT_FIELDS = [f.name for f in EVENT.fields]

EVENT_BATCH = T.StructType([T.StructField("events", T.ArrayType(EVENT), False)])

ACK = T.StructType([
    T.StructField("success", T.BooleanType(), False),
    T.StructField("message", T.StringType(), False),
])

# cold table row; physical order (ts, event_type)
COLD_ROW = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("platform", T.StringType(), False),
    T.StructField("ts", T.LongType(), False),
])
COLD_FIELDS = [f.name for f in COLD_ROW.fields]
COLD_ORDER = ("ts", "event_type")

# hot log entry: the same five attributes, all strings
HOT_ROW = T.StructType([T.StructField(f.name, T.StringType(), False) for f in COLD_ROW.fields])

OUTCOME = T.StructType([
    T.StructField("sink", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("t", T.LongType(), False),
    T.StructField("ok", T.BooleanType(), False),
])

VERSION_TABLE = T.StructType([
    T.StructField("version", T.IntegerType(), False),
    T.StructField("compatible", T.BooleanType(), False),
])

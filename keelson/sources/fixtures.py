"""Adapted views over the driver tables (see FIXTURES.md).

Each view exists twice: as a Spark DataFrame derived from the parquet tables,
and as DuckDB SQL text used by the independent oracles.  Both are derived from
the same tables, so every query's work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.mac import _pads, hmac_sha256, signed_message, utf8
from keelson.plans.parallel import ensure_parallelism

TEST_SECRET = "keelson-demo-key"          # test value only; production keys come from config
BASE_TS_MS = 1704067200000           # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return ensure_parallelism(df) if spread else df


def _mod(c: Column, m: int) -> Column:
    return F.pmod(c, F.lit(m))


# ---------------------------------------------------------------------------
# arrivals: signed events with replays, forged, unsigned and drifting rows
# ---------------------------------------------------------------------------

def arrivals(spark: SparkSession, sf_dir: str, secret: str = TEST_SECRET) -> DataFrame:
    ev = ensure_parallelism(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props"))
    n = F.col("event_id")
    platform = (F.when(_mod(n, 10) < 4, "ios").when(_mod(n, 10) < 7, "android")
                .when(_mod(n, 10) < 9, "web").otherwise("tv"))
    ts = (F.lit(BASE_TS_MS) + n * 1000
          + F.when(_mod(n, 37) == 5, F.lit(7200000))
             .when(_mod(n, 41) == 6, F.lit(-7200000)).otherwise(F.lit(0))).cast("bigint")
    base = ev.select(
        n.alias("n"),
        F.concat(F.lit("e"), n.cast("string")).alias("event_id"),
        F.concat(F.lit("acct-"), F.col("user_id").cast("string")).alias("user_id"),
        platform.alias("platform"),
        F.col("event_type"),
        ts.alias("ts"),
        utf8("props").alias("body"),
    )
    signed_id = F.when(_mod(F.col("n"), 53) == 11, F.concat(F.col("event_id"), F.lit("X"))) \
        .otherwise(F.col("event_id"))
    mac = hmac_sha256(signed_message(signed_id, F.col("user_id"), F.col("event_type"),
                                     F.col("ts"), F.col("body")), secret)
    payload = F.when(_mod(F.col("n"), 59) == 13, F.col("body")).otherwise(F.concat(F.col("body"), mac))
    cols = ["event_id", "user_id", "platform", "event_type", "ts"]
    first = base.select(*cols, payload.alias("payload"), (F.col("n") * 2).alias("seq"), "n")
    replay = first.where(_mod(F.col("n"), 20) == 7) \
        .withColumn("seq", (F.col("n") + 100) * 2 + 1)
    return first.unionByName(replay).drop("n")


def _hex(b: bytes) -> str:
    return b.hex().upper()


def duck_hmac(msg_sql: str, secret: str = TEST_SECRET) -> str:
    ipad, opad = _pads(secret.encode("utf-8"))
    inner = f"unhex(sha256(unhex('{_hex(ipad)}') || {msg_sql}))"
    return f"unhex(sha256(unhex('{_hex(opad)}') || {inner}))"


def duck_arrivals(secret: str = TEST_SECRET) -> str:
    msg = ("encode((event_id || CASE WHEN n % 53 = 11 THEN 'X' ELSE '' END) || user_id || event_type"
           " || CAST(ts AS VARCHAR)) || body")
    return f"""
    arr_base AS (
      SELECT event_id AS n, 'e' || event_id AS event_id, 'acct-' || user_id AS user_id,
             CASE WHEN event_id % 10 < 4 THEN 'ios' WHEN event_id % 10 < 7 THEN 'android'
                  WHEN event_id % 10 < 9 THEN 'web' ELSE 'tv' END AS platform,
             event_type,
             CAST(1704067200000 + event_id * 1000
                  + CASE WHEN event_id % 37 = 5 THEN 7200000 WHEN event_id % 41 = 6 THEN -7200000 ELSE 0 END
                  AS BIGINT) AS ts,
             encode(props) AS body
      FROM events),
    arr_first AS (
      SELECT event_id, user_id, platform, event_type, ts,
             CASE WHEN n % 59 = 13 THEN body ELSE body || {duck_hmac(msg, secret)} END AS payload,
             n * 2 AS seq, n
      FROM arr_base),
    arrivals AS (
      SELECT event_id, user_id, platform, event_type, ts, payload, seq FROM arr_first
      UNION ALL
      SELECT event_id, user_id, platform, event_type, ts, payload, (n + 100) * 2 + 1 AS seq
      FROM arr_first WHERE n % 20 = 7)"""


# ---------------------------------------------------------------------------
# outcomes: call log for the breaker
# ---------------------------------------------------------------------------

def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("string").alias("sink"),
        F.col("event_id").cast("bigint").alias("seq"),
        F.expr("unix_micros(cast(ts AS timestamp)) div 1000").alias("t"),
        (F.col("event_type") != "error").alias("ok"),
    )


DUCK_OUTCOMES = """
    outcomes AS (
      SELECT CAST(user_id AS VARCHAR) AS sink, CAST(event_id AS BIGINT) AS seq,
             epoch_us(ts) // 1000 AS t, event_type <> 'error' AS ok
      FROM events)"""


# ---------------------------------------------------------------------------
# other views
# ---------------------------------------------------------------------------

def big_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.encode(F.repeat(F.col("text"), 4), "utf-8").alias("payload"))


DUCK_BIG_PAYLOADS = """
    big_payloads AS (SELECT doc_id, encode(repeat(text, 4)) AS payload FROM documents)"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    n = F.col("event_id")
    batch_id = F.when(_mod(n, 2) == 0, F.concat(F.lit("a"), F.floor(n / 1100).cast("string"))) \
        .otherwise(F.concat(F.lit("b"), F.floor(n / 2400).cast("string")))
    size = F.length("props") * (F.lit(1) + F.when(_mod(n, 97) == 0, F.lit(8000)).otherwise(F.lit(0)))
    return ev.select(batch_id.alias("batch_id"), n.cast("bigint").alias("seq"),
                     size.cast("bigint").alias("payload_size"))


DUCK_BATCHES = """
    batches AS (
      SELECT CASE WHEN event_id % 2 = 0 THEN 'a' || (event_id // 1100) ELSE 'b' || (event_id // 2400) END
               AS batch_id,
             CAST(event_id AS BIGINT) AS seq,
             CAST(length(props) * (1 + CASE WHEN event_id % 97 = 0 THEN 8000 ELSE 0 END) AS BIGINT)
               AS payload_size
      FROM events)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").cast("bigint").alias("seq"),
                     _mod(F.col("event_id"), 5).cast("int").alias("schema_version"))


DUCK_VERSIONS = """
    versions AS (SELECT CAST(event_id AS BIGINT) AS seq, CAST(event_id % 5 AS INTEGER) AS schema_version
                 FROM events)"""


def idle_arrivals(spark: SparkSession, sf_dir: str, secret: str = TEST_SECRET) -> DataFrame:
    arr = arrivals(spark, sf_dir, secret)
    t = F.col("seq") * 100 + F.lit(7200000) * F.floor(F.col("seq") / 5000)
    return arr.withColumn("t", t.cast("bigint"))


DUCK_IDLE = """
    idle_arrivals AS (SELECT *, CAST(seq * 100 + 7200000 * (seq // 5000) AS BIGINT) AS t FROM arrivals)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    failed = _mod(F.col("event_id"), 101) == 0
    # latency in microseconds; -1 marks a failed call
    lat = F.when(failed, F.lit(-1)).otherwise(F.round(F.col("value") * 1000).cast("bigint"))
    return ev.select("event_type", F.col("event_id").cast("bigint").alias("seq"),
                     F.expr("unix_micros(cast(ts AS timestamp)) div 1000").alias("t"),
                     lat.alias("latency_us"))


DUCK_SAMPLES = """
    samples AS (
      SELECT event_type, CAST(event_id AS BIGINT) AS seq, epoch_us(ts) // 1000 AS t,
             CASE WHEN event_id % 101 = 0 THEN -1 ELSE CAST(round(value * 1000) AS BIGINT) END AS latency_us
      FROM events)"""


def ring_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that grow with the tables: users, customers and orders."""
    parts = [table(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("key"))
             for t, c, p in (("events", "user_id", "acct-"), ("customer", "c_custkey", "cust-"), ("orders", "o_orderkey", "order-"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


DUCK_RING_KEYS = """
    ring_keys AS (
      SELECT DISTINCT key FROM (
        SELECT 'acct-' || user_id AS key FROM events
        UNION ALL SELECT 'cust-' || c_custkey FROM customer
        UNION ALL SELECT 'order-' || o_orderkey FROM orders))"""

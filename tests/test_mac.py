import hashlib
import hmac
import random

from pyspark.sql import functions as F

from keelson.functions.mac import hmac_sha256
from keelson.operators.quality import sign_events, verify_hmac

KEY = "own-test-key"


def _event_rows(spark, rows):
    return spark.createDataFrame(rows, "event_id string, user_id string, platform string, event_type string, "
                                       "ts bigint, payload binary")


def test_hmac_matches_python(spark):
    rnd = random.Random(7)
    msgs = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(0, 300))) for _ in range(200)]
    for key in (b"k", b"own-test-key", bytes(range(64)), bytes(range(100)) * 2):
        df = spark.createDataFrame([(m,) for m in msgs], "m binary")
        got = [bytes(r.h) for r in df.select(hmac_sha256(F.col("m"), key).alias("h")).collect()]
        exp = [hmac.new(key, m, hashlib.sha256).digest() for m in msgs]
        assert got == exp


def test_sign_verify_tamper_unsigned(spark):
    rows = [("hmac_e1", "u1", "web", "click", 1000, b"test_data"),
            ("hmac_e2", "u1", "web", "click", 1000, b"test_data")]
    signed = sign_events(_event_rows(spark, rows), KEY).collect()
    tampered = [("TAMPERED",) + tuple(signed[1])[1:]]
    unsigned = [("hmac_e3", "u1", "web", "click", 1000, b"test_data")]
    df = _event_rows(spark, [tuple(signed[0])] + tampered + unsigned)
    got = {r.event_id: r.hmac_ok for r in verify_hmac(df, KEY).collect()}
    assert got == {"hmac_e1": True, "TAMPERED": False, "hmac_e3": False}


def test_mac_length_boundary(spark):
    # 32 bytes = empty body + MAC: always fails; 33 can pass
    mac_empty = hmac.new(KEY.encode(), b"e1u1click5", hashlib.sha256).digest()
    body = b"x"
    mac_one = hmac.new(KEY.encode(), b"e2u1click5" + body, hashlib.sha256).digest()
    df = _event_rows(spark, [("e1", "u1", "web", "click", 5, mac_empty), ("e2", "u1", "web", "click", 5, body + mac_one)])
    got = {r.event_id: r.hmac_ok for r in verify_hmac(df, KEY).collect()}
    assert got == {"e1": False, "e2": True}


def test_platform_not_covered(spark):
    rows = [("e1", "u1", "web", "click", 7, b"abc")]
    s = sign_events(_event_rows(spark, rows), KEY).withColumn("platform", F.lit("tv"))
    assert verify_hmac(s, KEY).first().hmac_ok

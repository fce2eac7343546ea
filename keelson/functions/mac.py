"""HMAC-SHA256 as a native column expression (no UDF).

HMAC(K, m) = H((K' xor opad) || H((K' xor ipad) || m)), K' = K padded to the
64-byte block (hashed first when longer).  The two pads depend only on the key,
so they are built once on the driver and enter the plan as binary literals;
the per-row work is two ``sha2`` calls inside whole-stage codegen.

The key appears in the plan as a literal: do not log ``explain()`` output of a
production job.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.schema import MAC_BYTES

_BLOCK = 64


def _pads(key: bytes) -> tuple[bytes, bytes]:
    if not key:
        raise ValueError("HMAC key is missing or empty")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\x00")
    ipad = bytes(b ^ 0x36 for b in key)
    opad = bytes(b ^ 0x5C for b in key)
    return ipad, opad


def as_key(secret: str | bytes) -> bytes:
    return secret.encode("utf-8") if isinstance(secret, str) else bytes(secret)


def secret_from_env(name: str = "KEELSON_HMAC_KEY") -> str:
    """The signing key from the environment of the driver; raises if it is not set."""
    import os
    key = os.environ.get(name)
    if not key:
        raise ValueError(f"set {name} to the signing key")
    return key


def hmac_sha256(message: Column, secret: str | bytes) -> Column:
    """32 raw bytes of HMAC-SHA256 over a BINARY column."""
    ipad, opad = _pads(as_key(secret))
    inner = F.unhex(F.sha2(F.concat(F.lit(ipad), message), 256))
    return F.unhex(F.sha2(F.concat(F.lit(opad), inner), 256))


def utf8(c: Column | str) -> Column:
    return F.encode(F.col(c) if isinstance(c, str) else c, "utf-8")


def signed_message(event_id: Column, user_id: Column, event_type: Column,
                   ts: Column, body: Column) -> Column:
    """Bytes covered by the MAC: id, user, type, decimal ts, body; no separators.

    ``platform`` is not covered.
    """
    text = F.concat(event_id, user_id, event_type, ts.cast("string"))
    return F.concat(utf8(text), body)


def split_payload(payload: Column) -> tuple[Column, Column]:
    """(body, mac): body is all but the last 32 bytes, mac the last 32.

    Only meaningful when the payload is at least 33 bytes long; callers guard.
    """
    n = F.octet_length(payload)
    body = F.substring(payload, F.lit(1), n - MAC_BYTES)
    mac = F.substring(payload, n - MAC_BYTES + 1, F.lit(MAC_BYTES))
    return body, mac


def verify_expr(event_id: Column, user_id: Column, event_type: Column, ts: Column,
                payload: Column, secret: str | bytes) -> Column:
    """True when payload = body || HMAC(body-message); false below 33 bytes."""
    body, mac = split_payload(payload)
    expected = hmac_sha256(signed_message(event_id, user_id, event_type, ts, body), secret)
    long_enough = F.octet_length(payload) >= MAC_BYTES + 1
    return F.when(long_enough, mac == expected).otherwise(F.lit(False))

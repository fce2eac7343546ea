"""Quality stages in order: dedup -> drift -> HMAC -> platform (Q9-Q14).

The verdict keeps the reference's order and side effects:
* the drift window sees every dedup survivor, including forged and drifting
  rows (they are pushed before any test), and never sees duplicates;
* a forged row consumes its id, so a later genuine row with that id is a
  duplicate.
Nothing is dropped: each row gets ``passed``, ``stage`` and ``reason``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.mac import hmac_sha256, signed_message, verify_expr
from keelson.operators.dedup import dedup_first
from keelson.operators.drift import drift_filter
from keelson.operators.order import ROWS_PER_RANGE, require_seq
from keelson.plans.joins import materialize
from keelson.schema import (DRIFT_TOLERANCE_MS, DRIFT_WARMUP, DRIFT_WINDOW, EVENT, KNOWN_PLATFORMS,
                            MAC_BYTES, REASON_DUPLICATE_PREFIX, REASON_HMAC, REASON_WATERMARK,
                            STAGE_DEDUP, STAGE_HMAC, STAGE_WATERMARK)


def with_defaults(df: DataFrame) -> DataFrame:
    """Event columns with NULLs as the wire format's defaults (empty text or bytes, zero), as if read from the wire."""
    given = {f.name: f.dataType for f in EVENT.fields}
    fill = {"string": F.lit(""), "long": F.lit(0).cast("bigint"), "binary": F.lit(b"")}
    return df.withColumns({c: F.coalesce(F.col(c), fill[t.typeName()]) for c, t in given.items() if c in df.columns})


def sign_events(df: DataFrame, secret: str | bytes, body_col: str = "payload",
                out_col: str = "payload") -> DataFrame:
    """Q9: payload := body || HMAC(id, user, type, ts, body)."""
    c = F.col
    mac = hmac_sha256(signed_message(c("event_id"), c("user_id"), c("event_type"), c("ts"),
                                     c(body_col)), secret)
    return df.withColumn(out_col, F.concat(c(body_col), mac))


def verify_hmac(df: DataFrame, secret: str | bytes, out_col: str = "hmac_ok") -> DataFrame:
    """Q11: flag rows whose payload ends in a valid MAC over the rest."""
    c = F.col
    return df.withColumn(out_col, verify_expr(c("event_id"), c("user_id"), c("event_type"),
                                              c("ts"), c("payload"), secret))


def split_payload_cols(df: DataFrame) -> DataFrame:
    """Q10: body and mac columns (NULL when the payload is too short to carry a MAC)."""
    n = F.octet_length("payload")
    has = n >= MAC_BYTES
    return df.withColumn("body", F.when(has, F.substring("payload", F.lit(1), n - MAC_BYTES))) \
        .withColumn("mac", F.when(has, F.substring("payload", n - MAC_BYTES + 1, F.lit(MAC_BYTES))))


def flag_platform(df: DataFrame, known: Sequence[str] = KNOWN_PLATFORMS,
                  out_col: str = "platform_known") -> DataFrame:
    """Q12: known platform flag; never rejects, never changes the row."""
    return df.withColumn(out_col, F.col("platform").isin(list(known)))


def verdict_columns(df: DataFrame) -> DataFrame:
    """Q13 from the three stage flags: first failing stage wins."""
    c = F.col
    # a flag that is not there is a failed one: ``passed`` is never NULL, so no row falls between the branches
    dedup, drift, mac = (F.coalesce(c(k), F.lit(False)) for k in ("dedup_ok", "drift_ok", "hmac_ok"))
    stage = (F.when(~dedup, F.lit(STAGE_DEDUP)).when(~drift, F.lit(STAGE_WATERMARK))
             .when(~mac, F.lit(STAGE_HMAC)).otherwise(F.lit("")))
    reason = (F.when(~dedup, F.concat(F.lit(REASON_DUPLICATE_PREFIX), F.coalesce(c("event_id"), F.lit(""))))
              .when(~drift, F.lit(REASON_WATERMARK))
              .when(~mac, F.lit(REASON_HMAC)).otherwise(F.lit("")))
    return df.withColumn("passed", dedup & drift & mac) \
        .withColumn("stage", stage).withColumn("reason", reason)


def quality_verdict(df: DataFrame, secret: str | bytes, seq_col: str = "seq",
                    dedup=None, window: int = DRIFT_WINDOW, warmup: int = DRIFT_WARMUP,
                    tolerance_ms: int = DRIFT_TOLERANCE_MS, partition_cols: Sequence[str] = (),
                    keep_payload: bool = False, n_rows: int | None = None, **drift_kw) -> DataFrame:
    """All stages; returns every input row with flags and the verdict.

    ``dedup`` is a function ``DataFrame -> DataFrame`` adding ``dedup_ok``, or one
    of the names "first" (default), "last_n" (FIFO of the last 100,000 accepted
    ids) and "idle_ttl" (shared set with idle expiry; needs arrival time ``t``).
    The MAC is checked first in the plan because it is a pure function of the
    row; only its flag travels on, so the payload is not shuffled.  An input
    that already carries ``hmac_ok`` (checked at decode time) is not re-verified.
    """
    require_seq(df, seq_col)
    dedup = _dedup_by_name(dedup, seq_col)
    df = with_defaults(df)
    flagged = df if "hmac_ok" in df.columns else verify_hmac(df, secret)
    flagged = flag_platform(flagged)
    if not keep_payload and "payload" in flagged.columns:
        flagged = flagged.drop("payload")
    # the input's size bounds that of the survivors: no extra pass over the dedup result is needed
    if n_rows is None:
        n_rows = df.count()
    rpr = drift_kw.pop("rows_per_range", ROWS_PER_RANGE)
    if dedup is dedup_first:
        flagged, map_only = dedup_first(flagged, seq_col=seq_col, with_plan_info=True)
    else:
        flagged, map_only = dedup(flagged), False
    if not map_only:
        # the duplicate branch would turn the dedup join into an inner join and shuffle
        # the input a second time; cut once instead
        flagged = materialize(flagged, "dedup")
    dups = flagged.where(~F.col("dedup_ok")).withColumn("median", F.lit(None).cast("bigint")) \
        .withColumn("window_rows", F.lit(None).cast("int")).withColumn("drift_ok", F.lit(None).cast("boolean"))
    survivors = flagged.where(F.col("dedup_ok"))
    drifted = drift_filter(survivors, "ts", seq_col, window, warmup, tolerance_ms, partition_cols,
                           n_rows=n_rows, rows_per_range=rpr, **drift_kw)
    return verdict_columns(drifted.unionByName(dups))


def _dedup_by_name(dedup, seq_col: str):
    if dedup is None or dedup == "first":
        return dedup_first
    if dedup == "last_n":
        from keelson.operators.dedup_seq import dedup_last_n
        return lambda rows: dedup_last_n(rows, seq_col=seq_col)
    if dedup == "idle_ttl":
        from keelson.operators.dedup_seq import dedup_idle_ttl
        return lambda rows: dedup_idle_ttl(rows, seq_col=seq_col)
    if callable(dedup):
        return dedup
    raise ValueError(f"unknown dedup form {dedup!r}")


def quality_counters(verdict: DataFrame, decode_failures: DataFrame | None = None) -> DataFrame:
    """Q14: total, rejected, dedup_rejected (+ engine rejects incl. decode failures)."""
    c = F.col
    rows = verdict.select("passed", "stage", F.lit(False).alias("_decode_fail"))
    if decode_failures is not None:
        rows = rows.unionByName(decode_failures.select(
            F.lit(None).cast("boolean").alias("passed"), F.lit(None).cast("string").alias("stage"),
            F.lit(True).alias("_decode_fail")))
    aggs = [
        F.count_if(~c("_decode_fail")).alias("total"),
        F.count_if(~c("passed")).alias("rejected"),
        F.count_if(c("stage") == STAGE_DEDUP).alias("dedup_rejected"),
        F.count_if(c("stage") == STAGE_WATERMARK).alias("watermark_rejected"),
        F.count_if(c("stage") == STAGE_HMAC).alias("hmac_rejected"),
        F.count_if(c("passed")).alias("passed"),
    ]
    if decode_failures is not None:
        aggs += [F.count_if(c("_decode_fail")).alias("decode_rejected"),
                 F.count_if(c("_decode_fail") | ~c("passed")).alias("engine_rejected")]
    return rows.agg(*aggs)

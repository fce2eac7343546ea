"""Batch pipeline (P1): decode -> verdict -> tenant -> path -> hot fallback.

``run_batch`` is lazy except for its cut points: the decoded input (narrow,
MAC already checked) and the verdict are checkpointed once each, and the
dedup flags too when the dedup join has to shuffle.  Counts that steer later
plan choices are observed while those jobs run.  Every output row keeps its
verdict; routing columns are NULL on rejected rows.  Sinks are separate
(``keelson.sinks``) so one routed frame can feed both outputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.breaker import BLOCK_ROWS, breaker_final_state, breaker_timeline
from keelson.operators.quality import quality_verdict, verify_hmac
from keelson.operators.ring import assign_tenant, build_ring, members, prepare_ring
from keelson.operators.route import classify_path, hot_with_fallback
from keelson.plans.joins import materialize, materialize_observed
from keelson.schema import (BREAKER_FAILURE_THRESHOLD, BREAKER_SUCCESS_THRESHOLD, BREAKER_TIMEOUT_MS,
                            DEFAULT_TENANTS, HOT_EVENT_TYPES, VIRTUAL_NODES)
from keelson.sources.codec import decode_events

STAGE_DECODE = "decode"


def hot_delivery(routed: DataFrame, write_ok: Column, t_col: str = "ts", seq_col: str = "seq",
                 sink: str = "hot", failure_threshold: int = BREAKER_FAILURE_THRESHOLD,
                 timeout_ms: int = BREAKER_TIMEOUT_MS,
                 success_threshold: int = BREAKER_SUCCESS_THRESHOLD, n_calls: int | None = None,
                 block_rows: int = BLOCK_ROWS, initial: DataFrame | None = None,
                 return_state: bool = False):
    """Hot writes through the breaker: ``delivered`` = allowed and the write succeeded.

    ``write_ok`` is the outcome the hot store would give each hot row.  Cold and
    rejected rows make no call.  ``initial`` continues from an earlier breaker
    state; with ``return_state`` the breaker state after the last call is
    returned too, as ``(rows, state)``.
    """
    is_call = F.col("passed") & (F.col("path") == "hot")
    calls = routed.where(is_call).withColumn("_sink", F.lit(sink)) \
        .withColumn("_t", F.col(t_col)).withColumn("_ok", write_ok)
    # rows pass through the fold whole (no join back); one sink receives every
    # call, so the call count is the largest-sink size that picks the plan
    method = "auto" if n_calls is None else ("fold" if n_calls <= block_rows else "blocks")
    tl = breaker_timeline(calls, sink_col="_sink", seq_col=seq_col, t_col="_t", ok_col="_ok",
                          failure_threshold=failure_threshold, timeout_ms=timeout_ms,
                          success_threshold=success_threshold, method=method, block_rows=block_rows,
                          initial=initial, n_rows=n_calls)
    if return_state:
        tl = materialize(tl, "hot-calls")
    done = tl.withColumn("delivered", F.col("allowed") & F.col("_ok")) \
        .drop("_sink", "_t", "_ok", "state", "failure_count", "success_count", "last_failure")
    others = routed.where(~is_call).withColumn("allowed", F.lit(None).cast("boolean")) \
        .withColumn("delivered", F.lit(None).cast("boolean"))
    rows = done.unionByName(others)
    if return_state:
        return rows, breaker_final_state(tl, "_sink", seq_col)
    return rows


def run_batch(df: DataFrame, secret: str | bytes, tenants: Sequence[str] = DEFAULT_TENANTS,
              wire_col: str | None = None, hot_write_ok: Column | None = None,
              hot_sink_available: bool = True, seq_col: str = "seq",
              hot_types: Sequence[str] = HOT_EVENT_TYPES, breaker_block_rows: int = BLOCK_ROWS,
              **verdict_kw) -> DataFrame:
    """P1 over a table of events (or of wire bytes when ``wire_col`` is given)."""
    spark = df.sparkSession
    rejects = None
    n_rows = None
    if wire_col is not None:
        keep = tuple(c for c in df.columns if c != wire_col)
        # decode once, check the MAC while the payload is at hand, then cut with narrow rows only
        decoded = verify_hmac(decode_events(df, wire_col, keep=keep), secret).drop("payload")
        decoded, seen_dec = materialize_observed(decoded, "decoded", ok=F.count_if(F.col("decode_ok")))
        n_rows = int(seen_dec["ok"])
        rejects = decoded.where(~F.col("decode_ok")).select(seq_col)
        df = decoded.where(F.col("decode_ok")).drop("decode_ok")
    hot = F.col("passed") & F.col("event_type").isin(list(hot_types))
    verdict, seen = materialize_observed(quality_verdict(df, secret, seq_col=seq_col, n_rows=n_rows, **verdict_kw),
                                         "verdict", hot_calls=F.count_if(hot))
    ring = build_ring(members(spark, tenants))
    prepared = prepare_ring(ring, n_points=len(tuple(tenants)) * VIRTUAL_NODES)
    passed = verdict.where(F.col("passed"))
    routed = classify_path(assign_tenant(passed, ring, "user_id", "tenant", prepared=prepared), hot_types)
    if hot_write_ok is not None and hot_sink_available:
        routed = hot_delivery(routed, hot_write_ok, seq_col=seq_col, n_calls=int(seen["hot_calls"]),
                              block_rows=breaker_block_rows)
        routed = hot_with_fallback(routed, "delivered")
    else:
        routed = hot_with_fallback(routed, None, sink_available=hot_sink_available)
    rejected = verdict.where(~F.col("passed"))
    out = routed.unionByName(rejected, allowMissingColumns=True)
    if rejects is not None:
        bad = rejects.select(seq_col, F.lit(False).alias("passed"), F.lit(STAGE_DECODE).alias("stage"))
        out = out.unionByName(bad, allowMissingColumns=True)
    return out


"""Streaming forms of the quality stages and the pipeline (Q4, Q7, K5, P2, T3, and the counters Q14, R10, K9).

* ``dedup_stream`` (Q4): flags the first arrival per id, micro-batch by micro-batch, against a table of accepted ids (``state.first_arrivals``).
* ``drift_stream`` (Q7): the rolling-median drift filter as a stateful
  processor keyed by shard; the value state is the last ``window - 1`` ts.  One
  shard = one global window, as in a single reference process.  Rows of each
  micro-batch are ordered by ``seq``; Spark gives no order across files, so
  the source must deliver later seqs in later batches.
* ``run_stream`` (P2): from events or wire bytes to both sinks, with statistics and counters, in one ``foreachBatch`` that overwrites only its own
  batch partitions, so replays after a failure are idempotent.
* ``interval_stats_stream`` (T3): counts by arrival time. Arrival never runs ahead of the rows, so none is late and none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators.drift import _rolling_upper_median, near_median
from keelson.operators.stats import INTERVAL_METRICS, INTERVAL_MS, interval_counts, running_totals
from keelson.schema import DEDUP_TTL_MS, DRIFT_TOLERANCE_MS, DRIFT_WARMUP, DRIFT_WINDOW, FLUSH_INTERVAL
from keelson.session import scratch_scope
from keelson.streaming.state import ARRIVED, arrival_seq, first_arrivals, read_state, write_state


def enable_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _arriving(stream: DataFrame, arrived: Column | None = None) -> DataFrame:
    """``stream`` with its arrival time in ms. Without a column of its own that is the batch's time, which Spark logs with the batch: a replay
    sees the same one."""
    now = F.unix_millis(F.current_timestamp())
    return stream.withColumn(ARRIVED, now if arrived is None else F.coalesce(arrived.cast("long"), now))


def dedup_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None], state_root: str, id_col: str = "event_id",
                 seq_col: str = "seq", ttl_ms: int = DEDUP_TTL_MS, order_cols: Sequence[str] = ()):
    """Q4 on a stream: calls ``sink(rows, batch_id)`` for every micro-batch, with ``dedup_ok`` and ``arrived_ms`` on every row; returns the
    DataStreamWriter, to be given a checkpoint and a trigger and started.

    No row is late and none is dropped. With ``order_cols`` the rows get their ``seq_col`` from these columns first (``state.arrival_seq``). State lies
    under ``state_root``; scratch tables of a batch go when its sink is done.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession, f"{state_root}/_work"):
            if order_cols:
                batch = arrival_seq(batch, batch_id, f"{state_root}/order", order_cols, seq_col)
            sink(first_arrivals(batch, batch_id, f"{state_root}/ids", id_col, seq_col, ttl_ms), batch_id)

    return _arriving(stream).writeStream.foreachBatch(run).outputMode("append")


def _drift_processor(window: int, warmup: int, tolerance_ms: int, ts_col: str, seq_col: str, key_col: str):
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class DriftProcessor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.recent = handle.getValueState("recent", "ts ARRAY<BIGINT>")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows), ignore_index=True).sort_values(seq_col, kind="stable")
            prior = np.array(self.recent.get()[0], dtype="int64") if self.recent.exists() else \
                np.empty(0, dtype="int64")
            ts = batch[ts_col].to_numpy(dtype="int64")
            both = np.concatenate([prior, ts])
            med = _rolling_upper_median(both, window)[len(prior):]
            filled = np.minimum(np.arange(len(prior) + 1, len(both) + 1), window)
            out = batch.copy()
            out[key_col] = key[0]
            out["median"] = med
            out["window_rows"] = filled.astype("int32")
            out["drift_ok"] = (filled < warmup) | near_median(ts, med, tolerance_ms)
            self.recent.update((both[-(window - 1):].tolist() if window > 1 else [],))
            yield out

        def close(self) -> None:
            pass

    return DriftProcessor()


def drift_stream(stream: DataFrame, shard_col: str | None = None, ts_col: str = "ts", seq_col: str = "seq",
                 window: int = DRIFT_WINDOW, warmup: int = DRIFT_WARMUP,
                 tolerance_ms: int = DRIFT_TOLERANCE_MS) -> DataFrame:
    """Q7: drift flag on a stream, keyed by ``shard_col`` (one global window when None)."""
    enable_state_store(stream.sparkSession)
    key = shard_col or "_shard"
    src = stream if shard_col else stream.withColumn("_shard", F.lit(0))
    schema = T.StructType(list(src.schema.fields) + [
        T.StructField("median", T.LongType()), T.StructField("window_rows", T.IntegerType()),
        T.StructField("drift_ok", T.BooleanType())])
    out = src.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_drift_processor(window, warmup, tolerance_ms, ts_col, seq_col, key),
        outputStructType=schema, outputMode="Append", timeMode="None")
    return out if shard_col else out.drop("_shard")


def drift_micro_batch(batch: DataFrame, batch_id: int, tail_root: str, ts_col: str = "ts",
                      seq_col: str = "seq", window: int = DRIFT_WINDOW, warmup: int = DRIFT_WARMUP,
                      tolerance_ms: int = DRIFT_TOLERANCE_MS) -> DataFrame:
    """Q7 inside ``foreachBatch``, parallel: the global window across micro-batches.

    The previous batch's last ``window - 1`` rows (seq, ts) are kept as a small
    table per batch id; they join this batch as a halo, the batch block-halo
    operator runs on the union, and this batch's tail is written for the next.
    Re-running a batch reads the same previous tail and overwrites its own, so
    replays are idempotent.  Returns the batch rows with median, window_rows,
    drift_ok (the result is materialized before the tail is written).
    """
    from keelson.operators.drift import drift_filter
    from keelson.plans.joins import materialize
    spark = batch.sparkSession
    tail = read_state(spark, tail_root, batch_id)
    own = batch.withColumn("_halo", F.lit(False))
    if tail is not None:
        tail = tail.select(seq_col, ts_col)
    both = own if tail is None else own.unionByName(tail.withColumn("_halo", F.lit(True)),
                                                    allowMissingColumns=True)
    flagged = materialize(drift_filter(both, ts_col, seq_col, window, warmup, tolerance_ms))
    new_tail = flagged.select(seq_col, ts_col).orderBy(F.col(seq_col).desc()).limit(max(window - 1, 0))
    write_state(new_tail, tail_root, batch_id)
    return flagged.where(~F.col("_halo")).drop("_halo")


def micro_batches(writer, interval: str = FLUSH_INTERVAL, available_now: bool = False):
    """K5: periodic flush as a processing-time trigger (availableNow for tests)."""
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)


COUNTERS = ("total", "rejected", "dedup_rejected", "watermark_rejected", "hmac_rejected", "passed", "decode_rejected",
            "engine_rejected", "hot_count", "cold_count", "hot_fallback_cold", "rows_flushed", "rows_dead_lettered")


def run_stream(stream: DataFrame, secret: str | bytes, out_root: str, checkpoint: str,
               tenants=None, available_now: bool = False, hot_write_ok=None, wire_col: str | None = None,
               ttl_ms: int = DEDUP_TTL_MS, order_cols: Sequence[str] = (), interval_ms: int = INTERVAL_MS):
    """Start the streaming pipeline over events (or over wire bytes in ``wire_col``); returns the StreamingQuery.

    Output folders under ``out_root``: ``verdict`` (every input row with its verdict, duplicates and unreadable messages
    included), ``routes``, ``hot`` and ``cold`` (sinks) and ``dead_letter`` (cold rows whose write failed), each partitioned
    by micro-batch id; ``accounting`` (rows, attempts and dead letters of each cold write); ``stats`` (T3 by arrival, read with
    ``interval_totals``) and ``counters`` (read with ``stream_counters``), observed on the batch's own writes.
    Rows need ``seq``, or ``order_cols`` from which it is made (a topic's timestamp, partition and offset).
    The drift window is evaluated inside each micro-batch in parallel (tail state under ``out_root/_drift_tail``).
    With ``hot_write_ok`` (the hot store's outcome per hot row) hot writes go through the breaker, whose state is
    carried from batch to batch under ``out_root/_breaker``; failed or denied hot rows fall back to cold.
    """
    from keelson.operators.quality import verdict_columns, verify_hmac, with_defaults
    from keelson.operators.ring import assign_tenant, build_ring, members, prepare_ring
    from keelson.operators.route import classify_path, hot_with_fallback
    from keelson.plans.joins import materialize, materialize_observed
    from keelson.plans.pipeline import STAGE_DECODE, hot_delivery
    from keelson.schema import DEFAULT_TENANTS, HOT_EVENT_TYPES, STAGE_DEDUP, STAGE_HMAC, STAGE_WATERMARK, VIRTUAL_NODES
    from keelson.sinks.writers import _write_partition, write_cold, write_hot, write_with_dead_letter
    from keelson.sources.codec import decode_events

    spark = stream.sparkSession
    names = tuple(tenants or DEFAULT_TENANTS)
    ring = materialize(build_ring(members(spark, names)), "ring-points")        # hashed once
    segments, digits, small = prepare_ring(ring, n_points=len(names) * VIRTUAL_NODES)
    prepared = (materialize(segments, "ring"), digits, small)      # once, not in every micro-batch
    if wire_col is not None:
        stream = decode_events(stream, wire_col, keep=tuple(c for c in stream.columns if c != wire_col))
    flagged = verify_hmac(with_defaults(stream), secret).drop("payload")

    def sink(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.where("dedup_ok")
        again = batch.where("NOT dedup_ok").withColumns({
            "median": F.lit(None).cast("bigint"), "window_rows": F.lit(None).cast("int"), "drift_ok": F.lit(None).cast("boolean")})
        drifted = drift_micro_batch(fresh, batch_id, f"{out_root}/_drift_tail")
        v = verdict_columns(drifted.unionByName(again))
        readable = F.coalesce(F.col("decode_ok"), F.lit(False)) if "decode_ok" in v.columns else F.lit(True)
        v = v.withColumns({"stage": F.when(~readable, STAGE_DECODE).otherwise(F.col("stage")),
                           "reason": F.when(~readable, "").otherwise(F.col("reason"))})
        stage = {f"{name}_rejected": F.count_if(F.col("stage") == value)
                 for name, value in (("dedup", STAGE_DEDUP), ("watermark", STAGE_WATERMARK), ("hmac", STAGE_HMAC))}
        v, counted = materialize_observed(
            v, "stream-verdict", total=F.count_if(readable), rejected=F.count_if(readable & ~F.col("passed")), **stage,
            passed=F.count_if("passed"), decode_rejected=F.count_if(~readable), engine_rejected=F.count_if(~F.col("passed")),
            hot_calls=F.count_if(F.col("passed") & F.col("event_type").isin(list(HOT_EVENT_TYPES))))
        _write_partition(v.select("event_id", "seq", "passed", "stage", "reason"), f"{out_root}/verdict", batch_id)
        routed = classify_path(v.where("passed"))
        if hot_write_ok is not None:
            state_root = f"{out_root}/_breaker"
            prior = read_state(spark, state_root, batch_id)
            routed, state = hot_delivery(routed, hot_write_ok, initial=prior, return_state=True, n_calls=int(counted["hot_calls"] or 0))
            write_state(state, state_root, batch_id)
            routed = hot_with_fallback(routed, "delivered")
        else:
            routed = hot_with_fallback(routed, None)
        routed = assign_tenant(routed, ring, prepared=prepared)  # after the breaker, whose passes need no tenant
        is_hot = F.col("path") == "hot"
        routed, sent = materialize_observed(                    # three writers follow
            routed, "stream-routed", hot_count=F.count_if(is_hot), cold_count=F.count_if(~is_hot), hot_fallback_cold=F.count_if("fallback"))
        path = F.col("effective_path")
        _write_partition(routed.select("seq", "tenant", "effective_path"), f"{out_root}/routes", batch_id)
        write_hot(routed.where(path == "hot"), f"{out_root}/hot", batch_id)
        done = write_with_dead_letter(routed.where(path == "cold"), lambda rows, _: write_cold(rows, f"{out_root}/cold", batch_id),
                                      f"{out_root}/dead_letter", batch_id)
        _write_partition(spark.createDataFrame([(done["rows"], done["attempts"], done["dead_lettered"], done["error"])],
                                               "rows long, attempts int, dead_lettered long, error string"),
                         f"{out_root}/accounting", batch_id)
        judged = routed.select(ARRIVED, "passed", "effective_path").unionByName(
            v.where(~F.col("passed") & readable).select(ARRIVED, "passed", F.lit(None).cast("string").alias("effective_path")))
        write_interval_stats(judged, batch_id, f"{out_root}/stats", interval_ms=interval_ms)
        numbers = {**counted, **sent, "rows_flushed": done["rows"] - done["dead_lettered"], "rows_dead_lettered": done["dead_lettered"]}
        _write_partition(spark.createDataFrame([tuple(int(numbers[k] or 0) for k in COUNTERS)], ", ".join(f"{k} long" for k in COUNTERS)),
                         f"{out_root}/counters", batch_id)

    writer = dedup_stream(flagged, sink, f"{out_root}/_seen", ttl_ms=ttl_ms, order_cols=order_cols)
    return micro_batches(writer.option("checkpointLocation", checkpoint), available_now=available_now).start()


def stream_counters(spark: SparkSession, out_root: str) -> DataFrame:
    """Q14, R10 and K9 of a ``run_stream`` so far: one row, summed over its micro-batches. A replayed batch replaced its numbers, and a restarted
    query counts on."""
    schema = ", ".join(f"{k} long" for k in COUNTERS)
    return spark.read.schema(schema).parquet(f"{out_root}/counters") \
        .agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in COUNTERS])


# ------------------------------------------------------------------------------------------------ interval statistics

def write_interval_stats(rows: DataFrame, batch_id: int, root: str, interval_ms: int = INTERVAL_MS,
                         path_col: str = "effective_path") -> DataFrame:
    """T3 inside ``foreachBatch``: the batch's counts by arrival interval (``root/intervals``) and the totals up to it (``root/totals``),
    which is also what it returns. Everything a batch counts is written with the batch, so no interval is left open at the end."""
    from keelson.plans.joins import materialize_observed
    from keelson.sinks.writers import _write_partition
    spark = rows.sparkSession
    per, added = materialize_observed(interval_counts(rows, ARRIVED, interval_ms, path_col), "intervals",
                                      **{m: F.coalesce(F.sum(m), F.lit(0)) for m in INTERVAL_METRICS})
    _write_partition(per, f"{root}/intervals", batch_id)
    prior = read_state(spark, f"{root}/totals", batch_id)
    before = prior.first() if prior is not None else dict.fromkeys(INTERVAL_METRICS, 0)
    totals = spark.createDataFrame([tuple(int(before[m] + added[m]) for m in INTERVAL_METRICS)], ", ".join(f"{m} long" for m in INTERVAL_METRICS))
    write_state(totals.coalesce(1), f"{root}/totals", batch_id)
    return totals


def interval_stats_stream(routed_stream: DataFrame, root: str, arrived: Column | None = None, interval_ms: int = INTERVAL_MS,
                          path_col: str = "effective_path"):
    """T3 on a stream of judged rows (``passed``, ``path_col``): the DataStreamWriter, to be given a checkpoint and a trigger and started.

    Rows are counted by arrival: ``arrived`` (ms; a topic's timestamp, say) or else the time of their micro-batch. Counts of an interval add up over
    batches, in whatever order it is met, so nothing is late and every row is counted once. Read with ``interval_totals``.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession, f"{root}/_work"):
            write_interval_stats(batch, batch_id, root, interval_ms, path_col)

    return _arriving(routed_stream, arrived).writeStream.foreachBatch(run).outputMode("append")


def interval_totals(spark: SparkSession, root: str) -> DataFrame:
    """The intervals written so far, with running totals, as ``operators.stats.interval_stats`` gives them for a table."""
    per = spark.read.parquet(f"{root}/intervals").groupBy("interval_start").agg(*[F.sum(m).cast("long").alias(m) for m in INTERVAL_METRICS])
    return running_totals(per)


class ProgressStats:
    """T3 for running streams: a listener that keeps each micro-batch's progress.

    ``rows`` holds the last (batch_id, input rows, processed rows per second); ``totals``
    gives cumulative counts, the streaming counterpart of the periodic stats line.
    """

    def __init__(self, spark: SparkSession):
        from pyspark.sql.streaming import StreamingQueryListener

        from collections import deque
        rows = self.rows = deque(maxlen=1000)       # the latest progress; totals are kept apart
        sums = self.sums = {"batches": 0, "input_rows": 0}

        class _Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                p = event.progress
                rows.append((p.batchId, p.numInputRows, p.processedRowsPerSecond))
                sums["batches"] += 1
                sums["input_rows"] += p.numInputRows

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                pass

        self._listener = _Listener()
        self._spark = spark
        spark.streams.addListener(self._listener)

    def totals(self) -> dict:
        return dict(self.sums)

    def close(self) -> None:
        self._spark.streams.removeListener(self._listener)

"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or views Spark derives from them) in
full.  Binary values are returned as hex, hashes as hex strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.fnv import fnv1a64_hex
from keelson.operators import stats
from keelson.operators.breaker import breaker_timeline
from keelson.operators.dedup import dedup_first
from keelson.operators.dedup_seq import dedup_idle_ttl, dedup_last_n
from keelson.operators.drift import drift_filter, rolling_median
from keelson.operators.quality import (flag_platform, quality_counters, quality_verdict, sign_events,
                                       split_payload_cols, verify_hmac)
from keelson.operators.ring import assign_tenant, build_ring, members, moved_keys, ring_lookup
from keelson.operators.route import classify_path, route_stats
from keelson.plans.joins import materialize
from keelson.plans.pipeline import run_batch
from keelson.session import scratch_path
from keelson.sinks.writers import (project_cold, project_hot, replay_dead_letter, to_dead_letter_json,
                                   write_cold, write_with_dead_letter)
from keelson.sources import fixtures as fx
from keelson.sources.codec import decode_events, encode_events
from keelson.sources.ingest import admit_events, batch_acks, filter_compatible, union_sources

SECRET = fx.TEST_SECRET
HOT_STORE_UP_SQL = "pmod(ts div 60000, 60) >= 3"   # the hot store is down 3 minutes each hour

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _arr(spark, sf):
    return fx.arrivals(spark, sf, SECRET)


def _wire(spark, sf) -> DataFrame:
    arr = _arr(spark, sf)
    trunc = F.pmod(F.substring("event_id", 2, 20).cast("bigint"), F.lit(71)) == 9
    enc = encode_events(arr, keep=("seq", "event_id"))
    cut = F.when(trunc, F.substring("wire", F.lit(1), F.octet_length("wire") - 1)).otherwise(F.col("wire"))
    return enc.withColumn("wire", cut).drop("event_id")


def _routed(spark, sf, wire: bool = False) -> DataFrame:
    src = _wire(spark, sf) if wire else _arr(spark, sf)
    return run_batch(src, SECRET, wire_col="wire" if wire else None, hot_write_ok=F.expr(HOT_STORE_UP_SQL))


# ---------------------------------------------------------------- ingest
@query("admit_events")
def q_admit_events(spark, sf):
    df = admit_events(fx.big_payloads(spark, sf))
    return df.select("doc_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), "admitted", "message")


@query("admit_batches")
def q_admit_batches(spark, sf):
    acks = batch_acks(fx.batches(spark, sf))
    return acks.select("batch_id", "n_events", "accepted", "success", "message")


@query("codec_roundtrip")
def q_codec(spark, sf):
    dec = decode_events(_wire(spark, sf), "wire", keep=("seq",))
    return dec.select("seq", "decode_ok", "event_id", "user_id", "platform", "event_type", "ts",
                      F.hex("payload").alias("payload_hex"))


@query("filter_compatible")
def q_filter_compatible(spark, sf):
    """The table form: versions seen, with their compatibility, met by a semi join."""
    rows = fx.versions(spark, sf)
    table = rows.select(F.col("schema_version").alias("version")).distinct().withColumn("compatible", F.col("version").between(1, 3))
    return filter_compatible(rows, versions=table).select("seq", "schema_version")


@query("union_sources")
def q_union(spark, sf):
    arr = _arr(spark, sf).select("seq", "event_id")
    rpc = arr.where(F.pmod("seq", F.lit(4)) < 2)
    topic = arr.where(F.pmod("seq", F.lit(4)) >= 2)
    return union_sources(rpc, topic, tags=["rpc", "topic"])


# ---------------------------------------------------------------- quality
@query("dedup_first")
def q_dedup_first(spark, sf):
    return dedup_first(_arr(spark, sf).select("event_id", "seq")).select("event_id", "seq", "dedup_ok")


@query("dedup_idle_ttl")
def q_dedup_idle(spark, sf):
    df = fx.idle_arrivals(spark, sf).select("event_id", "seq", "t")
    return dedup_idle_ttl(df).select("event_id", "seq", "t", "dedup_ok")


@query("dedup_last_n")
def q_dedup_last_n(spark, sf):
    """A FIFO small enough to evict, replayed in several blocks."""
    rows = _arr(spark, sf).select("event_id", "seq")
    return dedup_last_n(rows, n=100, block_rows=4096).select("event_id", "seq", "dedup_ok")


def _survivors(spark, sf):
    d = materialize(dedup_first(_arr(spark, sf).select("event_id", "seq", "ts")))
    return d.where("dedup_ok").select("seq", "ts")


@query("rolling_median")
def q_rolling_median(spark, sf):
    return rolling_median(_survivors(spark, sf)).select("seq", "ts", "median", "window_rows")


@query("drift_filter")
def q_drift(spark, sf):
    return drift_filter(_survivors(spark, sf)).select("seq", "ts", "drift_ok")


@query("hmac_sign")
def q_hmac_sign(spark, sf):
    ev = fx.table(spark, sf, "events")
    unsigned = ev.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
                         F.concat(F.lit("acct-"), F.col("user_id").cast("string")).alias("user_id"),
                         "event_type",
                         (F.lit(fx.BASE_TS_MS) + F.col("event_id") * 1000).cast("bigint").alias("ts"),
                         F.encode("props", "utf-8").alias("payload"))
    return sign_events(unsigned, SECRET).select("event_id", F.hex("payload").alias("payload_hex"))


@query("hmac_verify")
def q_hmac_verify(spark, sf):
    return verify_hmac(_arr(spark, sf), SECRET).select("event_id", "seq", "hmac_ok")


@query("split_payload")
def q_split(spark, sf):
    df = split_payload_cols(_arr(spark, sf))
    return df.select("seq", F.hex("body").alias("body_hex"), F.hex("mac").alias("mac_hex"))


@query("flag_platform")
def q_platform(spark, sf):
    return flag_platform(_arr(spark, sf)).select("seq", "platform", "platform_known")


@query("quality_verdict")
def q_verdict(spark, sf):
    return quality_verdict(_arr(spark, sf), SECRET).select("event_id", "seq", "passed", "stage", "reason")


@query("quality_counters")
def q_counters(spark, sf):
    return quality_counters(quality_verdict(_arr(spark, sf), SECRET))


@query("classify_path")
def q_classify(spark, sf):
    return classify_path(_arr(spark, sf)).select("seq", "event_type", "path")


# ---------------------------------------------------------------- ring
def _supplier_members(spark, sf):
    return fx.table(spark, sf, "supplier").select(F.col("s_name").alias("node"), "s_suppkey")


@query("fnv1a64")
def q_fnv(spark, sf):
    return fx.ring_keys(spark, sf).select("key", fnv1a64_hex("key").alias("hash"))


@query("build_ring")
def q_build_ring(spark, sf):
    return build_ring(_supplier_members(spark, sf)).select("hash", "node", "vnode")


@query("ring_lookup")
def q_ring_lookup(spark, sf):
    ring = build_ring(_supplier_members(spark, sf))
    return ring_lookup(fx.ring_keys(spark, sf), ring, "key", "node").select("key", "node")


@query("moved_keys")
def q_moved(spark, sf):
    mem = _supplier_members(spark, sf)
    before = build_ring(mem)
    after = build_ring(mem.where(F.col("s_suppkey") != 1))
    return moved_keys(fx.ring_keys(spark, sf), before, after).select("key", "node_before", "node_after")


@query("assign_tenant")
def q_assign(spark, sf):
    ring = build_ring(members(spark, ("tenant_a", "tenant_b", "tenant_c")))
    return assign_tenant(_arr(spark, sf).select("seq", "user_id"), ring).select("seq", "user_id", "tenant")


# ---------------------------------------------------------------- routing
@query("breaker_timeline")
def q_breaker(spark, sf):
    tl = breaker_timeline(fx.outcomes(spark, sf), failure_threshold=5, timeout_ms=86400000, success_threshold=2)
    return tl.select("sink", "seq", "allowed", "state", "failure_count", "success_count")


@query("breaker_blocks")
def q_breaker_blocks(spark, sf):
    """All calls on one hot sink, replayed in blocks whose entry states come from the parallel prefix scan."""
    calls = fx.outcomes(spark, sf).withColumn("sink", F.lit("hot"))
    tl = breaker_timeline(calls, failure_threshold=5, timeout_ms=86400000, success_threshold=2, method="blocks", block_rows=256)
    return tl.select("sink", "seq", "allowed", "state", "failure_count", "success_count")


@query("hot_with_fallback")
def q_fallback(spark, sf):
    return _routed(spark, sf).where("passed").select("seq", "path", "fallback", "effective_path")


@query("route_stats")
def q_route_stats(spark, sf):
    return route_stats(_routed(spark, sf).where("passed"))


# ---------------------------------------------------------------- sinks
def _effective(spark, sf, path):
    return _routed(spark, sf).where(F.col("passed") & (F.col("effective_path") == path))


@query("project_hot")
def q_project_hot(spark, sf):
    return project_hot(_effective(spark, sf, "hot"))


@query("project_cold")
def q_project_cold(spark, sf):
    return project_cold(_effective(spark, sf, "cold"))


@query("dead_letter_json")
def q_dead_letter(spark, sf):
    return to_dead_letter_json(_effective(spark, sf, "cold"))


@query("replay_dead_letter")
def q_replay(spark, sf):
    """Cold rows of 8 batches, written in one job; batch 3 fails every attempt and is dead-lettered, then replayed."""
    cold = materialize(_effective(spark, sf, "cold").withColumn("_b", F.pmod(F.expr("seq div 2"), F.lit(8)).cast("int")))
    cold_path, dl_path = scratch_path(spark, "cold"), scratch_path(spark, "dead-letter")

    def down(rows, attempt):
        raise IOError("cold store unavailable")

    write_cold(cold.where("_b <> 3"), cold_path, F.col("_b"))
    write_with_dead_letter(cold.where("_b = 3"), down, dl_path, 3, pause_s=0.0)
    return replay_dead_letter(spark, dl_path, spark.read.parquet(cold_path))


# ---------------------------------------------------------------- stats
@query("latency_stats")
def q_latency(spark, sf):
    return stats.latency_stats(fx.samples(spark, sf), "latency_us", ["event_type"])


SKETCH_ERROR = 0.005


@query("latency_sketch")
def q_latency_sketch(spark, sf):
    """T1 from sketches of ten batches, merged: every percentile's true rank is within the stated error."""
    samples = materialize(fx.samples(spark, sf))
    batches = samples.withColumn("batch", F.pmod("seq", F.lit(10)))
    merged = stats.merge_latency_sketches(stats.latency_sketch(batches, "latency_us", ["event_type", "batch"]), ["event_type"])
    found = stats.latency_from_sketch(merged)
    errors = stats.rank_errors(samples, found, "latency_us", ["event_type"])
    return errors.select("event_type", "n", "avg", "max", *[(F.col(f"{p}_error") <= SKETCH_ERROR).alias(f"{p}_ok") for p, _, _ in stats.PERCENTILES])


@query("throughput")
def q_throughput(spark, sf):
    return stats.throughput(fx.samples(spark, sf), "t", "latency_us")


@query("interval_stats")
def q_interval(spark, sf):
    routed = _routed(spark, sf).where(F.col("stage") != "decode")
    return stats.interval_stats(routed, "ts", 5000)


@query("run_batch")
def q_run_batch(spark, sf):
    return _routed(spark, sf, wire=True).select("seq", "event_id", "passed", "stage", "tenant", "path",
                                                "effective_path")


# ---------------------------------------------------------------- streaming
STREAM_RANGES = 4


def _arrivals_stream(spark, sf):
    return _seq_stream(spark, _arr(spark, sf))


def _seq_stream(spark, rows, drop: tuple[str, ...] = ()):
    """Rows written as seq-ordered file groups; one group per micro-batch (availableNow)."""
    from keelson.session import default_parallelism
    src = scratch_path(spark, "stream-src")
    rows = materialize(rows)
    top = rows.agg(F.max("seq").alias("m")).first()["m"] or 0
    step = top // STREAM_RANGES + 1
    files = default_parallelism(spark)
    for i in range(STREAM_RANGES):
        part = rows.where((F.col("seq") >= i * step) & (F.col("seq") < (i + 1) * step)).drop(*drop)
        part.repartition(files).write.mode("append").parquet(src)
    return spark.readStream.schema(rows.drop(*drop).schema).option("maxFilesPerTrigger", files).parquet(src)


def _drain(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _run(spark, writer, name: str) -> None:
    _drain(writer.option("checkpointLocation", scratch_path(spark, name)).trigger(availableNow=True).start())


@query("dedup_stream")
def q_dedup_stream(spark, sf):
    from keelson.sinks.writers import _write_partition
    from keelson.streaming.ops import dedup_stream
    out, state = scratch_path(spark, "q4-out"), scratch_path(spark, "q4-state")

    def sink(rows, batch_id):
        _write_partition(rows.select("event_id", "seq", "dedup_ok"), out, batch_id)

    _run(spark, dedup_stream(_arrivals_stream(spark, sf).select("event_id", "seq"), sink, state), "q4-ck")
    return spark.read.parquet(out).select("event_id", "seq", "dedup_ok")


@query("drift_stream")
def q_drift_stream(spark, sf):
    """The window over all micro-batches, each evaluated in parallel blocks."""
    from keelson.sinks.writers import _write_partition
    from keelson.streaming.ops import dedup_stream, drift_micro_batch
    out, state = scratch_path(spark, "q7-out"), scratch_path(spark, "q7-state")

    def sink(rows, batch_id):
        flagged = drift_micro_batch(rows.where("dedup_ok").drop("dedup_ok"), batch_id, f"{state}/tail")
        _write_partition(flagged.select("event_id", "drift_ok"), out, batch_id)

    _run(spark, dedup_stream(_arrivals_stream(spark, sf).select("event_id", "ts", "seq"), sink, state), "q7-ck")
    return spark.read.parquet(out).select("event_id", "drift_ok")


@query("interval_stats_stream")
def q_interval_stream(spark, sf):
    """T3 by arrival on a stream of judged rows whose event times are hostile and whose batches overlap in arrival time."""
    from keelson.streaming.ops import interval_stats_stream, interval_totals
    judged = _routed(spark, sf).where(F.col("stage") != "decode").select(
        "seq", "passed", "effective_path", F.when(F.pmod("seq", F.lit(50)) == 0, F.lit(2**62)).otherwise(F.col("ts")).alias("ts"),
        (F.col("seq") * 100 - F.pmod("seq", F.lit(7)) * 9000).alias("t"))
    root = scratch_path(spark, "t3")
    _run(spark, interval_stats_stream(_seq_stream(spark, judged), root, arrived=F.col("t")), "t3-ck")
    return interval_totals(spark, root)


@query("run_stream")
def q_run_stream(spark, sf):
    """From wire bytes to verdicts, with default arguments: every message in, one verdict out."""
    from keelson.streaming.ops import run_stream
    out, ck = scratch_path(spark, "p2-out"), scratch_path(spark, "p2-ck")
    _drain(run_stream(_seq_stream(spark, _wire(spark, sf)), SECRET, out, ck, available_now=True, wire_col="wire"))
    return spark.read.parquet(f"{out}/verdict").select("seq", "event_id", "passed", "stage", "reason")


@query("stream_counters")
def q_stream_counters(spark, sf):
    """Q14, R10 and K9 gathered by the running stream, batch by batch."""
    from keelson.streaming.ops import run_stream, stream_counters
    out, ck = scratch_path(spark, "q14-out"), scratch_path(spark, "q14-ck")
    _drain(run_stream(_seq_stream(spark, _wire(spark, sf)), SECRET, out, ck, available_now=True, wire_col="wire",
                      hot_write_ok=F.expr(HOT_STORE_UP_SQL)))
    return stream_counters(spark, out)


@query("engine_counters")
def q_engine_counters(spark, sf):
    """Q14 at engine level: quality counters plus decode failures (wire input with truncated rows)."""
    routed = _routed(spark, sf, wire=True)
    return quality_counters(routed.where(F.col("stage") != "decode"), routed.where(F.col("stage") == "decode"))


# ---------------------------------------------------------------- sources and sinks by file
@query("event_files")
def q_event_files(spark, sf):
    """Events written and read back with the fixed schema, as a table."""
    from keelson.sources.ingest import read_event_files
    path = scratch_path(spark, "event-files")
    _arr(spark, sf).drop("seq").write.parquet(path)
    return read_event_files(spark, path).select("event_id", "user_id", "platform", "event_type", "ts", F.hex("payload").alias("payload_hex"))


@query("event_topic")
def q_event_topic(spark, sf):
    """I1 in its file form: messages with the topic's partition, offset and timestamp, from which the stream makes its order."""
    from keelson.sources.ingest import read_event_topic
    from keelson.streaming.ops import run_stream
    out, ck = scratch_path(spark, "i1-out"), scratch_path(spark, "i1-ck")
    messages = _wire(spark, sf).select(
        F.col("wire").alias("value"), F.pmod(F.expr("seq div 2"), F.lit(4)).cast("int").alias("partition"), F.col("seq").alias("offset"),
        F.timestamp_millis(F.lit(fx.BASE_TS_MS) + F.expr("seq div 8") * 1000).alias("timestamp"), "seq")
    files = _seq_stream(spark, messages, drop=("seq",))
    stream = read_event_topic(spark, "", "", "", fmt="parquet", rows=files)
    _drain(run_stream(stream, SECRET, out, ck, available_now=True, wire_col="value", order_cols=("timestamp", "partition", "offset")))
    return spark.read.parquet(f"{out}/verdict").select("seq", "event_id", "passed", "stage")


@query("split_paths")
def q_split_paths(spark, sf):
    """R2: the two branches of the router."""
    from keelson.operators.route import split_paths
    hot, cold = split_paths(classify_path(_arr(spark, sf)), "path")
    return hot.select("seq", F.lit("hot").alias("branch")).unionByName(cold.select("seq", F.lit("cold").alias("branch")))


@query("write_hot")
def q_write_hot(spark, sf):
    """K2: the hot log read back, entry ids included."""
    from keelson.sinks.writers import write_hot
    path = scratch_path(spark, "hot-log")
    write_hot(_arr(spark, sf), path, 7)
    return spark.read.parquet(path).select("log_id", "event_id", "user_id", "event_type", "platform", "ts")


@query("flush_accounting")
def q_flush_accounting(spark, sf):
    """K9: rows counted by the write itself."""
    from keelson.sinks.writers import flush_accounting
    rows, seen = flush_accounting(_arr(spark, sf).select("seq", "event_type"), scratch_path(spark, "flush").rsplit("/", 1)[1])
    rows.write.parquet(scratch_path(spark, "flushed"))
    return spark.createDataFrame([(int(seen.get["rows"]),)], "rows_written long")

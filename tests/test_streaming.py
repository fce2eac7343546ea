from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators.quality import quality_verdict
from keelson.session import scratch_path
from keelson.sources.fixtures import TEST_SECRET, arrivals
from keelson.streaming.ops import ProgressStats, run_stream
from keelson.schema import EVENT
from event_tables import SF_SMALL


def test_untrusted_times_lose_no_row(spark):
    """An event dated ten years ahead and a +-2 h spread: every row gets a verdict, with default arguments."""
    arr = arrivals(spark, SF_SMALL).where("seq < 400")
    far = arr.limit(1).withColumns({"event_id": F.lit("far"), "ts": F.lit(2_000_000_000_000), "seq": F.lit(1)})
    hostile = arr.limit(1).withColumns({"event_id": F.lit("max"), "ts": F.lit(2**63 - 1), "seq": F.lit(3)})
    rows = arr.unionByName(far).unionByName(hostile)
    src = scratch_path(spark, "stream-src-far")
    for lo, hi in [(0, 100), (100, 10**9)]:
        rows.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = scratch_path(spark, "stream-out-far")
    run_stream(stream, TEST_SECRET, out, scratch_path(spark, "stream-ck-far"), available_now=True).awaitTermination(600)
    verdict = spark.read.parquet(f"{out}/verdict")
    assert sorted(r.seq for r in verdict.select("seq").collect()) == sorted(r.seq for r in rows.select("seq").collect())
    assert spark.read.parquet(f"{out}/hot").columns[-2] == "log_id"


def test_stream_equals_batch(spark):
    arr = arrivals(spark, SF_SMALL)
    src = scratch_path(spark, "stream-src")
    # files in seq order: one micro-batch per file
    for i, (lo, hi) in enumerate([(0, 700), (700, 1400), (1400, 10**9)]):
        arr.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(src)
    schema = T.StructType(list(EVENT.fields) + [T.StructField("seq", T.LongType())])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    stats = ProgressStats(spark)
    q = run_stream(stream, TEST_SECRET, out, ck, available_now=True)
    q.awaitTermination(600)
    import time
    time.sleep(2)                      # listener events arrive asynchronously
    stats.close()
    assert stats.totals()["input_rows"] == arr.count()
    got = {r.seq: (r.passed, r.stage) for r in spark.read.parquet(f"{out}/verdict").collect()}
    batch = quality_verdict(arr, TEST_SECRET)
    exp = {r.seq: (r.passed, r.stage) for r in batch.collect()}
    assert got == exp
    cold = spark.read.parquet(f"{out}/cold").count()
    hot = spark.read.parquet(f"{out}/hot").count()
    assert hot + cold == sum(1 for p, _ in got.values() if p)


def test_stream_breaker_state_equals_batch(spark):
    from keelson.plans.catalog import HOT_STORE_UP_SQL
    from keelson.plans.pipeline import run_batch
    arr = arrivals(spark, SF_SMALL)
    src = scratch_path(spark, "stream-src-b")
    # the hot store is down for the first 3 minutes (n < 180): batch 2 starts inside the outage
    for lo, hi in [(0, 200), (200, 1400), (1400, 10**9)]:
        arr.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(src)
    schema = T.StructType(list(EVENT.fields) + [T.StructField("seq", T.LongType())])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, ck = scratch_path(spark, "stream-out-b"), scratch_path(spark, "stream-ck-b")
    q = run_stream(stream, TEST_SECRET, out, ck, available_now=True,
                   hot_write_ok=F.expr(HOT_STORE_UP_SQL))
    q.awaitTermination(600)
    got = {r.seq: r.effective_path for r in spark.read.parquet(f"{out}/routes").collect()}
    batch = run_batch(arr, TEST_SECRET, hot_write_ok=F.expr(HOT_STORE_UP_SQL)).where("passed")
    exp = {r.seq: r.effective_path for r in batch.collect()}
    assert got == exp
    assert sum(1 for p in exp.values() if p == "cold") > 0


def _arriving(spark, rows, now):
    """(event_id, seq, decode_ok) rows of one micro-batch that arrives at ``now``."""
    return spark.createDataFrame([(*r, now) for r in rows], "event_id string, seq long, decode_ok boolean, arrived_ms long")


def _flags_of(df):
    return {r.seq: r.dedup_ok for r in df.collect()}


def _id_model(batches, ttl):
    """Batches of (now, rows): an id is remembered for ``ttl`` after it was accepted."""
    until, out = {}, {}
    for now, rows in batches:
        for event_id, seq, ok in sorted(rows, key=lambda r: r[1]):
            key = "" if event_id is None else event_id
            fresh = bool(ok) and until.get(key, -1) <= now
            if fresh:
                until[key] = now + ttl
            out[seq] = fresh
    return out


def test_accepted_ids_equal_model(spark, monkeypatch):
    """Expiry by generation, merged files, replays of a batch, null and hostile ids, unreadable rows."""
    import random

    from keelson.streaming import state
    monkeypatch.setattr(state, "COMPACT_AFTER", 2)
    monkeypatch.setattr(state, "FEW_BUCKETS", 6)
    rnd, root, now, seq, batches, got = random.Random(3), scratch_path(spark, "ids"), 1_000_000, 0, [], {}
    for batch_id in range(14):
        now += rnd.choice([10, 50, 400])
        rows = []
        for _ in range(rnd.randint(1, 12)):
            rows.append((rnd.choice([None, "", "\x00unreadable-x", *(f"e{k}" for k in range(9))]), seq, rnd.choice([True, True, True, False, None])))
            seq += 1
        batches.append((now, rows))
        for attempt in range(1 + batch_id % 2):         # every other batch is replayed as a whole
            flags = _flags_of(state.first_arrivals(_arriving(spark, rows, now), batch_id, root, ttl_ms=1000))
            assert attempt == 0 or flags == {s: got[s] for s in flags}
            got |= flags
    assert got == _id_model(batches, 1000)
    assert len(state.child_names(spark, root)) <= 2 * state.GENERATIONS + 1


def test_repeated_ids_inside_a_batch_and_no_seq(spark):
    from keelson.streaming.state import first_arrivals
    rows = [("a", 5, True), ("a", 3, True), ("b", 4, True), ("a", 3, True)]
    root = scratch_path(spark, "ids")
    got = first_arrivals(_arriving(spark, rows, 10), 0, root).select("event_id", "seq", "dedup_ok").collect()
    assert sorted((r.event_id, r.seq) for r in got if r.dedup_ok) == [("a", 3), ("b", 4)]
    unordered = _arriving(spark, rows, 20).drop("seq")
    again = first_arrivals(unordered.unionByName(unordered.limit(1).withColumn("event_id", F.lit("c"))), 1, root).collect()
    assert [r.event_id for r in again if r.dedup_ok] == ["c"]
    assert first_arrivals(unordered.limit(0), 2, root).collect() == []


def _stream_of(spark, groups, schema):
    src = scratch_path(spark, "src")
    for rows in groups:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_interval_stats_count_every_row(spark):
    """Six files ten minutes apart, one hostile time, event times and arrivals out of order: as many rows counted as came in."""
    from keelson.streaming.ops import interval_stats_stream, interval_totals
    for extra in ([], [(2**62, True, "hot", 5)]):
        groups = [[((g * 600 + k) * 1000 * (-1) ** k, k % 3 > 0, "hot" if k % 2 else "cold", g * 60_000 - k * 7000) for k in range(20)] for g in range(6)]
        groups[2] += extra
        stream = _stream_of(spark, groups, "ts long, passed boolean, effective_path string, t long")
        for arrived in (None, F.col("t")):
            root = scratch_path(spark, "t3")
            interval_stats_stream(stream, root, arrived).option("checkpointLocation", scratch_path(spark, "ck")) \
                .trigger(availableNow=True).start().awaitTermination(300)
            rows = interval_totals(spark, root).orderBy("interval_start").collect()
            assert sum(r.routed + r.rejected for r in rows) == 120 + len(extra)
            assert (rows[-1].total_hot + rows[-1].total_cold, rows[-1].total_rejected) == (78 + len(extra), 42)
            state = spark.read.parquet(f"{root}/totals/batch_id=5").first()
            assert state.routed == rows[-1].total_routed and state.rejected == 42
            if arrived is not None:
                flat = [r for g in groups for r in g]
                assert [r.interval_start for r in rows] == sorted({t - t % 5000 for _, _, _, t in flat})


def test_counters_survive_a_restart(spark):
    """Two runs on one checkpoint count together what one batch run counts."""
    from keelson.plans.catalog import _wire
    from keelson.operators.quality import quality_counters
    from keelson.plans.pipeline import run_batch
    from keelson.streaming.ops import interval_totals, stream_counters
    from keelson.plans.joins import materialize
    wire = materialize(_wire(spark, SF_SMALL))
    src, out, ck = (scratch_path(spark, n) for n in ("src", "out", "ck"))
    for lo, hi in [(0, 900), (900, 10**9)]:
        wire.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(wire.schema).parquet(src)
        run_stream(stream, TEST_SECRET, out, ck, available_now=True, wire_col="wire").awaitTermination(600)
    routed = run_batch(wire, TEST_SECRET, wire_col="wire")
    want = quality_counters(routed.where("stage <> 'decode'"), routed.where("stage = 'decode'")).first().asDict()
    got = stream_counters(spark, out).first().asDict()
    assert {k: got[k] for k in want} == want
    assert got["hot_count"] + got["cold_count"] == want["passed"] and got["rows_flushed"] == spark.read.parquet(f"{out}/cold").count()
    last = interval_totals(spark, f"{out}/stats").orderBy(F.desc("interval_start")).first()
    assert last.total_routed == want["passed"] and last.total_rejected == want["rejected"]


def test_order_from_several_columns(spark):
    """seq counts on over batches; a replay gives the same numbers."""
    from keelson.streaming.state import arrival_seq
    root, cols = scratch_path(spark, "order"), ("timestamp", "partition", "offset")
    ddl = "timestamp long, partition int, offset long"
    one, two = [(5, 1, 9), (5, 0, 8), (4, 3, 1)], [(1, 0, 3), (1, 0, 2)]
    for _ in range(2):
        got = arrival_seq(spark.createDataFrame(one, ddl), 0, root, cols).collect()
        assert {(r.timestamp, r.partition, r.offset): r.seq for r in got} == {(4, 3, 1): 0, (5, 0, 8): 1, (5, 1, 9): 2}
    for _ in range(2):
        got = arrival_seq(spark.createDataFrame(two, ddl), 1, root, cols).collect()
        assert {r.offset: r.seq for r in got} == {2: 3, 3: 4}
    assert arrival_seq(spark.createDataFrame([], ddl), 2, root, cols).collect() == []

from pyspark.sql import functions as F

from keelson.operators.breaker import breaker_timeline, breaker_totals
from keelson.operators.ring import add_tenant, build_ring, members, remove_tenant, ring_lookup, tenant_count, tenant_load
from keelson.operators.route import classify_path, hot_with_fallback, route_stats, split_paths
from keelson.session import scratch_path
from keelson.sinks.writers import flush_accounting, write_cold, write_hot
from keelson.sources.ingest import admit_batch_arrays, admitted_batch_rows, batch_acks, explode_accepted, union_sources

EV = "event_id string, user_id string, platform string, event_type string, ts bigint, seq bigint"


def test_write_hot_idempotent_with_log_ids(spark):
    df = spark.createDataFrame([("e1", "u", "web", "click", 5, 10), ("e2", "u", "ios", "view", 6, 11)], EV)
    path = scratch_path(spark, "hot")
    write_hot(df, path, 7)
    write_hot(df, path, 7)
    out = spark.read.parquet(path)
    assert out.count() == 2
    assert sorted(r.log_id for r in out.collect()) == ["7-10", "7-11"]
    assert dict(out.dtypes)["ts"] == "string"


def test_write_cold_sorted_and_flush_count(spark):
    df = spark.createDataFrame([("e2", "u", "web", "view", 9, 1), ("e1", "u", "web", "click", 9, 2),
                                ("e3", "u", "web", "click", 3, 3)], EV)
    observed, obs = flush_accounting(df)
    path = scratch_path(spark, "cold")
    write_cold(observed.coalesce(1), path, 1)
    assert obs.get["rows"] == 3
    assert [(r.ts, r.event_type) for r in spark.read.parquet(path).collect()] == [(3, "click"), (9, "click"), (9, "view")]


def test_batch_rows_admission(spark):
    rows = [("b1", i, 10 if i else 70000) for i in range(5)] + [("big", i, 10) for i in range(1001)]
    df = spark.createDataFrame(rows, "batch_id string, seq int, payload_size int")
    kept = admitted_batch_rows(df, batch_acks(df))
    assert sorted(r.seq for r in kept.collect()) == [1, 2, 3, 4]


def test_explode_accepted(spark):
    ev = ("e", "u", "web", "click", 1, b"x")
    schema = ("id int, events array<struct<event_id:string, user_id:string, platform:string, event_type:string, "
              "ts:bigint, payload:binary>>")
    df = spark.createDataFrame([(1, [ev, ev]), (2, [ev] * 1001)], schema)
    out = explode_accepted(admit_batch_arrays(df), keep=["id"])
    assert out.count() == 2 and set(out.columns) >= {"id", "event_id", "payload"}


def test_membership_edits(spark):
    import bisect
    from collections import Counter

    from keelson.functions.fnv import fnv1a64_py
    m = members(spark, ["tenant_a", "tenant_b"])
    m3 = add_tenant(m, "tenant_c")
    assert tenant_count(m3).first().tenant_count == 3
    assert tenant_count(remove_tenant(add_tenant(m3, "tenant_c"), "tenant_c")).first().tenant_count == 2
    keys = spark.range(300).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    load = {r.node: r.events for r in tenant_load(ring_lookup(keys, build_ring(m3), "key", "node"), "node").collect()}
    pts = sorted((fnv1a64_py(f"{n}#{i}"), n) for n in ("tenant_a", "tenant_b", "tenant_c") for i in range(150))

    def model(k):
        i = bisect.bisect_left(pts, (fnv1a64_py(k), ""))
        return pts[0 if i == len(pts) else i][1]
    assert load == dict(Counter(model(f"k{i}") for i in range(300)))


def test_breaker_totals_and_paths(spark):
    calls = spark.createDataFrame([("s", i, i * 10, i % 3 != 0) for i in range(30)], "sink string, seq bigint, t bigint, ok boolean")
    tl = breaker_timeline(calls, failure_threshold=2, timeout_ms=25, success_threshold=1)
    tot = breaker_totals(tl).first()
    assert tot.total_successes + tot.total_failures + tot.denied == 30
    ev = spark.createDataFrame([("e1", "click", True), ("e2", "signup", True), ("e3", "view", False)],
                               "event_id string, event_type string, delivered boolean")
    routed = hot_with_fallback(classify_path(ev), "delivered")
    hot, cold = split_paths(routed)
    assert [r.event_id for r in hot.collect()] == ["e1"]
    assert sorted(r.event_id for r in cold.collect()) == ["e2", "e3"]
    st = route_stats(routed).first()
    assert (st.hot_count, st.cold_count, st.hot_fallback_cold) == (2, 1, 1)


def test_union_sources_tags(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2,)], "x int")
    assert sorted(tuple(r) for r in union_sources(a, b, tags=["rpc", "topic"]).collect()) == [(1, "rpc"), (2, "topic")]

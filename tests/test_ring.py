import bisect
import random

from pyspark.sql import functions as F

from keelson.functions.fnv import fnv1a64_hex, fnv1a64_hex_native, fnv1a64_py
from keelson.operators.ring import build_ring, members, moved_keys, remove_tenant, ring_lookup


def _model(nodes, key, v=150):
    pts = sorted((fnv1a64_py(f"{n}#{i}"), n) for n in nodes for i in range(v))
    if not pts:
        return ""
    i = bisect.bisect_left(pts, (fnv1a64_py(key), ""))
    return pts[0 if i == len(pts) else i][1]


def test_fnv_known_and_non_ascii(spark):
    keys = ["", "a", "user_123", "é", "日本語", "\x7f\x80", "x" * 300]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for fn in (fnv1a64_hex, fnv1a64_hex_native):
        got = {r.k: r.h for r in df.select("k", fn("k").alias("h")).collect()}
        assert got[""] == "CBF29CE484222325"
        for k in keys:
            assert got[k] == "%016X" % fnv1a64_py(k)


def test_lookup_matches_model_and_is_stable(spark):
    nodes = ["tenant_a", "tenant_b", "tenant_c"]
    rnd = random.Random(3)
    keys = ["", "user_123", "é"] + [f"user_{rnd.randrange(10**6)}" for _ in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    ring = build_ring(members(spark, nodes))
    got = {r.key: r.node for r in ring_lookup(df, ring, "key").collect()}
    for k in keys:
        assert got[k] == _model(nodes, k)
    again = {r.key: r.node for r in ring_lookup(df, ring, "key").collect()}
    assert got == again and all(got.values())


def test_wrap_to_first_point(spark):
    nodes = ["node_a", "node_b"]
    pts = sorted((fnv1a64_py(f"{n}#{i}"), n) for n in nodes for i in range(150))
    top = pts[-1][0]
    rnd = random.Random(5)
    key = next(k for k in (f"k{rnd.random()}" for _ in range(200000)) if fnv1a64_py(k) > top)
    df = spark.createDataFrame([(key,)], "key string")
    assert ring_lookup(df, build_ring(members(spark, nodes)), "key").first().node == pts[0][1]


def test_empty_ring_gives_empty_string(spark):
    df = spark.createDataFrame([("k1",), ("",)], "key string")
    empty = build_ring(members(spark, []))
    assert {r.node for r in ring_lookup(df, empty, "key").collect()} == {""}


def test_removal_moves_only_removed_keys(spark):
    nodes = ["node_a", "node_b", "node_c"]
    m = members(spark, nodes)
    keys = spark.range(3000).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"))
    moved = moved_keys(keys, build_ring(m), build_ring(remove_tenant(m, "node_c"))).collect()
    assert moved and all(r.node_before == "node_c" for r in moved)
    after = build_ring(remove_tenant(m, "node_c"))
    assert ring_lookup(spark.createDataFrame([("key1",)], "key string"), after, "key").first().node

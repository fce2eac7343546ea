"""Findings of round 3: large sides are not broadcast, memory and time keep step with the input."""

import bisect

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from keelson.functions.fnv import fnv1a64_py
from keelson.operators import ring
from keelson.plans.pipeline import hot_delivery
from keelson.streaming.state import first_arrivals


def _written_plans(monkeypatch) -> list[str]:
    """Plans of what is written as Parquet from now on."""
    plans, real = [], DataFrameWriter.parquet

    def parquet(self, *args, **kw):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real(self, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return plans


def test_large_ring_is_not_broadcast(spark, tmp_path, monkeypatch):
    """membership is a small file, its points and their bucket edges are not."""
    names = [f"node-{i}" for i in range(60)]
    spark.createDataFrame([(n,) for n in names], "node string").write.parquet(f"{tmp_path}/members")
    points = ring.build_ring(spark.read.parquet(f"{tmp_path}/members"))
    monkeypatch.setattr(ring, "BROADCAST_MAX_ROWS", 100)
    plans = _written_plans(monkeypatch)
    keys = [f"key-{i}" for i in range(300)]
    found = ring.ring_lookup(spark.createDataFrame([(k,) for k in keys], "key string"), points, "key")
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        assert "BroadcastHashJoin [_b#" not in plan and "BuildLeft" not in plan and "BroadcastHashJoin [_kb#" not in plan
    model = sorted((fnv1a64_py(f"{n}#{i}"), n) for n in names for i in range(150))
    for r in found.collect():
        at = bisect.bisect_left(model, (fnv1a64_py(r.key), ""))
        assert r.node == model[at % len(model)][1]


def test_known_calls_are_not_counted_again(spark, monkeypatch):
    """a micro-batch knows its hot calls; replaying them in blocks needs no pass that counts."""
    rows = spark.range(40).select(F.col("id").alias("seq"), F.col("id").alias("ts"), F.lit(True).alias("passed"), F.lit("hot").alias("path"))
    counted, real = [], type(rows).count
    monkeypatch.setattr(type(rows), "count", lambda self: counted.append(1) or real(self))
    out = hot_delivery(rows, F.col("seq") % 2 == 0, n_calls=40, block_rows=8)
    assert not counted
    assert out.agg(F.count_if("allowed")).first()[0] < 40


def test_accepted_ids_meet_a_batch_once(spark, tmp_path):
    """the flagged rows of a batch are read several times, so they are no join to be run again."""
    rows = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("a", 3, 5)], "event_id string, seq long, arrived_ms long")
    flagged = first_arrivals(rows, 0, f"{tmp_path}/ids")
    assert "Join" not in flagged._jdf.queryExecution().executedPlan().toString()
    assert {(r.seq, r.dedup_ok) for r in flagged.collect()} == {(1, True), (2, True), (3, False)}

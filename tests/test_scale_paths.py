"""The plans meant for large inputs, forced on small data and checked against the same oracles."""
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as E
from event_tables import SF_MID, SF_SMALL
from keelson.operators.drift import rolling_median, rolling_median_native
from keelson.operators.order import dense_index
from keelson.plans import catalog as C
from keelson.plans.pipeline import run_batch
from keelson.session import scratch_path
from keelson.sources.codec import decode_events, encode_events
from keelson.sources.ingest import read_event_topic
from oracle_check import digest, duck


def test_run_batch_scale_paths_match_oracle(spark):
    """Several seq ranges, small drift blocks and the block-parallel breaker inside the pipeline."""
    src = C._wire(spark, SF_MID)
    out = run_batch(src, C.SECRET, wire_col="wire", hot_write_ok=F.expr(C.HOT_STORE_UP_SQL),
                    breaker_block_rows=700, block_rows=1500, rows_per_range=2500)
    got = out.select("seq", "event_id", "passed", "stage", "tenant", "path", "effective_path")
    rows = [tuple(r) for r in got.collect()]
    res = duck(SF_MID).sql(E.oracle_sql()["run_batch"])
    assert digest(got.columns, rows)[0] == digest(res.columns, res.fetchall())[0]


def test_dense_index_ranges_and_partitions(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(4), s) for s in rnd.sample(range(100000), 5000)]
    df = spark.createDataFrame(rows, "shard int, seq bigint")
    got = {(r.shard, r.seq): r._idx for r in dense_index(df, "seq", ["shard"], rows_per_range=600).collect()}
    for sh in range(4):
        seqs = sorted(s for k, s in rows if k == sh)
        assert [got[(sh, s)] for s in seqs] == list(range(len(seqs)))


def test_per_shard_drift_equals_native(spark):
    rnd = random.Random(6)
    rows = [(rnd.randrange(3), i, rnd.randrange(10**6)) for i in range(3000)]
    df = spark.createDataFrame(rows, "shard int, seq bigint, ts bigint")
    a = {r.seq: r.median for r in rolling_median(df, window=50, partition_cols=["shard"], block_rows=200,
                                                 rows_per_range=700).collect()}
    b = {r.seq: r.median for r in rolling_median_native(df, window=50, partition_cols=["shard"]).collect()}
    assert a == b


def test_topic_source_fallback_and_decode(spark):
    arr = C._arr(spark, SF_SMALL)
    path = scratch_path(spark, "topic")
    encode_events(arr, out_col="value").write.parquet(path)
    stream = read_event_topic(spark, "unused:9092", "event_stream", "group", fmt="parquet", path=path,
                              schema=T.StructType([T.StructField("value", T.BinaryType())]))
    out, ck = scratch_path(spark, "topic-out"), scratch_path(spark, "topic-ck")
    q = decode_events(stream, "value").writeStream.format("parquet").option("path", out) \
        .option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.where("decode_ok").count() == arr.count()
    assert got.select("event_id").distinct().count() == arr.select("event_id").distinct().count()


def test_composite_order_over_ranges(spark):
    """Three order columns, several ranges, a hot partition key and a NULL one."""
    rnd = random.Random(8)
    rows = list({(rnd.choice([None, 1, 1, 1, 2]), rnd.randrange(40), rnd.randrange(4), rnd.randrange(10**6)) for _ in range(4000)})
    df = spark.createDataFrame(rows, "shard int, ts int, part int, off int")
    got = dense_index(df, ["ts", "part", "off"], ["shard"], rows_per_range=300).collect()
    for shard in (None, 1, 2):
        mine = sorted(r[1:] for r in rows if r[0] == shard)
        assert sorted((r._idx, r.ts, r.part, r.off) for r in got if r.shard == shard) == [(k, *r) for k, r in enumerate(mine)]
    flat = dense_index(df.na.fill(0), ["ts", "part", "off", "shard"], rows_per_range=500)
    assert sorted(r._idx for r in flat.collect()) == list(range(len(rows)))


def test_many_ranges(spark):
    """More ranges than rows are asked for: empty ranges count nothing."""
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("seq"))
    got = dense_index(df, "seq", n_rows=10_000, rows_per_range=100).collect()
    assert all(r.seq == r._idx for r in got)


def test_idle_ttl_over_ranges(spark):
    from keelson.operators.dedup_seq import dedup_idle_ttl
    from keelson.sources.fixtures import idle_arrivals
    rows = idle_arrivals(spark, SF_SMALL).select("event_id", "seq", "t")
    whole = {r.seq: r.dedup_ok for r in dedup_idle_ttl(rows).collect()}
    split = {r.seq: r.dedup_ok for r in dedup_idle_ttl(rows, rows_per_range=150, block_rows=100).collect()}
    assert split == whole


def test_previous_rows_of_hot_and_null_keys(spark):
    """The self-join form equals the window form; NULL is a key."""
    from keelson.operators.order import previous_seq
    rnd = random.Random(4)
    rows = [(rnd.choice([None, "hot", "hot", "a"]), s) for s in rnd.sample(range(9999), 400)]
    df = spark.createDataFrame(rows, "event_id string, seq bigint")
    window, join = ({(r.event_id, r.seq): r._prev for r in previous_seq(df, ["event_id"], max_key_rows=n).collect()} for n in (10**6, 50))
    assert window == join and sum(v is None for v in window.values()) == 3

import json
import random

from pyspark.sql import functions as F

from keelson.operators.stats import latency_stats
from keelson.session import scratch_path
from keelson.sinks.writers import (read_dead_letters, replay_dead_letter, to_dead_letter_json, write_cold,
                                   write_with_dead_letter)

COLD = "event_id string, user_id string, event_type string, platform string, ts bigint"


def test_dead_letter_escaping(spark):
    df = spark.createDataFrame([('a"b', "c\\d", "x\ny", "t\tz", 5)], COLD)
    line = to_dead_letter_json(df).first().line
    assert list(json.loads(line).items()) == [("event_id", 'a"b'), ("user_id", "c\\d"), ("event_type", "x\ny"),
                                              ("platform", "t\tz"), ("ts", 5)]


def test_retry_dead_letter_replay_idempotent(spark):
    rows = [(f"e{i}", "u", "click", "web", i) for i in range(20)]
    df = spark.createDataFrame(rows, COLD)
    cold, dl = scratch_path(spark, "t-cold"), scratch_path(spark, "t-dl")
    calls = {"n": 0}

    def flaky(d, attempt):
        calls["n"] += 1
        if attempt < 3:
            raise IOError("down")
        write_cold(d, cold, 1)

    acc = write_with_dead_letter(df.where("ts < 10"), flaky, dl, 1, pause_s=0)
    assert acc == {"batch_id": 1, "rows": 10, "attempts": 3, "dead_lettered": 0, "error": "down"}
    again = write_with_dead_letter(df.where("ts < 10"), lambda d, _: write_cold(d, cold, 1), dl, 1, pause_s=0)
    assert again == {"batch_id": 1, "rows": 10, "attempts": 1, "dead_lettered": 0, "error": None}

    def dead(d, attempt):
        raise IOError("down")

    acc2 = write_with_dead_letter(df.where("ts >= 10"), dead, dl, 2, pause_s=0)
    assert acc2["dead_lettered"] == 10
    assert read_dead_letters(spark, dl).count() == 10
    table = spark.read.parquet(cold)
    todo = replay_dead_letter(spark, dl, table)
    assert sorted(r.ts for r in todo.collect()) == list(range(10, 20))
    write_cold(todo, cold, "replay-2")
    write_cold(todo, cold, "replay-2")        # a retry of the same batch does not duplicate
    assert spark.read.parquet(cold).count() == 20
    assert replay_dead_letter(spark, dl, spark.read.parquet(cold)).count() == 0


def _pmodel(xs):
    if not xs:
        return 0, 0, 0, 0, 0
    s, n = sorted(xs), len(xs)
    return s[n * 50 // 100], s[n * 95 // 100], s[n * 99 // 100], s[min(n - 1, n * 999 // 1000)], s[-1]


def test_percentiles_vs_model(spark):
    rnd = random.Random(8)
    for n in (1, 2, 3, 59, 100, 1000, 1001):
        xs = [rnd.randrange(10**6) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in xs] + [(-1,)], "latency_us bigint")
        r = latency_stats(df).first()
        assert (r.p50, r.p95, r.p99, r.p999, r.max) == _pmodel(xs), n
        assert r.n == n


def test_percentiles_empty_gives_zeros(spark):
    df = spark.createDataFrame([(-1,)], "latency_us bigint")
    r = latency_stats(df).first()
    assert (r.n, r.avg, r.p50, r.p99, r.max) == (0, 0.0, 0, 0, 0)


def test_merged_sketches_are_exact_while_small_and_bounded_when_large(spark):
    import random

    from keelson.operators import stats
    rnd = random.Random(2)
    rows = [(g, b, rnd.choice([-1, rnd.randrange(10**6)])) for g, n in (("a", 198), ("b", 1), ("c", 30_000), (None, 50)) for b in range(3) for _ in range(n // 3 + 1)]
    df = spark.createDataFrame(rows, "event_type string, batch int, latency_us long")
    merged = stats.merge_latency_sketches(stats.latency_sketch(df, group_cols=["event_type", "batch"]), ["event_type"])
    got = {r.event_type: r for r in stats.rank_errors(df, stats.latency_from_sketch(merged), group_cols=["event_type"]).collect()}
    want = {r.event_type: r for r in stats.latency_stats(df, group_cols=["event_type"]).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        errors = [r[f"{p}_error"] for p, _, _ in stats.PERCENTILES]
        assert max(errors) <= (0.005 if g == "c" else 0)
        if g in want:
            assert (r.n, r.max) == (want[g].n, want[g].max) and abs(r.avg - want[g].avg) < 0.01
    whole = stats.latency_from_sketch(stats.latency_sketch(df)).collect()
    assert len(whole) == 1 and whole[0].n == sum(v >= 0 for _, _, v in rows)
    assert stats.latency_from_sketch(stats.latency_sketch(df.limit(0))).collect() == []

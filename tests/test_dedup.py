import random
from collections import deque

from keelson.operators.dedup import dedup_first
from keelson.operators.dedup_seq import _last_n_blocks, dedup_idle_ttl, dedup_last_n


def _last_n_model(ids, n):
    fifo, seen, out = deque(), set(), []
    for i in ids:
        if i in seen:
            out.append(False)
            continue
        seen.add(i)
        fifo.append(i)
        if len(fifo) > n:
            seen.discard(fifo.popleft())
        out.append(True)
    return out


def _idle_model(rows, ttl):
    s, last, out = set(), None, []
    for i, t in rows:
        if last is not None and t - last >= ttl:
            s = set()
        if i in s:
            out.append(False)
        else:
            s.add(i)
            last = t
            out.append(True)
    return out


def _flags(df):
    return [r.dedup_ok for r in df.orderBy("seq").collect()]


def test_dedup_first(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 7)], "event_id string, seq bigint")
    assert _flags(dedup_first(df)) == [True, True, False, False]


def test_last_n_boundaries(spark):
    def run(ids, n):
        df = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "event_id string, seq bigint")
        return _flags(dedup_last_n(df, n))
    assert run(list("abcda"), 3) == [True, True, True, True, True]
    assert run(list("abca"), 3) == [True, True, True, False]


def test_last_n_random_vs_model(spark):
    rnd = random.Random(1)
    ids = [f"id{rnd.randrange(60)}" for _ in range(3000)]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "event_id string, seq bigint")
    assert _flags(dedup_last_n(df, 25)) == _last_n_model(ids, 25)
    shard = [(x, i, i % 3) for i, x in enumerate(ids)]
    sdf = spark.createDataFrame(shard, "event_id string, seq bigint, shard int")
    got = {r.seq: r.dedup_ok for r in dedup_last_n(sdf, 10, shard_cols=["shard"]).collect()}
    for s in range(3):
        sub = [(x, i) for x, i, sh in shard if sh == s]
        exp = _last_n_model([x for x, _ in sub], 10)
        assert [got[i] for _, i in sub] == exp


def test_idle_ttl_boundaries(spark):
    ttl = 1000
    rows = [("a", 0), ("b", 10), ("b", 10 + ttl - 1), ("a", 10 + ttl), ("a", 10 + ttl + 1)]
    df = spark.createDataFrame([(x, i, t) for i, (x, t) in enumerate(rows)], "event_id string, seq bigint, t bigint")
    got = _flags(dedup_idle_ttl(df, ttl))
    # duplicate at ttl-1 fails and does not renew; at ttl after the last add the set is gone
    assert got == [True, True, False, True, False]


def test_idle_ttl_random_vs_model(spark):
    rnd = random.Random(9)
    for trial in range(3):
        t, rows = 0, []
        for _ in range(1500):
            t += rnd.choice([1, 2, 5, 50, 400, 1200]) if rnd.random() < 0.7 else rnd.randrange(0, 3)
            rows.append((f"id{rnd.randrange(80)}", t))
        df = spark.createDataFrame([(x, i, tt) for i, (x, tt) in enumerate(rows)],
                                   "event_id string, seq bigint, t bigint")
        assert _flags(dedup_idle_ttl(df, 1000)) == _idle_model(rows, 1000)


def test_last_n_speculative_blocks_vs_model(spark):
    rnd = random.Random(21)
    ids = [f"id{rnd.randrange(400)}" if rnd.random() < 0.5 else f"u{i}" for i in range(4000)]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "event_id string, seq bigint")
    spec = _last_n_blocks(df, 20, [], "event_id", "seq", "dedup_ok", 300, 60)
    assert _flags(spec) == _last_n_model(ids, 20)


def test_last_n_mismatched_blocks_are_replayed(spark, monkeypatch):
    """A short halo cannot rebuild the FIFO of a long run of few ids; no task gets the whole table instead."""
    from pyspark.sql import DataFrame
    plain = DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *cols: _fail() if n == 1 else plain(self, n, *cols))
    ids = [f"id{i % 7}" for i in range(600)] + [f"id{i % 13}" for i in range(600)]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "event_id string, seq bigint")
    got = _flags(dedup_last_n(df, 10, method="blocks", block_rows=100, halo_rows=3))
    assert got == _last_n_model(ids, 10)


def _fail():
    raise AssertionError("the whole table went to one task")


def test_last_n_replays_per_shard(spark):
    """Shards (a NULL one too) settle on their own; ids may be NULL."""
    rnd = random.Random(22)
    rows = [(rnd.choice([None, 1, 2]), rnd.choice([None, *(f"id{k}" for k in range(14))]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "shard int, event_id string, seq bigint")
    got = {r.seq: r.dedup_ok for r in dedup_last_n(df, 10, shard_cols=["shard"], method="blocks", block_rows=90, halo_rows=20).collect()}
    for shard in (None, 1, 2):
        mine = [(x, i) for s, x, i in rows if s == shard]
        assert [got[i] for _, i in mine] == _last_n_model([x for x, _ in mine], 10)


def test_idle_ttl_hot_id_path_vs_model(spark):
    rnd = random.Random(33)
    t, rows = 0, []
    for _ in range(1200):
        t += rnd.choice([1, 3, 40, 700, 1500])
        rows.append(("hot" if rnd.random() < 0.4 else f"id{rnd.randrange(50)}", t))
    df = spark.createDataFrame([(x, i, tt) for i, (x, tt) in enumerate(rows)], "event_id string, seq bigint, t bigint")
    # max_key_rows below the hot id's size forces the dense-index + self-join path
    assert _flags(dedup_idle_ttl(df, 1000, max_key_rows=100)) == _idle_model(rows, 1000)


def test_idle_ttl_small_blocks_vs_model(spark):
    """Windows spanning several blocks: suffix, sparse-table middle and prefix pieces."""
    rnd = random.Random(44)
    for trial in range(2):
        t, rows = 0, []
        for _ in range(1500):
            t += rnd.choice([1, 2, 5, 50, 400, 1200]) if rnd.random() < 0.7 else rnd.randrange(0, 3)
            rows.append((f"id{rnd.randrange(80)}", t))
        df = spark.createDataFrame([(x, i, tt) for i, (x, tt) in enumerate(rows)],
                                   "event_id string, seq bigint, t bigint")
        assert _flags(dedup_idle_ttl(df, 3000, block_rows=4)) == _idle_model(rows, 3000)


def test_idle_ttl_parallel_chain_vs_model(spark):
    """The pointer-doubling epoch chain (used above FOLD_MAX_CANDIDATES candidates) equals the model."""
    rnd = random.Random(55)
    for trial in range(3):
        t, rows = 0, []
        for _ in range(1500):
            t += rnd.choice([1, 2, 5, 50, 400, 1200]) if rnd.random() < 0.7 else rnd.randrange(0, 3)
            rows.append((f"id{rnd.randrange(40 + 40 * trial)}", t))
        df = spark.createDataFrame([(x, i, tt) for i, (x, tt) in enumerate(rows)],
                                   "event_id string, seq bigint, t bigint")
        assert _flags(dedup_idle_ttl(df, 1000, method="chain")) == _idle_model(rows, 1000)
    # boundaries: duplicate at ttl - 1 does not renew; expiry exactly at ttl after the last add
    ttl = 1000
    rows = [("a", 0), ("b", 10), ("b", 10 + ttl - 1), ("a", 10 + ttl), ("a", 10 + ttl + 1)]
    df = spark.createDataFrame([(x, i, tt) for i, (x, tt) in enumerate(rows)], "event_id string, seq bigint, t bigint")
    assert _flags(dedup_idle_ttl(df, ttl, method="chain")) == [True, True, False, True, False]


def test_idle_ttl_chain_many_epochs_small_blocks(spark):
    """Long chains (many doubling rounds) with windows spanning several blocks."""
    rnd = random.Random(66)
    t, rows = 0, []
    for _ in range(2000):
        t += rnd.choice([1, 3, 700, 1100, 2500])
        rows.append((f"id{rnd.randrange(12)}", t))
    df = spark.createDataFrame([(x, i, tt) for i, (x, tt) in enumerate(rows)], "event_id string, seq bigint, t bigint")
    exp = _idle_model(rows, 1000)
    assert _flags(dedup_idle_ttl(df, 1000, block_rows=8, method="chain")) == exp


def test_idle_ttl_burst_at_one_time_vs_model(spark):
    """A third of the rows share one arrival time (a batch stamped at once); both boundary plans."""
    rnd = random.Random(88)
    t, rows = 0, []
    for i in range(1800):
        if 600 <= i < 1200:
            rows.append((f"id{rnd.randrange(50)}", t))           # burst: same t
            continue
        t += rnd.choice([1, 5, 400, 1200, 2500])
        rows.append((f"id{rnd.randrange(50)}", t))
    df = spark.createDataFrame([(x, i, tt) for i, (x, tt) in enumerate(rows)], "event_id string, seq bigint, t bigint")
    exp = _idle_model(rows, 1000)
    assert _flags(dedup_idle_ttl(df, 1000, block_rows=16)) == exp
    assert _flags(dedup_idle_ttl(df, 1000, block_rows=16, method="chain")) == exp


def test_null_ids_are_one_id_in_every_plan(spark):
    rows = [(None, 1), ("a", 2), (None, 3), ("a", 4), ("b", 5)]
    df = spark.createDataFrame(rows, "event_id string, seq bigint")
    want = [True, True, False, False, True]
    assert _flags(dedup_first(df)) == want
    assert _flags(dedup_last_n(df, 10)) == want
    assert _flags(dedup_last_n(df, 10, method="blocks", block_rows=3, halo_rows=1)) == want

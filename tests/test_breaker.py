import random

from keelson.operators.breaker import _step, breaker_timeline


def _model(rows, fth, timeout, sth):
    out, st = [], {}
    for sink, seq, t, ok in sorted(rows, key=lambda r: (r[0], r[1])):
        s, fc, sc, lf = st.get(sink, ("CLOSED", 0, 0, 0))
        a, s, fc, sc, lf = _step(s, fc, sc, lf, t, ok, fth, timeout, sth)
        st[sink] = (s, fc, sc, lf)
        out.append((sink, seq, a, s, fc, sc))
    return out


def _run(spark, rows, fth, timeout, sth):
    df = spark.createDataFrame(rows, "sink string, seq bigint, t bigint, ok boolean")
    tl = breaker_timeline(df, failure_threshold=fth, timeout_ms=timeout, success_threshold=sth)
    return sorted((r.sink, r.seq, r.allowed, r.state, r.failure_count, r.success_count) for r in tl.collect())


def test_reference_case(spark):
    rows = [("redis", 1, 0, False), ("redis", 2, 1, False), ("redis", 3, 2, False),
            ("redis", 4, 500, True), ("redis", 5, 2500, True), ("redis", 6, 2600, True)]
    got = _run(spark, rows, 3, 1000, 2)
    assert [g[3] for g in got] == ["CLOSED", "CLOSED", "OPEN", "OPEN", "HALF_OPEN", "CLOSED"]
    assert got[3][2] is False and got[4][2] is True


def test_success_does_not_reset_in_closed(spark):
    rows = [("s", i, i, ok) for i, ok in enumerate([False, False, False, False, True, False])]
    got = _run(spark, rows, 5, 30000, 2)
    assert got[-1][3] == "OPEN" and got[4][4] == 4


def test_random_vs_model(spark):
    rnd = random.Random(4)
    rows, t = [], 0
    for i in range(4000):
        t += rnd.randrange(0, 900)
        rows.append((f"s{rnd.randrange(4)}", i, t, rnd.random() < 0.6))
    assert _run(spark, rows, 3, 2000, 2) == _model(rows, 3, 2000, 2)
    states = {r[3] for r in _model(rows, 3, 2000, 2)}
    assert states == {"CLOSED", "OPEN", "HALF_OPEN"}


def test_blocks_plan_equals_model(spark):
    rnd = random.Random(12)
    rows, t = [], 0
    for i in range(3000):
        t += rnd.randrange(0, 700)
        jitter = rnd.choice([0, 0, 0, -1500, 2500])     # some calls out of time order
        sink = "hot" if rnd.random() < 0.8 else f"s{rnd.randrange(3)}"
        rows.append((sink, i, t + jitter, rnd.random() < 0.55))
    df = spark.createDataFrame(rows, "sink string, seq bigint, t bigint, ok boolean")
    for fth, timeout, sth in ((3, 2000, 2), (1, 500, 1), (5, 30000, 3)):
        tl = breaker_timeline(df, failure_threshold=fth, timeout_ms=timeout, success_threshold=sth,
                              method="blocks", block_rows=97)
        got = sorted((r.sink, r.seq, r.allowed, r.state, r.failure_count, r.success_count) for r in tl.collect())
        assert got == _model(rows, fth, timeout, sth)


def test_initial_state_continues_replay(spark):
    """Second half started from the first half's final state = one replay of everything."""
    from keelson.operators.breaker import breaker_final_state
    rnd = random.Random(17)
    rows, t = [], 0
    for i in range(2000):
        t += rnd.randrange(0, 600)
        rows.append(("hot" if rnd.random() < 0.7 else "s1", i, t, rnd.random() < 0.5))
    full = _model(rows, 3, 1500, 2)
    df = spark.createDataFrame(rows, "sink string, seq bigint, t bigint, ok boolean")
    for method, blk in (("fold", 65536), ("blocks", 113)):
        first = breaker_timeline(df.where("seq < 1000"), failure_threshold=3, timeout_ms=1500, success_threshold=2,
                                 method=method, block_rows=blk)
        state = breaker_final_state(first)
        second = breaker_timeline(df.where("seq >= 1000"), failure_threshold=3, timeout_ms=1500, success_threshold=2,
                                  method=method, block_rows=blk, initial=state)
        got = sorted((r.sink, r.seq, r.allowed, r.state, r.failure_count, r.success_count)
                     for r in first.unionByName(second).collect())
        assert got == full, method


def test_prefix_scan_over_many_blocks(spark, monkeypatch):
    """Blocks of a few calls, several levels of the scan, times at the ends of int64: equal to the fold."""
    from keelson.operators import breaker
    monkeypatch.setattr(breaker, "SCAN_FAN", 3)
    rnd = random.Random(31)
    far = [2**63 - 1, -(2**63), 2**63 - 2000]
    rows, t = [], 0
    for i in range(1500):
        t += rnd.randrange(0, 900)
        rows.append((rnd.choice(["hot", "hot", "hot", "s1", None]), i, rnd.choice(far) if rnd.random() < 0.01 else t, rnd.random() < 0.5))
    df = spark.createDataFrame(rows, "sink string, seq bigint, t bigint, ok boolean")
    for fth, timeout, sth in ((3, 2000, 2), (1, 5000, 1), (4, 0, 3)):
        kw = dict(failure_threshold=fth, timeout_ms=timeout, success_threshold=sth)
        blocks = breaker_timeline(df, method="blocks", block_rows=7, **kw)
        fold = breaker_timeline(df, method="fold", **kw)
        assert {tuple(r) for r in blocks.collect()} == {tuple(r) for r in fold.collect()}


def test_composed_summaries_equal_one_block():
    from keelson.operators.breaker import _composed, _Function, _summarize
    import numpy as np
    rnd = random.Random(5)
    for _ in range(200):
        fth, sth, timeout = rnd.randint(1, 4), rnd.randint(1, 3), rnd.choice([0, 3, 10])
        ts = [rnd.randrange(40) for _ in range(rnd.randint(2, 30))]
        oks = [rnd.random() < 0.5 for _ in ts]
        cut, k = rnd.randint(1, len(ts) - 1), fth + sth
        whole = _Function(_summarize(ts, oks, fth, timeout, sth), k)
        parts = [_Function(_summarize(a, b, fth, timeout, sth), k) for a, b in ((ts[:cut], oks[:cut]), (ts[cut:], oks[cut:]))]
        both = _composed(*parts, timeout)
        code = np.concatenate([np.arange(k), np.full(50, k)])
        lf = np.concatenate([np.zeros(k), np.arange(50)]).astype(np.int64)
        a, b = whole.apply(code, lf, timeout), both.apply(code, lf, timeout)
        assert (a[0] == b[0]).all() and (a[1] == b[1])[a[0] == k].all()

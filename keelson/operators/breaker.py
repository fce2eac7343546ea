"""Circuit-breaker timeline (R8): replay call outcomes through the state machine.

States CLOSED / OPEN / HALF_OPEN; defaults 5 failures, 30 s, 2 successes.
* CLOSED: every call allowed; a failure counts (successes do not reset the
  count); at the failure threshold the breaker opens.
* OPEN: calls are denied until ``t - last_failure >= timeout``; that call moves
  the breaker to HALF_OPEN and is allowed.
* HALF_OPEN: calls allowed; ``success_threshold`` successes close it, any
  failure opens it again.
Every transition zeroes both counts.  A denied call records no outcome.

Each output row is the input row plus ``allowed``, ``state`` (after the call),
``failure_count``, ``success_count`` and ``last_failure`` (of an OPEN breaker, else 0: no other state asks for it).
Ordered per sink by ``seq``; ``t`` is the call time in milliseconds.

Two exact plans:
* ``fold`` - one streamed ordered pass per sink (hash exchange on the sink).
  Used when every sink has at most ``block_rows`` calls.
* ``blocks`` - for hot sinks.  A sink's calls get a dense index and are cut into
  blocks of ``block_rows``.  Pass 1 summarises each block independently as a
  function of the state it is entered in: a backward DP gives the exit state for
  every finite entry state (CLOSED with f failures, HALF_OPEN with s successes)
  and, for an OPEN entry with last failure ``lf``, a run-compressed list of
  breakpoints over the block's prefix-max times (the first call with
  ``t >= lf + timeout`` re-enters HALF_OPEN).  Such functions compose, so pass 2
  is a parallel prefix scan over them (``plans.scan.block_entries``) that gives
  each block's true entry state; no task sees more than a few summaries.  Pass 3
  re-simulates every block from its entry state in parallel.  No task ever holds
  more than one block, however hot the sink.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators.order import dense_index
from keelson.plans.fold import ordered_fold
from keelson.plans.joins import join_checked, materialize
from keelson.plans.scan import block_entries
from keelson.schema import (BREAKER_FAILURE_THRESHOLD, BREAKER_SUCCESS_THRESHOLD,
                            BREAKER_TIMEOUT_MS)

CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"


def _step(state, fc, sc, last_fail, t, ok, fth, timeout, sth):
    """One call; returns (allowed, state, fc, sc, last_fail)."""
    if state == OPEN:
        if t - last_fail >= timeout:
            state, fc, sc = HALF_OPEN, 0, 0
        else:
            return False, state, fc, sc, last_fail
    if ok:
        if state == HALF_OPEN:
            sc += 1
            if sc >= sth:
                state, fc, sc = CLOSED, 0, 0
    else:
        fc += 1
        last_fail = t
        if state == CLOSED and fc >= fth:
            state, fc, sc = OPEN, 0, 0
        elif state == HALF_OPEN:
            state, fc, sc = OPEN, 0, 0
    return True, state, fc, sc, last_fail


BLOCK_ROWS = 65536


def breaker_timeline(calls: DataFrame, sink_col: str = "sink", seq_col: str = "seq",
                     t_col: str = "t", ok_col: str = "ok",
                     failure_threshold: int = BREAKER_FAILURE_THRESHOLD,
                     timeout_ms: int = BREAKER_TIMEOUT_MS,
                     success_threshold: int = BREAKER_SUCCESS_THRESHOLD,
                     method: str = "auto", block_rows: int = BLOCK_ROWS,
                     initial: DataFrame | None = None, n_rows: int | None = None) -> DataFrame:
    """R8 replay; ``method`` is "auto" (measure the largest sink), "fold" or "blocks".

    ``n_rows``, where known, is the number of calls or a bound on it. ``initial`` optionally gives each sink's state before its first call
    (columns sink, state, failure_count, success_count, last_failure), e.g. the
    ``breaker_final_state`` of the previous micro-batch; sinks not in it start CLOSED.
    """
    args = (sink_col, seq_col, t_col, ok_col, failure_threshold, timeout_ms, success_threshold)
    if method == "auto":
        largest = calls.groupBy(sink_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m")).first()
        method = "fold" if (largest["m"] or 0) <= block_rows else "blocks"
    if method == "blocks":
        return _timeline_blocks(calls, *args, block_rows=block_rows, initial=initial, n_rows=n_rows)
    if initial is None:
        return _timeline_fold(calls, *args)
    init = initial.select(F.col("sink").alias("_i_sink"),
                          F.col("state").alias("_i_state"), F.col("failure_count").alias("_i_fc"),
                          F.col("success_count").alias("_i_sc"), F.col("last_failure").alias("_i_lf"))
    met = join_checked(calls, init, on=F.col(sink_col).eqNullSafe(F.col("_i_sink")), how="left")      # one row per sink, measured
    return _timeline_fold(met.drop("_i_sink"), *args).drop("_i_state", "_i_fc", "_i_sc", "_i_lf")


def breaker_final_state(timeline: DataFrame, sink_col: str = "sink", seq_col: str = "seq") -> DataFrame:
    """State of each sink after its last call (input for the next batch's ``initial``)."""
    last = F.max_by(F.struct("state", "failure_count", "success_count", "last_failure"), F.col(seq_col))
    return timeline.groupBy(sink_col).agg(last.alias("_s")) \
        .select(F.col(sink_col).alias("sink"), "_s.*")


def _out_fields():
    return [T.StructField("allowed", T.BooleanType(), False),
            T.StructField("state", T.StringType(), False),
            T.StructField("failure_count", T.IntegerType(), False),
            T.StructField("success_count", T.IntegerType(), False),
            T.StructField("last_failure", T.LongType(), False)]


def _initial_of(batch_or_table, i: int):
    """(state, fc, sc, lf) from the optional ``_i_*`` columns of row i, or None."""
    names = batch_or_table.schema.names
    if "_i_state" not in names:
        return None
    s = batch_or_table.column("_i_state")[i].as_py()
    if s is None:
        return None
    return (s, int(batch_or_table.column("_i_fc")[i].as_py()), int(batch_or_table.column("_i_sc")[i].as_py()),
            int(batch_or_table.column("_i_lf")[i].as_py()))


def _timeline_fold(calls: DataFrame, sink_col, seq_col, t_col, ok_col, failure_threshold, timeout_ms,
                   success_threshold) -> DataFrame:
    fth, timeout, sth = failure_threshold, timeout_ms, success_threshold
    schema = T.StructType(list(calls.schema.fields) + _out_fields())

    def step_batch(batch: pa.RecordBatch, st: dict) -> pa.RecordBatch:
        sinks = batch.column(sink_col).to_pylist()
        ts = batch.column(t_col).to_pylist()
        oks = batch.column(ok_col).to_pylist()
        allowed, states, fcs, scs, lfs = [], [], [], [], []
        key = st.get("key", object())
        s, fc, sc, lf = st.get("s", CLOSED), st.get("fc", 0), st.get("sc", 0), st.get("lf", 0)
        for i, (k, t, ok) in enumerate(zip(sinks, ts, oks)):
            if k != key:
                key = k
                s, fc, sc, lf = _initial_of(batch, i) or (CLOSED, 0, 0, 0)
            a, s, fc, sc, lf = _step(s, fc, sc, lf, t, bool(ok), fth, timeout, sth)
            allowed.append(a)
            states.append(s)
            fcs.append(fc)
            scs.append(sc)
            lfs.append(lf if s == OPEN else 0)
        st.update(key=key, s=s, fc=fc, sc=sc, lf=lf)
        cols = [batch.column(i) for i in range(batch.num_columns)]
        cols += [pa.array(allowed, pa.bool_()), pa.array(states, pa.string()),
                 pa.array(fcs, pa.int32()), pa.array(scs, pa.int32()), pa.array(lfs, pa.int64())]
        names = list(batch.schema.names) + ["allowed", "state", "failure_count", "success_count", "last_failure"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return ordered_fold(calls, [sink_col], [seq_col], step_batch, schema)


def breaker_totals(timeline: DataFrame, sink_col: str = "sink", ok_col: str = "ok") -> DataFrame:
    """Totals of recorded successes and failures per sink (denied calls record none)."""
    c = F.col
    return timeline.groupBy(sink_col).agg(
        F.count_if(c("allowed") & c(ok_col)).alias("total_successes"),
        F.count_if(c("allowed") & ~c(ok_col)).alias("total_failures"),
        F.count_if(~c("allowed")).alias("denied"))


# --------------------------------------------------------------------------- blocks
# finite states are coded 0..F-1 (CLOSED with f failures) and F..F+S-1
# (HALF_OPEN with s successes); code F+S is OPEN and carries the last failure time.

# A block's summary is such a function as int64 numbers: how many breakpoints; exit code and last failure for each
# finite state; times, exit codes and last failures of the breakpoints.

def _entry_bytes(initial: DataFrame, fth: int, sth: int):
    """Column: the entry state as text, "code,last failure"."""
    c = F.col
    code = F.when(c("state") == CLOSED, c("failure_count")).when(c("state") == HALF_OPEN, fth + c("success_count")).otherwise(fth + sth)
    return F.concat_ws(",", code.cast("string"), c("last_failure").cast("string")).cast("binary")


def _state_of(code: int, fth: int, sth: int) -> tuple[str, int, int]:
    if code < fth:
        return CLOSED, code, 0
    if code < fth + sth:
        return HALF_OPEN, 0, code - fth
    return OPEN, 0, 0


def _summarize(ts: list[int], oks: list[bool], fth: int, timeout: int, sth: int) -> bytes:
    """Backward DP over one block."""
    n, k = len(ts), fth + sth
    now = [(e, 0) for e in range(k)]            # exit of every finite state entered before call i
    half = [None] * (n + 1)                     # exit when call i is entered HALF_OPEN: how an open breaker comes back
    half[n] = now[fth]
    # monotonic stack of later calls whose t beats every call between (nearest first at the end)
    stack_idx: list[int] = []
    stack_negt: list[int] = []
    for i in range(n - 1, -1, -1):
        if oks[i]:
            now = now[:fth] + now[fth + 1:] + now[:1]
        else:
            ti = ts[i]
            pos = bisect.bisect_right(stack_negt, -(ti + timeout)) - 1
            opened = half[stack_idx[pos]] if pos >= 0 else (k, ti)
            now = now[1:fth] + [opened] * (1 + sth)
        half[i] = now[fth]
        t = ts[i]
        while stack_idx and ts[stack_idx[-1]] <= t:
            stack_idx.pop()
            stack_negt.pop()
        stack_idx.append(i)
        stack_negt.append(-t)
    # OPEN entry with last failure lf0: the first call with t >= lf0 + timeout (a prefix-max record); what is left of the stack, nearest first
    points: list[tuple[int, int, int]] = []
    for i in reversed(stack_idx):
        if points and points[-1][1:] == half[i]:
            points[-1] = (ts[i], *half[i])      # keep the last record of a run of equal exits
        else:
            points.append((ts[i], *half[i]))
    flat = np.array(points, np.int64).reshape(-1, 3)
    return np.concatenate([[len(points)], [x[0] for x in now], [x[1] for x in now], flat.T.ravel()]).astype(np.int64).tobytes()


class _Function:
    """A summary, opened."""

    def __init__(self, blob: bytes, k: int):
        a = np.frombuffer(blob, np.int64)
        n = int(a[0])
        self.k, self.code, self.lf = k, a[1:1 + k], a[1 + k:1 + 2 * k]
        self.t, self.to, self.to_lf = a[1 + 2 * k:].reshape(3, n)

    def apply(self, code: np.ndarray, lf: np.ndarray, timeout: int) -> tuple[np.ndarray, np.ndarray]:
        """Exit states of entry states."""
        shut = code == self.k
        safe = np.where(shut, 0, code)
        out, out_lf = self.code[safe], self.lf[safe]
        top = np.iinfo(np.int64).max
        fits = lf <= top - timeout              # beyond that no time can reach it
        at = np.where(fits, np.searchsorted(self.t, np.where(fits, lf, 0) + timeout), len(self.t))
        back = shut & (at < len(self.t))
        if len(self.t):
            at = np.minimum(at, len(self.t) - 1)
            out, out_lf = np.where(back, self.to[at], out), np.where(back, self.to_lf[at], out_lf)
        stays = shut & ~back
        return np.where(stays, self.k, out), np.where(stays, lf, out_lf)


def _composed(f: _Function, g: _Function, timeout: int) -> _Function:
    """``g`` after ``f``. An OPEN entry that ``f`` lets pass meets the breakpoints of ``g`` beyond those of ``f``."""
    out = _Function.__new__(_Function)
    out.k = f.k
    out.code, out.lf = g.apply(f.code, f.lf, timeout)
    later = slice(int(np.searchsorted(g.t, f.t[-1], side="right")) if len(f.t) else 0, None)
    to, to_lf = g.apply(f.to, f.to_lf, timeout)
    t, to, to_lf = (np.concatenate(x) for x in ((f.t, g.t[later]), (to, g.to[later]), (to_lf, g.to_lf[later])))
    last = np.ones(len(t), bool)
    last[:-1] = (to[1:] != to[:-1]) | (to_lf[1:] != to_lf[:-1])
    out.t, out.to, out.to_lf = t[last], to[last], to_lf[last]
    return out


def _function_bytes(f: _Function) -> bytes:
    return np.concatenate([[len(f.t)], f.code, f.lf, f.t, f.to, f.to_lf]).astype(np.int64).tobytes()


SCAN_FAN = 16               # summaries in one step of the scan: breakpoints may be as many as the calls of a block


def _timeline_blocks(calls: DataFrame, sink_col, seq_col, t_col, ok_col, failure_threshold, timeout_ms,
                     success_threshold, block_rows: int = BLOCK_ROWS, initial: DataFrame | None = None,
                     n_rows: int | None = None) -> DataFrame:
    fth, timeout, sth = failure_threshold, timeout_ms, success_threshold
    k = fth + sth
    idx = dense_index(calls, seq_col, [sink_col], n_rows=n_rows)
    blocked = materialize(idx.withColumn("_blk", F.floor(F.col("_idx") / block_rows).cast("bigint"))
                          .repartition(sink_col, "_blk"))
    sum_schema = T.StructType([blocked.schema[sink_col], T.StructField("_blk", T.LongType()), T.StructField("summary", T.BinaryType())])

    def summarize(table: pa.Table) -> pa.Table:
        table = table.sort_by("_idx")
        blob = _summarize(table.column(t_col).to_pylist(), table.column(ok_col).to_pylist(), fth, timeout, sth)
        return pa.table([table.column(sink_col).slice(0, 1), pa.array([table.column("_blk")[0].as_py()], pa.int64()),
                         pa.array([blob], pa.binary())], names=[sink_col, "_blk", "summary"])

    def combine(blobs: list[bytes]) -> bytes:
        out = _Function(blobs[0], k)
        for b in blobs[1:]:
            out = _composed(out, _Function(b, k), timeout)
        return _function_bytes(out)

    def advance(state: bytes, blob: bytes) -> bytes:
        code, lf = (np.array([int(x)], np.int64) for x in state.split(b","))
        code, lf = _Function(blob, k).apply(code, lf, timeout)
        return b"%d,%d" % (code[0], lf[0])

    summaries = blocked.select(sink_col, "_blk", "_idx", t_col, ok_col) \
        .groupBy(sink_col, "_blk").applyInArrow(summarize, schema=sum_schema)
    starts = None if initial is None else initial.select(F.col("sink").alias(sink_col), _entry_bytes(initial, fth, sth).alias("entry"))
    entries = block_entries(summaries, [sink_col], "_blk", "summary", combine, advance, b"0,0", starts, SCAN_FAN)
    entries = entries.select(F.col(sink_col).alias("_e_sink"), F.col("idx").alias("_e_blk"), F.col("entry").alias("_entry"))
    with_entry = join_checked(blocked, entries, on=F.col(sink_col).eqNullSafe(F.col("_e_sink")) & (F.col("_blk") == F.col("_e_blk")),
                              how="inner").drop("_e_sink", "_e_blk")
    out_schema = T.StructType([f for f in calls.schema.fields] + _out_fields())
    names = [f.name for f in out_schema.fields]

    def simulate(table: pa.Table) -> pa.Table:
        table = table.sort_by("_idx")
        code, lf = (int(x) for x in table.column("_entry")[0].as_py().split(b","))
        s, fc, sc = _state_of(code, fth, sth)
        ts = table.column(t_col).to_pylist()
        oks = table.column(ok_col).to_pylist()
        allowed, states, fcs, scs, lfs = [], [], [], [], []
        for t, ok in zip(ts, oks):
            a, s, fc, sc, lf = _step(s, fc, sc, lf, t, bool(ok), fth, timeout, sth)
            allowed.append(a)
            states.append(s)
            fcs.append(fc)
            scs.append(sc)
            lfs.append(lf if s == OPEN else 0)
        table = table.append_column("allowed", pa.array(allowed, pa.bool_())) \
            .append_column("state", pa.array(states, pa.string())) \
            .append_column("failure_count", pa.array(fcs, pa.int32())) \
            .append_column("success_count", pa.array(scs, pa.int32())) \
            .append_column("last_failure", pa.array(lfs, pa.int64()))
        return table.select(names)

    return with_entry.groupBy(sink_col, "_blk").applyInArrow(simulate, schema=out_schema)

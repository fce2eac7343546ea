"""De-duplication whose decisions depend on earlier decisions (Q2, Q3).

Q2 ``dedup_idle_ttl`` - a shared id set that expires as a whole ``ttl`` after
the last *added* id (a duplicate does not renew it).  Exact parallel plan,
given arrival times ``t`` that do not decrease with ``seq``:

* ``prev`` = seq of the previous occurrence of the same id (window per id, or a
  per-id dense index and self-join when one id is too large for a task).
  Inside an epoch that starts at row b, a row is accepted iff prev < b.
* First-ever occurrences are always accepted, so the set can only expire at a
  row that comes >= ttl after the latest first-ever occurrence before it
  (running max, two-level scan): the *candidates*.
* A candidate c ends the epoch that started at b iff t_c - t_b >= ttl and every
  row in the ttl before c is a duplicate inside the epoch, i.e. the minimum
  ``prev`` over that time window is >= b.  The window is a contiguous index
  range [lo(c), c); its minimum ``P(c)`` comes from a running count (lo), block
  prefix/suffix minima and a sparse table over block minima - equi-joins only,
  no row-candidate pairs.
* Epoch boundaries: up to ``FOLD_MAX_CANDIDATES`` candidates, one streamed
  ordered fold with two scalars (epoch start seq and time).  Above that, the
  parallel chain: the qualifying test is monotone in the epoch start, so each
  candidate's successor boundary is a running maximum, and the chain from the
  first row is marked by pointer doubling (log2 rounds of equi-joins).
* Each row's epoch start is a running max over boundary rows; then the flag.

Q3 ``dedup_last_n`` - a FIFO of the last N accepted ids per shard; duplicates
do not refresh.  While a shard has at most N distinct ids nothing is ever
evicted, which is exactly first-arrival dedup per shard (checked with an
aggregate, fully parallel).  Otherwise the rows are cut into blocks of B in
seq order and replayed speculatively in parallel: each block starts from an
empty FIFO at the beginning of a halo of the previous H >= 2N rows and records
a hash of its FIFO at its own first row and after its last row, and the FIFO
itself.  Block 0 is exact; block j is exact when its start hash equals block
j-1's end hash and that block is exact.  Mismatched blocks are replayed from
their predecessor's FIFO until every boundary agrees: all of them in the first
rounds, then the first of each shard, which a round makes exact.  So the work is
bounded by a few replays of every block, and no task ever holds more than one
block and one FIFO.  Where FIFOs from different histories never meet (they need
not), the rounds follow each other along the blocks: the problem is sequential
there, its data are not moved.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators.dedup import dedup_first
from keelson.operators.order import (ROWS_PER_RANGE, dense_index, join_ranges, previous_seq, range_count, range_offsets,
                                     range_table, require_seq)
from keelson.plans.fold import ordered_fold
from keelson.plans.joins import (fits_broadcast, join_checked, materialize, materialize_counted,
                                 materialize_observed, materialize_small)
from keelson.plans.scan import range_min_table, running_max, running_sum
from keelson.schema import DEDUP_LAST_N, DEDUP_TTL_MS


def dedup_idle_ttl(df: DataFrame, ttl_ms: int = DEDUP_TTL_MS, t_col: str = "t", id_col: str = "event_id",
                   seq_col: str = "seq", out_col: str = "dedup_ok", max_key_rows: int = 1_000_000,
                   block_rows: int = 65536, method: str = "auto", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Q2; ``method`` picks the epoch-boundary step: "auto" (streamed fold up to
    ``FOLD_MAX_CANDIDATES`` candidates, else the parallel chain), "fold" or "chain"."""
    require_seq(df, seq_col)
    c = F.col
    n = df.count()
    prev = previous_seq(df, [id_col], seq_col, "_prev", max_key_rows=max_key_rows)
    # one range partitioning by seq serves the scans and the index
    if range_count(n, rows_per_range) == 1:
        base = materialize(dense_index(prev, seq_col, n_rows=n, rows_per_range=rows_per_range), "prev") \
            .withColumn("_rng", F.lit(0).cast("long"))
    else:
        base = range_table(prev, seq_col, n, rows_per_range)
        base = join_ranges(base, range_offsets(base), range_count(n, rows_per_range)) \
            .withColumn("_idx", c("_off") + c("_pos")).drop("_off", "_pos")
    first_t = F.when(c("_prev").isNull(), c(t_col))
    scanned = running_max(base.withColumn("_ft", first_t), "_ft", seq_col, "_g", inclusive=False, n_rows=n,
                          rows_per_range=rows_per_range)
    rows = materialize(scanned.drop("_ft").withColumn("_blk", F.floor(c("_idx") / block_rows).cast("bigint")))
    _require_times_in_order(rows, t_col)
    # candidates: rows >= ttl after the latest first-ever occurrence; the first row starts epoch 0
    cand = rows.where(c("_g").isNull() | (c(t_col) - c("_g") >= ttl_ms)).select(
        c("_idx").alias("_cidx"), c(seq_col).alias("_cseq"), c(t_col).alias("_ct"),
        c("_g").isNull().alias("_start"))
    cand, n_cand = materialize_counted(cand)
    pmin = _window_min_prev(rows.drop("_rng"), cand, t_col, ttl_ms, block_rows, n, n_cand)

    schema = T.StructType([T.StructField("_bseq", T.LongType(), False)])

    def step(batch: pa.RecordBatch, st: dict) -> pa.RecordBatch:
        out = []
        bseq, bt = st.get("bseq"), st.get("bt")
        for s_, t, start, pm, empty in zip(*(batch.column(k).to_pylist()
                                              for k in ("_cseq", "_ct", "_start", "_pmin", "_empty"))):
            if start or bseq is None:
                bseq, bt = s_, t
                out.append(s_)
            elif t - bt >= ttl_ms and (empty or pm >= bseq):
                bseq, bt = s_, t
                out.append(s_)
        st.update(bseq=bseq, bt=bt)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["_bseq"])

    cols = pmin.select("_cseq", "_ct", "_start", "_pmin", "_empty")
    if method == "fold" or (method == "auto" and n_cand <= FOLD_MAX_CANDIDATES):
        bounds = ordered_fold(cols, [], ["_cseq"], step, schema)
    else:
        bounds = _epoch_chain(cols, ttl_ms, n_cand)
    marks = bounds.withColumn("_is_b", F.lit(True))       # boundaries are a subset of candidates
    flagged = join_checked(rows, marks, on=rows[seq_col] == c("_bseq"), how="left",
                           already_checked=fits_broadcast(n_cand, marks))
    flagged = flagged.withColumn("_bmark", F.when(c("_is_b"), c(seq_col))).drop("_bseq", "_is_b")
    epochs = running_max(flagged, "_bmark", seq_col, "epoch_start", inclusive=True, n_rows=n, rows_per_range=rows_per_range)
    ok = c("_prev").isNull() | (c("_prev") < c("epoch_start"))
    return epochs.withColumn(out_col, ok).drop("_prev", "_g", "_bmark", "_idx", "_blk", "_rng")


def _require_times_in_order(rows: DataFrame, t_col: str) -> None:
    """Raise if an arrival time is below its predecessor's: inside blocks by a window, between blocks by their edges."""
    c = F.col
    inside = Window.partitionBy("_blk").orderBy("_idx")
    blocks = rows.select("_blk", t_col, F.lag(t_col).over(inside).alias("_lt")).groupBy("_blk").agg(
        F.max(c("_lt") > c(t_col)).alias("back"), F.min(t_col).alias("lo"), F.max(t_col).alias("hi"))
    edges = blocks.withColumn("_before", F.lag("hi").over(Window.orderBy("_blk")))       # one row per block
    if not edges.where(c("back") | (c("_before") > c("lo"))).isEmpty():
        raise ValueError(f"arrival times in '{t_col}' must not decrease in seq order")


_INF = np.iinfo(np.int64).max
# the streamed candidate fold does about a million candidates a second in one task;
# above this the boundaries come from the parallel chain instead
FOLD_MAX_CANDIDATES = 1_000_000


def _epoch_chain(cands: DataFrame, ttl_ms: int, n_cand: int) -> DataFrame:
    """Epoch boundaries without a sequential pass (same result as the candidate fold).

    Whether candidate k starts an epoch after boundary j is monotone in j: it
    needs t_k - t_j >= ttl and (empty window or P(k) >= seq_j), and t and seq
    both grow with j.  So k qualifies iff j <= theta_k, the last candidate
    meeting both bounds, and the boundary after j is next(j) = min{k : theta_k
    >= j} (theta_k < k, so k > j).  theta and next are running maxima over
    candidate-sized tables (two-level scans); the chain from the first row is
    then marked by pointer doubling: jump tables next^(2^r) and the chain
    prefix of 2^r boundaries double together, log2(#boundaries) equi-join rounds.
    """
    c = F.col
    null = F.lit(None).cast("bigint")
    cands = materialize(cands)
    n_ev = 2 * n_cand

    def last_before(points: DataFrame, probes: DataFrame, out: str, key: str = "_cseq") -> DataFrame:
        # points (_ord = 2x, _v) and probes (_ord = 2y + 1, _q): max _v over points with x <= y.
        # Scan keys are made unique first (max per point value, one probe per value), so a
        # run of equal values never lands whole in one range; answers join back per value.
        pts = points.groupBy("_ord").agg(F.max("_v").alias("_v")).withColumn("_isq", F.lit(False))
        qry = probes.select("_ord").distinct().select("_ord", null.alias("_v"), F.lit(True).alias("_isq"))
        ans = running_max(pts.unionByName(qry), "_v", "_ord", out, inclusive=True, n_rows=n_ev) \
            .where(c("_isq")).select("_ord", out)
        return probes.join(ans, "_ord", "left").select(c("_q").alias(key), out)

    a = last_before(cands.select((c("_ct") * 2).alias("_ord"), c("_cseq").alias("_v")),
                    cands.select(((c("_ct") - ttl_ms) * 2 + 1).alias("_ord"), c("_cseq").alias("_q")), "_a")
    b = last_before(cands.select((c("_cseq") * 2).alias("_ord"), c("_cseq").alias("_v")),
                    cands.where(~c("_empty") & c("_pmin").isNotNull())
                    .select((c("_pmin") * 2 + 1).alias("_ord"), c("_cseq").alias("_q")), "_b")
    both = F.when(c("_a").isNotNull() & c("_b").isNotNull(), F.least("_a", "_b"))
    theta = cands.join(a, "_cseq", "left").join(b, "_cseq", "left") \
        .select("_cseq", "_start", F.when(c("_start"), null).when(c("_empty"), c("_a")).otherwise(both).alias("_th"))
    theta = materialize(theta)

    # next(j) = min{k : theta_k >= j}: order by value descending (points before queries
    # at equal value) and keep the running max of -k
    nxt = last_before(theta.where(c("_th").isNotNull()).select((-2 * c("_th")).alias("_ord"), (-c("_cseq")).alias("_v")),
                      theta.select((-2 * c("_cseq") + 1).alias("_ord"), c("_cseq").alias("_q")), "_nv", key="_j") \
        .where(c("_nv").isNotNull()).select("_j", (-c("_nv")).alias("_nxt"))
    jump, n_jump = _cut_counted(nxt)

    chain, n_chain = _cut_counted(theta.where(c("_start")).select(c("_cseq").alias("_j")))
    while n_jump:
        # chain holds the boundaries at distances [0, 2^r); one jump of 2^r extends it to [0, 2^(r+1))
        ahead = join_checked(jump, chain, on="_j", how="inner", already_checked=fits_broadcast(n_chain, chain)) \
            .select(c("_nxt").alias("_j"))
        ahead, n_ahead = _cut_counted(ahead)
        if n_ahead == 0:
            break
        chain, n_chain = _cut_counted(chain.unionByName(ahead))
        x, y = jump.alias("x"), jump.alias("y")
        jump, n_jump = _cut_counted(
            x.join(y, c("x._nxt") == c("y._j"), "inner").select(c("x._j").alias("_j"), c("y._nxt").alias("_nxt")))
    return chain.select(c("_j").alias("_bseq"))


def _cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Checkpoint (lineage cut, one pass) and the row count observed while writing."""
    out, seen = materialize_observed(df, "chain", n=F.count(F.lit(1)))
    return out, int(seen["n"])


def _window_min_prev(rows: DataFrame, cand: DataFrame, t_col: str, ttl_ms: int, block_rows: int,
                     n_rows: int, n_cand: int) -> DataFrame:
    """For each candidate c: min ``_prev`` over rows q with idx_q in [lo(c), idx_c), where
    lo(c) = number of rows with t <= t_c - ttl (t does not decrease with seq).

    No pairs are formed: lo(c) comes from one running count over rows and
    probes; the range minimum is split into (a) the suffix of lo's block, (b)
    whole blocks between, read from a sparse table over block minima, and (c)
    the prefix of c's block, or one in-block range minimum when lo and c share
    a block.  (a), (c) and the in-block case come from one Arrow fold per block.
    """
    c = F.col
    # rows counted per time value and one probe per distinct value: unique scan keys, so
    # many rows sharing one arrival time never form one range; answers join back per value
    per_t = rows.groupBy((c(t_col) * 2).alias("_ord")).agg(F.count(F.lit(1)).alias("_isrow"))
    probe = cand.select("_cidx", ((c("_ct") - ttl_ms) * 2 + 1).alias("_ord"))
    events = per_t.unionByName(probe.select("_ord").distinct().select("_ord", F.lit(0).cast("bigint").alias("_isrow")))
    # candidates are a subset of rows, so 2n bounds the event count for range sizing
    counted = running_sum(events, "_isrow", "_ord", "_lo", n_rows=n_rows + n_cand)
    answers = counted.where(F.pmod(c("_ord"), F.lit(2)) == 1).select("_ord", "_lo")
    lo = probe.join(answers, "_ord", "left").select("_cidx", c("_lo").cast("bigint").alias("_lo"))
    # lo has one row per candidate: the candidate count is its size bound
    cq = join_checked(cand, lo, on=["_cidx"], how="inner", already_checked=fits_broadcast(n_cand, lo)) \
        .withColumn("_kl", F.floor(c("_lo") / block_rows).cast("bigint")) \
        .withColumn("_kc", F.floor(c("_cidx") / block_rows).cast("bigint"))
    cq = materialize(cq)

    # (a), (c) and same-block minima: one fold per block
    same = cq.where(c("_kl") == c("_kc")).select(c("_cidx").alias("_idx"), c("_lo").alias("_same_lo"))
    per_block = join_checked(rows.select("_blk", "_idx", "_prev"), same, on=["_idx"], how="left",
                             already_checked=fits_broadcast(n_cand, same))
    fold_schema = T.StructType([T.StructField("_idx", T.LongType()), T.StructField("_pre", T.LongType()),
                                T.StructField("_suf", T.LongType()), T.StructField("_inb", T.LongType())])

    def block_minima(table: pa.Table) -> pa.Table:
        table = table.sort_by("_idx")
        idx = table.column("_idx").to_numpy(zero_copy_only=False).astype(np.int64)
        # first-ever rows (NULL prev) never bound a window: fill with +inf in int64, no float round trip
        prev = pc.fill_null(table.column("_prev").cast(pa.int64()), pa.scalar(_INF, pa.int64()))
        v = prev.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        k = len(v)
        pre = np.minimum.accumulate(np.concatenate([[_INF], v[:-1]])) if k else v
        suf = np.minimum.accumulate(v[::-1])[::-1] if k else v
        sparse = [v]
        span = 1
        while span * 2 <= k:
            last = sparse[-1]
            sparse.append(np.minimum(last[:-span], last[span:]))
            span *= 2
        inb = np.full(k, _INF, dtype=np.int64)
        same_lo = table.column("_same_lo").to_pylist()
        base_idx = int(idx[0]) if k else 0
        for pos, lo_abs in enumerate(same_lo):
            if lo_abs is None:
                continue
            a, b = int(lo_abs) - base_idx, pos          # half-open [a, b)
            if a < b:
                lvl = (b - a).bit_length() - 1
                inb[pos] = min(sparse[lvl][a], sparse[lvl][b - (1 << lvl)])
        return pa.table([pa.array(idx), pa.array(pre), pa.array(suf), pa.array(inb)],
                        names=["_idx", "_pre", "_suf", "_inb"])

    minima = materialize(per_block.groupBy("_blk").applyInArrow(block_minima, schema=fold_schema))
    blocks = rows.groupBy("_blk").agg(F.min("_prev").alias("_bm"))
    table = range_min_table(blocks, "_blk", "_bm", n=-(-n_rows // block_rows))

    # (b): whole blocks strictly between kl and kc, two lookups in the sparse table
    span = c("_kc") - c("_kl") - 1
    lvl = F.when(span > 0, F.floor(F.log2(span.cast("double")))).cast("int")
    mid = cq.where(span > 0).select("_cidx", lvl.alias("_lv"), (c("_kl") + 1).alias("_p1"),
                                    (c("_kc") - 1 - F.pow(F.lit(2), lvl).cast("bigint") + 1).alias("_p2"))
    t1 = table.select(c("level").alias("_lv"), c("pos").alias("_p1"), c("m").alias("_m1"))
    t2 = table.select(c("level").alias("_lv"), c("pos").alias("_p2"), c("m").alias("_m2"))
    mid = mid.join(t1, ["_lv", "_p1"], "left").join(t2, ["_lv", "_p2"], "left") \
        .select("_cidx", F.least("_m1", "_m2").alias("_mid"))

    a_part = minima.select(c("_idx").alias("_lo"), c("_suf").alias("_a"))
    c_part = minima.select(c("_idx").alias("_cidx"), c("_pre").alias("_c"), c("_inb").alias("_inb"))
    out = cq.join(c_part, "_cidx", "left").join(a_part, "_lo", "left").join(mid, "_cidx", "left")
    inf = F.lit(int(_INF))
    cross = F.least(F.coalesce(c("_a"), inf), F.coalesce(c("_mid"), inf), F.coalesce(c("_c"), inf))
    p = F.when(c("_kl") == c("_kc"), c("_inb")).otherwise(cross)
    return out.select("_cseq", "_ct", "_start", F.when(p < inf, p).alias("_pmin"),
                      (c("_lo") >= c("_cidx")).alias("_empty"))


def dedup_last_n(df: DataFrame, n: int = DEDUP_LAST_N, shard_cols: Sequence[str] = (),
                 id_col: str = "event_id", seq_col: str = "seq", out_col: str = "dedup_ok",
                 method: str = "auto", block_rows: int | None = None, halo_rows: int | None = None) -> DataFrame:
    """Q3; ``method`` is "auto" (first arrivals while nothing can be evicted, else blocks) or "blocks"."""
    require_seq(df, seq_col)
    shards = list(shard_cols)
    if method == "auto":
        distinct_ids = df.groupBy(*shards, id_col).agg(F.lit(1).alias("_one")) \
            .groupBy(*shards).agg(F.count(F.lit(1)).alias("_ids"))
        worst = distinct_ids.agg(F.max("_ids").alias("m")).first()["m"] or 0
        if worst <= n:
            return dedup_first(df, id_col=[*shards, id_col], seq_col=seq_col, out_col=out_col)
    return _last_n_blocks(df, n, shards, id_col, seq_col, out_col, block_rows, halo_rows)


def _fifo_hash(fifo) -> int:
    h = hashlib.blake2b(digest_size=8)
    for i in fifo:
        h.update(repr(i).encode("utf-8"))
        h.update(b"\x00")
    return int.from_bytes(h.digest(), "big", signed=True)


# every mismatched block is replayed again in the first rounds; then only the first one of each shard, which a round makes exact
EAGER_ROUNDS = 3


def _last_n_blocks(df: DataFrame, n: int, shards: list[str], id_col: str, seq_col: str, out_col: str,
                   block_rows: int | None, halo_rows: int | None) -> DataFrame:
    """Blocks replayed in parallel, and again from their predecessor's FIFO until every boundary agrees."""
    c = F.col
    halo = halo_rows if halo_rows is not None else 2 * n
    block = block_rows if block_rows is not None else max(4 * halo, 1_000_000)
    if halo > block:
        raise ValueError("halo_rows must not exceed block_rows")
    idx = dense_index(df, seq_col, shards).withColumn("_blk", F.floor(c("_idx") / block).cast("bigint"))
    # in block order, so that a filter on blocks skips row groups
    blocked = materialize(idx.repartition(*shards, "_blk").sortWithinPartitions("_blk", *shards), "fifo-rows")
    in_halo = (c("_idx") % block) >= (block - halo)
    targets = F.when(in_halo & F.lit(halo > 0), F.array(c("_blk"), c("_blk") + 1)).otherwise(F.array("_blk"))
    spread = blocked.withColumn("_to", F.explode(targets)).withColumn("_own", c("_to") == c("_blk")) \
        .drop("_blk").withColumnRenamed("_to", "_blk")
    id_type = df.schema[id_col].dataType
    own = [f for f in blocked.schema.fields]
    out_schema = T.StructType([T.StructField(f.name, f.dataType) for f in own] + [
        T.StructField(out_col, T.BooleanType()), T.StructField("_h0", T.LongType()), T.StructField("_h1", T.LongType()),
        T.StructField("_fifo", T.ArrayType(id_type))])
    names = [f.name for f in own]

    def replayed(table: pa.Table, entry) -> pa.Table:
        """Rows of one block with their flags, and a last row with the block's FIFO hashes and its FIFO at the end. A halo (rows that
        are not the block's own) is replayed before the entry hash is taken."""
        table = table.sort_by([("_idx", "ascending"), *([("_own", "ascending")] if "_own" in table.column_names else [])])
        ids = table.column(id_col).to_pylist()
        mine = table.column("_own").to_pylist() if "_own" in table.column_names else [True] * len(ids)
        fifo, flags, h0 = deque(entry), [], None
        seen = set(fifo)
        for i, here in zip(ids, mine):
            if here and h0 is None:
                h0 = _fifo_hash(fifo)
            fresh = i not in seen
            if fresh:
                seen.add(i)
                fifo.append(i)
                if len(fifo) > n:
                    seen.discard(fifo.popleft())
            flags.append(fresh)
        table = table.append_column(out_col, pa.array(flags, pa.bool_())).filter(pa.array(mine))
        if not table.num_rows:                              # a halo without a block: the rows of the last one
            return _no_rows(table)
        whole = pa.array(list(fifo), table.schema.field(id_col).type)
        end = {k: table.column(k).slice(0, 1).combine_chunks() for k in (*shards, "_blk")}
        k = table.num_rows
        kind = pa.list_(whole.type)
        parts = [pa.chunked_array([*table.column(f).chunks, *(_chunks(end[f]) if f in end else [pa.nulls(1, table.schema.field(f).type)])])
                 for f in names]
        return pa.table([*parts, pa.chunked_array([*table.column(out_col).chunks, pa.nulls(1, pa.bool_())]),
                         pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array([h0], pa.int64())]),
                         pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array([_fifo_hash(fifo)], pa.int64())]),
                         pa.concat_arrays([pa.nulls(k, kind), pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)])],
                        names=[f.name for f in out_schema.fields])

    def _chunks(a):
        return a.chunks if isinstance(a, pa.ChunkedArray) else [a]

    def _no_rows(table):
        kinds = {f.name: f.type for f in table.schema}
        kinds |= {"_h0": pa.int64(), "_h1": pa.int64(), "_fifo": pa.list_(table.schema.field(id_col).type)}
        return pa.table([pa.array([], kinds[f.name]) for f in out_schema.fields], names=[f.name for f in out_schema.fields])

    def again(rows: pa.Table, entry: pa.Table) -> pa.Table:
        return replayed(rows, entry.column("_entry")[0].as_py())

    keys = [*shards, "_blk"]
    rounds = [materialize(spread.groupBy(*keys).applyInArrow(lambda t: replayed(t, ()), schema=out_schema), "fifo-round")]
    while True:
        found = None
        for r, rows in enumerate(rounds):
            ends = rows.where("_fifo IS NOT NULL").select(*keys, F.lit(r).alias("_round"), "_h0", "_h1")
            found = ends if found is None else found.unionByName(ends)
        latest = materialize(found.groupBy(*keys).agg(F.max_by(F.struct("_round", "_h0", "_h1"), "_round").alias("_l"))
                             .select(*keys, "_l.*"), "fifo-ends")
        before = latest.select(*[c(k).alias(f"_p_{k}") for k in shards], (c("_blk") + 1).alias("_p__blk"), c("_h1").alias("_p_h1"),
                               c("_round").alias("_p_round"))
        same = [c(k).eqNullSafe(c(f"_p_{k}")) for k in keys]
        dirty = latest.join(before, same).where(c("_h0") != c("_p_h1")).select(*keys, "_p_round")
        if len(rounds) > EAGER_ROUNDS:
            first = dirty.groupBy(*[c(k).alias(f"_p_{k}") for k in shards]).agg(F.min("_blk").alias("_p__blk"))
            dirty = dirty.join(first, same).select(*keys, "_p_round") if shards else \
                dirty.join(F.broadcast(first), same).select(*keys, "_p_round")
        dirty = materialize(dirty, "fifo-dirty")
        if dirty.isEmpty():
            break
        entries = None
        for r, rows in enumerate(rounds):
            ends = rows.where("_fifo IS NOT NULL").select(*[c(k).alias(f"_p_{k}") for k in shards], (c("_blk") + 1).alias("_p__blk"),
                                                          c("_fifo").alias("_entry"))
            one = dirty.where(c("_p_round") == r).join(ends, same).select(*keys, "_entry")
            entries = one if entries is None else entries.unionByName(one)
        rows = blocked
        few = dirty.select("_blk").distinct().limit(101).collect()          # at most 101 numbers, to skip other row groups
        if len(few) <= 100:
            rows = rows.where(c("_blk").isin([r[0] for r in few]))
        marks = dirty.select(*[c(k).alias(f"_p_{k}") for k in keys])
        rows = rows.join(marks, same, "left_semi")
        rounds.append(materialize(rows.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(again, schema=out_schema), "fifo-round"))
    out = None
    last = latest.select(*[c(k).alias(f"_p_{k}") for k in keys], c("_round").alias("_p_round"))
    for r, rows in enumerate(rounds):
        one = rows.where("_fifo IS NULL").join(last.where(c("_p_round") == r), same, "left_semi")
        out = one if out is None else out.unionByName(one)
    return out.select(*df.columns, out_col)

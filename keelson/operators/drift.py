"""Rolling upper median over a count window, and the drift filter (Q5-Q6).

The window is the last ``window`` rows including the current one, in ``seq``
order, over the whole input (or per ``partition_cols``).  The median is the
sorted element at index n // 2 (upper median, no averaging).

Plan (exact, parallel):
  dense index -> block = idx div B -> the last (window-1) rows of each block are
  copied into the next block as a halo -> one Arrow fold per block computes the
  rolling median with a skip-list quantile (pandas ``rolling().quantile`` with
  ``interpolation='higher'``, which is sorted[n // 2]) -> halo rows dropped.
Each block holds at most B + window - 1 rows, so no task grows with the data.
Columns other than seq/ts pass through the fold as Arrow arrays untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators.order import dense_index, require_seq
from keelson.schema import DRIFT_TOLERANCE_MS, DRIFT_WARMUP, DRIFT_WINDOW
from keelson.session import default_parallelism

BLOCK_ROWS = 65536


def _rolling_upper_median(ts: np.ndarray, window: int) -> np.ndarray:
    import pandas as pd
    if len(ts) == 0:
        return ts.astype("int64")
    # roll over ranks, which float64 holds exactly whatever the timestamps' range
    values, rank = np.unique(ts, return_inverse=True)
    med = pd.Series(rank.astype("float64")).rolling(window, min_periods=1).quantile(0.5, interpolation="higher")
    return values[med.to_numpy().astype("int64")]


def near_median(ts: np.ndarray, median: np.ndarray, tolerance: int) -> np.ndarray:
    """|ts - median| <= tolerance without overflow, for any int64."""
    info = np.iinfo(np.int64)
    low = np.where(median < info.min + tolerance, info.min, median - np.int64(tolerance))
    high = np.where(median > info.max - tolerance, info.max, median + np.int64(tolerance))
    return (ts >= low) & (ts <= high)


def rolling_median(df: DataFrame, ts_col: str = "ts", seq_col: str = "seq",
                   window: int = DRIFT_WINDOW, partition_cols: Sequence[str] = (),
                   block_rows: int | None = None, n_rows: int | None = None,
                   rows_per_range: int | None = None, out_col: str = "median",
                   count_col: str = "window_rows") -> DataFrame:
    """Add the rolling upper median ``out_col`` and the window fill ``count_col``."""
    require_seq(df, seq_col)
    pcols = list(partition_cols)
    if n_rows is None:
        n_rows = df.count()
    if block_rows is None:
        # about one block per core on small inputs, BLOCK_ROWS at scale; halo overhead <= 25%
        per_core = -(-n_rows // default_parallelism(df.sparkSession))
        block_rows = max(4 * window, min(BLOCK_ROWS, per_core))
    if block_rows < window:
        raise ValueError("block_rows must be at least the window length")
    kw = {} if rows_per_range is None else {"rows_per_range": rows_per_range}
    idx = dense_index(df, seq_col, pcols, n_rows=n_rows, **kw)
    halo = window - 1
    blk = F.floor(F.col("_idx") / block_rows).cast("bigint")
    in_halo = (F.col("_idx") % block_rows) >= (block_rows - halo)
    targets = F.when(in_halo & F.lit(halo > 0), F.array(blk, blk + 1)).otherwise(F.array(blk))
    spread = idx.withColumn("_blk", F.explode(targets)) \
        .withColumn("_own", F.col("_blk") == blk) \
        .repartition(*pcols, "_blk")          # blocks in parallel, whatever the index plan's partitioning

    out_schema = T.StructType(
        [f for f in spread.schema.fields if f.name != "_own"]
        + [T.StructField(out_col, T.LongType(), False), T.StructField(count_col, T.IntegerType(), False)])
    names = [f.name for f in out_schema.fields]

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_idx", "ascending"), ("_own", "ascending")])
        ts = table.column(ts_col).to_numpy(zero_copy_only=False).astype("int64")
        med = _rolling_upper_median(ts, window)
        own = table.column("_own")
        idxs = table.column("_idx").to_numpy(zero_copy_only=False)
        filled = np.minimum(idxs + 1, window).astype("int32")
        table = table.append_column(out_col, pa.array(med, pa.int64())) \
            .append_column(count_col, pa.array(filled, pa.int32()))
        table = table.filter(own)
        return table.select(names)

    folded = spread.groupBy(*pcols, "_blk").applyInArrow(fold, schema=out_schema)
    return folded.drop("_blk", "_idx")


def drift_filter(df: DataFrame, ts_col: str = "ts", seq_col: str = "seq",
                 window: int = DRIFT_WINDOW, warmup: int = DRIFT_WARMUP,
                 tolerance_ms: int = DRIFT_TOLERANCE_MS, partition_cols: Sequence[str] = (),
                 out_col: str = "drift_ok", **kw) -> DataFrame:
    """Flag rows whose ts is within ``tolerance_ms`` of the rolling median.

    The first ``warmup - 1`` rows pass whatever their ts.  Nothing is dropped.
    """
    med = rolling_median(df, ts_col, seq_col, window, partition_cols, **kw)
    # the difference of two int64 can overflow: then it is certainly out of tolerance
    apart = F.try_subtract(F.col(ts_col), F.col("median"))
    near = F.coalesce((apart >= -tolerance_ms) & (apart <= tolerance_ms), F.lit(False))
    ok = (F.col("window_rows") < warmup) | near
    return med.withColumn(out_col, ok)


def rolling_median_native(df: DataFrame, ts_col: str = "ts", seq_col: str = "seq",
                          window: int = DRIFT_WINDOW, partition_cols: Sequence[str] = ()) -> DataFrame:
    """Cross-check form: one window frame with ``sort_array(collect_list)``.

    Without ``partition_cols`` this runs in a single task; use it on small
    inputs only (tests), never in production plans.
    """
    w = (Window.partitionBy(*partition_cols) if partition_cols else Window) \
        .orderBy(seq_col).rowsBetween(-(window - 1), 0)
    vals = F.sort_array(F.collect_list(F.col(ts_col)).over(w))
    return df.withColumn("median", F.element_at(vals, (F.size(vals) / 2).cast("int") + 1)) \
        .withColumn("window_rows", F.size(vals))

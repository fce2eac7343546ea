"""Prefix scans without a single-task window.

``running_max`` and ``running_sum`` work in ``seq`` order on two levels: rows lie in ~equal ranges (``operators.order``); each range is
reduced to one value, the range values are prefixed on a table of K rows, and each range finishes its own running value with a window
partitioned by range. Rows that carry their range (``_rng``) keep it, so several scans over one order share one range partitioning.

``block_entries`` scans any associative function of a state over blocks, on as many levels as the blocks need.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators.order import ROWS_PER_RANGE, join_ranges, range_count, seq_ranges


def running_max(df: DataFrame, value_col: str, seq_col: str = "seq", out_col: str = "running_max",
                inclusive: bool = True, n_rows: int | None = None,
                rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """max(value) over all rows with smaller seq (and the row itself when inclusive); NULLs ignored."""
    if n_rows is None:
        n_rows = df.count()
    ranged = seq_ranges(df, seq_col, n_rows, rows_per_range)
    totals = ranged.groupBy("_rng").agg(F.max(value_col).alias("_rmax"))
    before = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select("_rng", F.max("_rmax").over(before).alias("_pmax"))
    joined = join_ranges(ranged, prefix, range_count(n_rows, rows_per_range))
    end = 0 if inclusive else -1
    w = Window.partitionBy("_rng").orderBy(seq_col).rowsBetween(Window.unboundedPreceding, end)
    return joined.withColumn(out_col, F.greatest(F.col("_pmax"), F.max(value_col).over(w))) \
        .drop("_pmax", *([] if "_rng" in df.columns else ["_rng"]))


def running_sum(df: DataFrame, value_col: str, order_col: str, out_col: str = "running_sum",
                inclusive: bool = True, n_rows: int | None = None,
                rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """sum(value) over rows ordered before (and with inclusive, at) each row; two-level, no single task."""
    if n_rows is None:
        n_rows = df.count()
    ranged = seq_ranges(df, order_col, n_rows, rows_per_range)
    totals = ranged.groupBy("_rng").agg(F.sum(value_col).alias("_rsum"))
    before = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select("_rng", F.coalesce(F.sum("_rsum").over(before), F.lit(0)).alias("_psum"))
    joined = join_ranges(ranged, prefix, range_count(n_rows, rows_per_range))
    end = 0 if inclusive else -1
    w = Window.partitionBy("_rng").orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    return joined.withColumn(out_col, F.col("_psum") + F.coalesce(F.sum(value_col).over(w), F.lit(0))) \
        .drop("_psum", *([] if "_rng" in df.columns else ["_rng"]))


def range_min_table(blocks: DataFrame, pos_col: str, value_col: str, n: int | None = None) -> DataFrame:
    """Sparse table over a (small) per-block table: rows (level, pos, m) with
    m = min(value over [pos, pos + 2^level)).  log2(#blocks) levels, each one
    equi self-join; queries then need two equi lookups and no pairs."""
    from keelson.plans.joins import materialize
    if n is None:
        n = blocks.count()
    level = blocks.select(F.lit(0).alias("level"), F.col(pos_col).alias("pos"), F.col(value_col).alias("m"))
    levels = [level]
    span = 1
    while span * 2 <= n:
        nxt = level.alias("a").join(level.alias("b"), F.col("b.pos") == F.col("a.pos") + span, "inner") \
            .select((F.col("a.level") + 1).alias("level"), F.col("a.pos").alias("pos"),
                    F.least(F.col("a.m"), F.col("b.m")).alias("m"))
        level = materialize(nxt)
        levels.append(level)
        span *= 2
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def block_entries(blocks: DataFrame, key_cols: list[str], idx_col: str, summary_col: str,
                  combine: Callable[[list[bytes]], bytes], advance: Callable[[bytes, bytes], bytes], start: bytes,
                  starts: DataFrame | None = None, fan: int = 256) -> DataFrame:
    """The state in which each block is entered: (key, idx, entry), by an associative parallel prefix scan.

    A block's ``summary`` is a function on states, as bytes: ``advance(state, summary)`` applies it, and
    ``combine(summaries)`` composes consecutive ones. Up the tree, runs of ``fan`` blocks of a key become one summary;
    down again, every run is walked from the state in which it is entered. So no task sees more than ``fan`` summaries of a
    key, however many blocks it has. Blocks are ordered by ``idx`` (not negative, gaps allowed). Every key starts in ``start``, or in
    the ``entry`` that ``starts`` (key columns, entry) has for it. Null keys are keys like any other.
    """
    from keelson.plans.joins import materialize
    keys = [F.col(c) for c in key_cols]
    level = materialize(blocks.select(*key_cols, F.col(idx_col).cast("long").alias("idx"), F.col(summary_col).alias("summary")), "scan")
    kinds = [level.schema[c] for c in key_cols]
    up = T.StructType([*kinds, T.StructField("idx", T.LongType()), T.StructField("summary", T.BinaryType())])
    down = T.StructType([*kinds, T.StructField("idx", T.LongType()), T.StructField("entry", T.BinaryType())])

    def fold(run: pa.Table) -> pa.Table:
        run = run.sort_by("idx")
        one = run.slice(0, 1)
        whole = combine([bytes(b) for b in run.column("summary").to_pylist()])
        return pa.table([*(one.column(c) for c in key_cols), pa.array([one.column("idx")[0].as_py() // fan], pa.int64()),
                         pa.array([whole], pa.binary())], names=up.names)

    def walk(run: pa.Table) -> pa.Table:
        run = run.sort_by("idx")
        first = run.column("entry")[0].as_py()
        state, out = start if first is None else bytes(first), []
        for b in run.column("summary").to_pylist():
            out.append(state)
            state = advance(state, bytes(b))
        return pa.table([*(run.column(c) for c in key_cols), run.column("idx"), pa.array(out, pa.binary())], names=down.names)

    top = level.agg(F.max("idx")).first()[0]
    levels = [level]
    while top is not None and top >= fan:
        run = F.floor(F.col("idx") / fan)
        levels.append(materialize(levels[-1].groupBy(*keys, run.alias("_run")).applyInArrow(fold, up), "scan"))
        top //= fan
    if starts is None:
        entered = levels[-1].withColumn("entry", F.lit(None).cast("binary"))
    else:
        own = starts.select(*[F.col(c).alias(f"_s_{c}") for c in key_cols], "entry")
        same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in key_cols]
        entered = levels[-1].join(own, same, "left").select(*keys, "idx", "summary", "entry")
    entries = entered.groupBy(*keys).applyInArrow(walk, down)
    for below in reversed(levels[:-1]):
        above = entries.select(*[F.col(c).alias(f"_s_{c}") for c in key_cols], F.col("idx").alias("_run"), "entry")
        same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in key_cols]
        met = below.join(above, [*same, F.floor(F.col("idx") / fan) == F.col("_run")])
        entries = met.select(*keys, "_run", "idx", "summary", "entry").groupBy(*keys, "_run").applyInArrow(walk, down)
    return entries

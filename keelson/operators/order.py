"""Order helpers: every order-dependent operator takes an explicit order, one column (``seq``) or several.

``dense_index`` numbers rows 0..n-1 in that order (per ``partition_cols``) without a single-task sort:

1. ``range_table`` range-partitions the rows by (partition columns, order columns) into K = n / ``rows_per_range`` ranges, sorts each, and writes
   them once with the range and the position in it. Both are stored, so later readers agree on them whatever is recomputed;
2. rows are counted per range - K numbers - and turned into running offsets;
3. a row's index is its range's offset plus its position, less the first index of its partition key.

One exchange moves the rows. Spark samples the range bounds; equal values share a range. A hot partition key spreads over as many ranges as its rows
need. Row numbers within a range take 33 bits, so a range holds at most 8 * 10^9 rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.plans.joins import BROADCAST_MAX_ROWS, join_checked, materialize

ROWS_PER_RANGE = 1_000_000


def order_columns(seq_col: str | Sequence[str]) -> list[str]:
    return [seq_col] if isinstance(seq_col, str) else list(seq_col)


def require_seq(df: DataFrame, seq_col: str | Sequence[str]) -> None:
    for c in order_columns(seq_col):
        if c not in df.columns:
            raise ValueError(f"order-dependent operator needs a total-order column '{c}'")


def checked_seq(df: DataFrame, seq_col: str | Sequence[str]) -> DataFrame:
    """``df`` with order columns that raise on NULL: such a row has no place in the order, at any input size."""
    require_seq(df, seq_col)
    for c in order_columns(seq_col):
        missing = F.raise_error(F.lit(f"NULL in order column '{c}'")).cast(df.schema[c].dataType)
        df = df.withColumn(c, F.when(F.col(c).isNull(), missing).otherwise(F.col(c)))
    return df


def range_count(n_rows: int, rows_per_range: int = ROWS_PER_RANGE) -> int:
    return max(1, -(-n_rows // max(1, rows_per_range)))


def range_table(df: DataFrame, seq_col: str | Sequence[str], n_rows: int, rows_per_range: int = ROWS_PER_RANGE,
                partition_cols: Sequence[str] = ()) -> DataFrame:
    """The rows in range partitions of (``partition_cols``, order), written once, with ``_rng`` (ranges count from 0 in order; some may be
    empty) and ``_pos`` (from 0 in each range)."""
    cols = [*partition_cols, *order_columns(seq_col)]
    ranges = checked_seq(df, seq_col).repartitionByRange(range_count(n_rows, rows_per_range), *cols).sortWithinPartitions(*cols)
    written = materialize(ranges.withColumn("_mark", F.monotonically_increasing_id()), "ranges")
    return written.withColumns({"_rng": F.shiftright("_mark", 33), "_pos": F.col("_mark").bitwiseAND((1 << 33) - 1)}).drop("_mark")


def seq_ranges(df: DataFrame, seq_col: str | Sequence[str], n_rows: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``_rng``: the index of the range holding each row. Rows that carry it already keep it."""
    if "_rng" in df.columns:
        return df
    if range_count(n_rows, rows_per_range) == 1:
        return checked_seq(df, seq_col).withColumn("_rng", F.lit(0).cast("long"))
    return range_table(df, seq_col, n_rows, rows_per_range).drop("_pos")


def range_offsets(ranged: DataFrame) -> DataFrame:
    """(``_rng``, ``_off``): rows in earlier ranges; one row per range."""
    counts = ranged.groupBy("_rng").agg(F.count(F.lit(1)).alias("_cnt"))
    return counts.select("_rng", (F.sum("_cnt").over(Window.orderBy("_rng")) - F.col("_cnt")).alias("_off"))


def join_ranges(ranged: DataFrame, per_range: DataFrame, k: int) -> DataFrame:
    """Rows with a value of their range; ``per_range`` has at most ``k`` rows, known before the plan runs."""
    return ranged.join(F.broadcast(per_range) if k <= BROADCAST_MAX_ROWS else per_range, "_rng")


def dense_index(df: DataFrame, seq_col: str | Sequence[str] = "seq", partition_cols: Sequence[str] = (),
                n_rows: int | None = None, rows_per_range: int = ROWS_PER_RANGE, out_col: str = "_idx") -> DataFrame:
    """Add a 0-based dense index in order within ``partition_cols`` (NULL keys are one partition). ``n_rows`` may be an upper bound."""
    require_seq(df, seq_col)
    pcols = list(partition_cols)
    if n_rows is None:
        n_rows = df.count()
    if n_rows <= rows_per_range:
        # one range: a single bounded sort (at most rows_per_range rows per partition key)
        w = Window.partitionBy(*pcols).orderBy(*order_columns(seq_col)) if pcols else Window.orderBy(*order_columns(seq_col))
        return checked_seq(df, seq_col).withColumn(out_col, F.row_number().over(w).cast("long") - 1)
    ranged = range_table(df, seq_col, n_rows, rows_per_range, pcols)
    indexed = join_ranges(ranged, range_offsets(ranged), range_count(n_rows, rows_per_range)) \
        .withColumn(out_col, F.col("_off") + F.col("_pos")).drop("_off", "_pos", "_rng")
    if not pcols:
        return indexed
    firsts = indexed.groupBy(*[F.col(c).alias(f"_k_{c}") for c in pcols]).agg(F.min(out_col).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in pcols]
    return join_checked(indexed, firsts, on=same, how="inner").withColumn(out_col, F.col(out_col) - F.col("_first")) \
        .drop("_first", *[f"_k_{c}" for c in pcols])


def previous_seq(df: DataFrame, key_cols: Sequence[str], seq_col: str = "seq", out_col: str = "_prev",
                 max_key_rows: int = ROWS_PER_RANGE) -> DataFrame:
    """seq of the previous row with the same key (NULL for the first), skew-safe.

    The largest key is measured with a partial aggregate.  When it fits one task
    (<= ``max_key_rows``) a ``lag`` window per key is used; otherwise each key
    gets a dense index (hot keys are split across seq ranges) and the previous
    row is found by an equi self-join on (key, idx - 1), which spreads evenly.
    """
    keys = list(key_cols)
    biggest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("m")).first()["m"] or 0
    if biggest <= max_key_rows:
        return df.withColumn(out_col, F.lag(seq_col).over(Window.partitionBy(*keys).orderBy(seq_col)))
    idx = dense_index(df, seq_col, keys, out_col="_kidx", rows_per_range=max_key_rows)
    prev = idx.select(*[F.col(k).alias(f"_p_{k}") for k in keys], (F.col("_kidx") + 1).alias("_p_idx"), F.col(seq_col).alias(out_col))
    same = F.col("_kidx") == F.col("_p_idx")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_p_{k}"))
    return idx.join(prev, same, "left").drop("_kidx", "_p_idx", *[f"_p_{k}" for k in keys])

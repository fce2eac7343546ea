"""Summary statistics.

Percentiles follow the reference's nearest-rank rule on ascending order:
pXX = sorted[floor(n * XX / 100)], p99.9 = sorted[min(n-1, floor(n * 999/1000))].
Values are counted, counts summed up in order, and the element picked by rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators.order import join_ranges, range_count, seq_ranges
from keelson.plans.joins import materialize_observed

# fixed values: (output name, rank numerator, rank denominator): element floor(n * num / den) of the ascending order
PERCENTILES = (("p50", 50, 100), ("p95", 95, 100), ("p99", 99, 100), ("p999", 999, 1000))


def latency_stats(df: DataFrame, value_col: str = "latency_us", group_cols: Sequence[str] = (),
                  rows_per_range: int = 1_000_000) -> DataFrame:
    """T1 over successful samples (value >= 0): n, avg, p50, p95, p99, p999, max; zeros when empty.

    Equal values are counted first; each group's counts are then summed up in two levels (ranges of values, then
    within a range), and the value at which the running count passes a rank is that percentile. No task holds a
    group: memory follows the rows of a range.
    """
    c = F.col
    keys = list(group_cols) or ["_all"]
    ok = df.where(c(value_col) >= 0)
    ok = (ok if group_cols else ok.withColumn("_all", F.lit(0))).select(*keys, c(value_col).alias("_v"))
    by_value, seen = materialize_observed(ok.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), "latency", n=F.count(F.lit(1)))
    ranged = seq_ranges(by_value, "_v", int(seen["n"]), rows_per_range)
    # at most groups x ranges rows
    totals = ranged.groupBy(*keys, "_rng").agg(F.sum("_n").alias("_t"), F.sum(c("_n") * c("_v")).alias("_s"), F.max("_v").alias("_m"))
    over_ranges = Window.partitionBy(*keys).orderBy("_rng")
    before = totals.select(*keys, "_rng", (F.sum("_t").over(over_ranges) - c("_t")).alias("_before"))
    whole = totals.groupBy(*keys).agg(F.sum("_t").alias("n"), F.sum("_s").alias("_sum"), F.max("_m").alias("max"))
    rows = ranged.join(before, [*keys, "_rng"])
    rows = rows.join(whole if group_cols else F.broadcast(whole), keys)       # without groups: one row
    inside = Window.partitionBy(*keys, "_rng").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_to", c("_before") + F.sum("_n").over(inside))
    picks = []
    for name, num, den in PERCENTILES:
        rank = F.least(c("n") - 1, F.expr(f"div(n * {num}, {den})"))
        picks.append(F.max(F.when((rank < c("_to")) & (rank >= c("_to") - c("_n")), c("_v"))).alias(name))
    found = rows.groupBy(*keys, "n", "_sum", "max").agg(*picks)
    out = found.select(*keys, "n", F.round(c("_sum") / c("n"), 3).alias("avg"), *[p[0] for p in PERCENTILES], "max")
    if not group_cols:        # without groups there is always one row
        out = df.sparkSession.range(1).select(F.lit(0).alias("_all")).join(out, "_all", "left")
    fill = {"n": 0, "avg": 0.0, "p50": 0, "p95": 0, "p99": 0, "p999": 0, "max": 0}
    return out.select(*group_cols, *[F.coalesce(c(k), F.lit(v)).cast("double" if k == "avg" else "bigint").alias(k)
                                     for k, v in fill.items()])


#: sketch size; the rank of a percentile is off by at most 2.3 / k of all samples or so with 99 % probability (0.12 %), however many are merged
SKETCH_K = 2000


def latency_sketch(df: DataFrame, value_col: str = "latency_us", group_cols: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """T1 for very many samples, in one pass: per group a mergeable quantile sketch (KLL) of successful samples with their n, sum and max. A sketch takes some
    kilobytes whatever n is; those of partitions, batches or days are merged with ``merge_latency_sketches``."""
    ok = df.where(F.col(value_col) >= 0)
    return ok.groupBy(*group_cols).agg(
        F.kll_sketch_agg_bigint(F.col(value_col).cast("long"), F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col(value_col).cast("decimal(38,0)")).alias("sum"), F.max(value_col).cast("long").alias("max")).where("n > 0")


def merge_latency_sketches(sketches: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """One sketch per group from many, with the same error."""
    return sketches.groupBy(*group_cols).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"), F.sum("n").alias("n"),
                                             F.sum("sum").alias("sum"), F.max("max").alias("max")).where("n > 0")


def latency_from_sketch(sketches: DataFrame) -> DataFrame:
    """The columns of ``latency_stats`` from sketches: n, avg and max exact, percentiles by the sketch."""
    keep = [c for c in sketches.columns if c not in ("sketch", "n", "sum", "max")]
    # just past the fraction: the element after a share of exactly num / den, as in sorted[floor(n * num / den)]
    picks = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(num / den + 1e-9)).alias(name) for name, num, den in PERCENTILES]
    return sketches.select(*keep, "n", F.round(F.col("sum").cast("double") / F.col("n"), 3).alias("avg"), *picks, "max")


def rank_errors(df: DataFrame, found: DataFrame, value_col: str = "latency_us", group_cols: Sequence[str] = ()) -> DataFrame:
    """``found`` (latency statistics) with ``<percentile>_error``: how far the value's true ranks are from the wanted one, as a share of n. One pass of
    conditional counts."""
    c = F.col
    keys = list(group_cols)
    names = [p for p, _, _ in PERCENTILES]
    wanted = found.select(*[c(k).alias(f"_k_{k}") for k in keys], *[c(p).alias(f"_v_{p}") for p in names])
    same = [c(k).eqNullSafe(c(f"_k_{k}")) for k in keys]
    rows = df.where(c(value_col) >= 0)
    rows = rows.join(wanted, same) if keys else rows.crossJoin(F.broadcast(wanted))         # without groups: one row
    counts = rows.groupBy(*keys).agg(*[F.count_if(c(value_col) < c(f"_v_{p}")).alias(f"_lt_{p}") for p in names],
                                     *[F.count_if(c(value_col) <= c(f"_v_{p}")).alias(f"_le_{p}") for p in names])
    met = found.join(counts.select(*[c(k).alias(f"_k_{k}") for k in keys], *[c(f"_{w}_{p}") for p in names for w in ("lt", "le")]), same) if keys \
        else found.crossJoin(counts)
    out = [c(x) for x in found.columns]
    for p, num, den in PERCENTILES:
        rank = F.least(c("n") - 1, F.floor(c("n") * num / den))
        off = F.greatest(c(f"_lt_{p}") - rank, rank - (c(f"_le_{p}") - 1), F.lit(0))
        out.append((off / c("n")).alias(f"{p}_error"))
    return met.select(*out)


def throughput(df: DataFrame, t_col: str = "t", value_col: str = "latency_us",
               group_cols: Sequence[str] = ()) -> DataFrame:
    """Sent, success, failed, elapsed seconds and events per second."""
    c = F.col
    out = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(c(value_col) >= 0).alias("success"),
        F.count_if(c(value_col) < 0).alias("failed"),
        ((F.max(t_col) - F.min(t_col)) / 1000.0).alias("elapsed_s"))
    qps = F.when(c("elapsed_s") > 0, F.round(c("sent") / c("elapsed_s"), 3))
    return out.withColumn("qps", qps).withColumn("elapsed_s", F.round("elapsed_s", 3))


INTERVAL_MS = 5000
INTERVAL_METRICS = ("routed", "hot", "cold", "rejected")


def interval_counts(routed: DataFrame, t_col: str, interval_ms: int = INTERVAL_MS, path_col: str = "effective_path") -> DataFrame:
    """Counts of judged rows by interval of a time in ms; any int64 is a time."""
    c = F.col
    start = F.coalesce(F.try_subtract(c(t_col), F.pmod(c(t_col), F.lit(interval_ms).cast("long"))), F.lit(-(1 << 63)).cast("long"))
    return routed.groupBy(start.alias("interval_start")).agg(
        F.count_if(c("passed")).alias("routed"),
        F.count_if(c("passed") & (c(path_col) == "hot")).alias("hot"),
        F.count_if(c("passed") & (c(path_col) == "cold")).alias("cold"),
        F.count_if(~c("passed")).alias("rejected"))


def running_totals(per: DataFrame, rows_per_range: int = 2_000_000) -> DataFrame:
    """Interval counts with their running totals.

    A two-level scan: intervals are grouped into ranges, range totals are
    prefixed, and each range adds its prefix to a running sum over its own rows
    - no single-task window over all intervals.
    """
    c = F.col
    # one row per interval: computed once (the upstream plan runs once), counted while it is written
    per, seen = materialize_observed(per, "intervals", n=F.count(F.lit(1)))
    ranged = seq_ranges(per, "interval_start", int(seen["n"]), rows_per_range)
    totals = ranged.groupBy("_rng").agg(*[F.sum(m).alias(f"_t_{m}") for m in INTERVAL_METRICS])
    wr = Window.orderBy("_rng")
    prefix = totals.select("_rng", *[(F.sum(f"_t_{m}").over(wr) - c(f"_t_{m}")).alias(f"_p_{m}") for m in INTERVAL_METRICS])
    joined = join_ranges(ranged, prefix, range_count(int(seen["n"]), rows_per_range))
    w = Window.partitionBy("_rng").orderBy("interval_start").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("interval_start", *INTERVAL_METRICS,
                         *[(c(f"_p_{m}") + F.sum(m).over(w)).cast("bigint").alias(f"total_{m}") for m in INTERVAL_METRICS])


def interval_stats(routed: DataFrame, t_col: str = "ts", interval_ms: int = INTERVAL_MS,
                   rows_per_range: int = 2_000_000) -> DataFrame:
    """Per interval routed/hot/cold/rejected counts plus running totals."""
    return running_totals(interval_counts(routed, t_col, interval_ms), rows_per_range)

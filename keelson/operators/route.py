"""Hot/cold routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.schema import HOT_EVENT_TYPES


def classify_path(df: DataFrame, hot_types: Sequence[str] = HOT_EVENT_TYPES,
                  out_col: str = "path") -> DataFrame:
    """R1: 'hot' iff event_type is one of ``hot_types`` (exact match), else 'cold'."""
    return df.withColumn(out_col, F.when(F.col("event_type").isin(list(hot_types)), "hot")
                         .otherwise("cold"))


def split_paths(df: DataFrame, path_col: str = "effective_path") -> tuple[DataFrame, DataFrame]:
    """R2: one routed frame, two outputs (persist the input when both are written)."""
    return df.where(F.col(path_col) == "hot"), df.where(F.col(path_col) == "cold")


def hot_with_fallback(routed: DataFrame, delivered_col: str | None = "delivered",
                      sink_available: bool = True) -> DataFrame:
    """A hot row whose hot write did not happen goes to cold.

    ``delivered_col`` holds the outcome of the hot write for hot rows (from the
    breaker timeline: allowed and succeeded).  With ``sink_available=False``
    every hot row falls back, as when the hot store is unreachable.
    """
    hot = F.col("path") == "hot"
    if not sink_available:
        delivered = F.lit(False)
    elif delivered_col is None:
        delivered = F.lit(True)
    else:
        delivered = F.coalesce(F.col(delivered_col), F.lit(False))
    fallback = hot & ~delivered
    return routed.withColumn("fallback", fallback) \
        .withColumn("effective_path", F.when(fallback, "cold").otherwise(F.col("path")))


def route_stats(routed: DataFrame) -> DataFrame:
    """hot_count counts classifications (a fallback stays counted as hot)."""
    c = F.col
    aggs = [F.count_if(c("path") == "hot").alias("hot_count"),
            F.count_if(c("path") == "cold").alias("cold_count")]
    if "fallback" in routed.columns:
        aggs.append(F.count_if(c("fallback")).alias("hot_fallback_cold"))
    else:
        aggs.append(F.lit(0).cast("bigint").alias("hot_fallback_cold"))
    return routed.agg(*aggs)

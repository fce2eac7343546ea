"""Parallelism floor for row-local heavy work.

On a cluster the scan already yields thousands of splits and this is a no-op.
A small input stored as one row group (as in local tests) would otherwise run
its per-row hashing and codec work in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from keelson.session import default_parallelism


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    want = min_partitions or default_parallelism(df.sparkSession)
    try:
        have = df.rdd.getNumPartitions()
    except Exception:  # Spark Connect: no RDD view; leave the plan alone
        return df
    return df.repartition(want) if have < want else df

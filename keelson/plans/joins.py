"""Join helpers that broadcast only behind a measured size bound.

``materialize_small`` writes a (presumed small) side once, counting and measuring it on the way; ``join_checked`` broadcasts
it only when rows and bytes are under the limits, and otherwise leaves the choice to Catalyst/AQE (sort-merge join with skew
splitting).  ``materialize`` cuts
lineage with a Parquet table in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: write the rows once as Parquet under ``spark.checkpoint.dir`` and read them back.

    The plan runs once, the files are on shared storage (a lost executor re-reads them instead of recomputing lineage),
    and later readers prune columns.
    """
    from keelson.session import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_observed(df: DataFrame, name: str = "stage", **metrics) -> tuple[DataFrame, dict]:
    """``materialize`` plus aggregate metrics observed while the same job runs (no extra pass)."""
    import uuid

    from pyspark.sql import Observation
    obs = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    out = materialize(df.observe(obs, *[m.alias(k) for k, m in metrics.items()]), name)
    return out, obs.get


_FIXED_BYTES = {"long": 8, "integer": 4, "boolean": 1, "double": 8, "short": 2, "byte": 1, "float": 4, "timestamp": 8, "date": 4}


def row_bytes_estimate(df: DataFrame) -> int:
    return 16 + sum(_FIXED_BYTES.get(f.dataType.typeName(), 48) for f in df.schema.fields)


def _bytes(df: DataFrame) -> Column:
    """Bytes of all rows: texts and binaries as long as they are, other columns by their type."""
    size = F.lit(16)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        size = size + (8 + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if kind in ("string", "binary") else _FIXED_BYTES.get(kind, 48))
    return F.coalesce(F.sum(size.cast("long")), F.lit(0))


def materialize_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    """Write ``df`` once to the shared folder, counted and measured as it is written, and report whether it may be broadcast."""
    small, seen = materialize_observed(df, "small", n=F.count(F.lit(1)), bytes=_bytes(df))
    return small, seen["n"] <= max_rows and seen["bytes"] <= max_bytes


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Write ``df`` once and return it with its row count; derived tables
    of at most that many rows inherit the count as their size bound."""
    small, seen = materialize_observed(df, "counted", n=F.count(F.lit(1)))
    return small, seen["n"]


def fits_broadcast(n_rows: int, df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                   max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    return n_rows <= max_rows and n_rows * row_bytes_estimate(df) <= max_bytes


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "left",
                 max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES,
                 already_checked: bool | None = None) -> DataFrame:
    """Join with ``small`` broadcast iff its measured size is under the limits."""
    if already_checked is None:
        small, already_checked = materialize_small(small, max_rows, max_bytes)
    right = F.broadcast(small) if already_checked else small
    return big.join(right, on=on, how=how)

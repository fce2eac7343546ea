"""Sinks (K1-K9): hot log, cold table, dead letters and replay.

All writers are idempotent per ``batch_id``: each batch lands in its own
partition folder and a retry overwrites that folder only (dynamic partition
overwrite), so a re-run after an executor loss or a streaming restart cannot
duplicate rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.plans.joins import materialize_observed, materialize_small
from keelson.schema import COLD_FIELDS, COLD_ORDER, COLD_ROW, SINK_RETRIES, SINK_RETRY_PAUSE_S


def project_hot(df: DataFrame) -> DataFrame:
    """K1: the five attributes of a hot log entry, all as strings; payload dropped."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in COLD_FIELDS])


def project_cold(df: DataFrame) -> DataFrame:
    """K3: cold row; ts stays BIGINT; payload dropped."""
    return df.select(*[F.col(c) for c in COLD_FIELDS])


def _write_partition(df: DataFrame, path: str, batch_id: int | str, fmt: str = "parquet",
                     max_records_per_file: int | None = None) -> None:
    out = df.withColumn("batch_id", F.lit(str(batch_id)))
    w = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.format(fmt).save(path)


def write_hot(df: DataFrame, path: str, batch_id: int | str) -> None:
    """K2: append to the hot log; entry id = (batch_id, seq), in append order."""
    hot = project_hot(df)
    if "seq" in df.columns:
        log_id = F.concat(F.lit(f"{batch_id}-"), F.col("seq").cast("string")).alias("log_id")
        hot = df.select(*[F.col(c).cast("string").alias(c) for c in COLD_FIELDS], log_id)
    _write_partition(hot, path, batch_id)


def write_cold(df: DataFrame, path: str, batch_id: int | str | Column,
               max_records_per_file: int | None = None) -> None:
    """K4: create-if-missing then append, physical order (ts, event_type) in each file. ``batch_id`` may be a column: rows of many batches
    are then written in one job, each batch to its own partition, as one by one."""
    by_batch = isinstance(batch_id, Column)
    rows = df.withColumn("_batch", batch_id.cast("string")) if by_batch else df
    cold = rows.select(*COLD_FIELDS, *(["_batch"] if by_batch else []))
    cold = cold.sortWithinPartitions(*(["_batch"] if by_batch else []), *COLD_ORDER)
    if by_batch:
        out = cold.withColumnRenamed("_batch", "batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
        (out.option("maxRecordsPerFile", max_records_per_file) if max_records_per_file else out).parquet(path)
    else:
        _write_partition(cold, path, batch_id, max_records_per_file=max_records_per_file)


def to_dead_letter_json(df: DataFrame, out_col: str = "line") -> DataFrame:
    """K7: one JSON object per row, fields in cold-row order.

    Deliberate deviation: control characters are escaped too, so every line is
    valid JSON.
    """
    return df.select(F.to_json(F.struct(*[F.col(c) for c in COLD_FIELDS])).alias(out_col))


def write_with_dead_letter(df: DataFrame, write: Callable[[DataFrame, int], None], dead_letter_path: str,
                           batch_id: int, retries: int = SINK_RETRIES,
                           pause_s: float = SINK_RETRY_PAUSE_S) -> dict:
    """K6: try ``write`` up to ``retries`` times, ``pause_s`` apart; then dead-letter every row.

    Only storage errors are retried and dead-lettered; anything else (a schema error, say) is raised. Returns an
    accounting dict (K9): rows, attempts, dead_lettered and error (that of the last failed attempt, also where a later
    one succeeded; None if none failed).
    """
    rows, seen = materialize_observed(project_cold(df), "cold-batch", n=F.count(F.lit(1)))
    n, error = seen["n"], None
    for attempt in range(1, retries + 1):
        try:
            write(rows, attempt)
            return {"batch_id": batch_id, "rows": n, "attempts": attempt, "dead_lettered": 0, "error": error}
        except (OSError, Py4JJavaError) as e:
            error = str(e)[:500]
            if attempt < retries:
                time.sleep(pause_s)
    dl = to_dead_letter_json(rows)
    dl.withColumn("batch_id", F.lit(str(batch_id))).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").text(dead_letter_path)
    return {"batch_id": batch_id, "rows": n, "attempts": retries, "dead_lettered": n, "error": error}


def read_dead_letters(spark: SparkSession, dead_letter_path: str) -> DataFrame:
    """Dead letters as cold rows; a corrupt line raises instead of becoming a row of NULLs."""
    return spark.read.schema(COLD_ROW).option("mode", "FAILFAST").json(dead_letter_path).select(*COLD_FIELDS)


def replay_dead_letter(spark: SparkSession, dead_letter_path: str, cold: DataFrame) -> DataFrame:
    """K8: dead-lettered rows not yet in the cold table (anti join on event_id).

    The cold table is only scanned for ``event_id`` and semi-joined against the
    (measured) dead-letter ids, so it is never shuffled; the caller appends the
    result with ``write_cold``.
    """
    dl = read_dead_letters(spark, dead_letter_path)
    ids, small = materialize_small(dl.select("event_id").distinct())
    present = cold.select("event_id").join(F.broadcast(ids) if small else ids, "event_id", "left_semi")
    return dl.join(present.distinct(), "event_id", "left_anti").select(*COLD_FIELDS)


def flush_accounting(df: DataFrame, name: str = "flush") -> tuple[DataFrame, object]:
    """K9: rows written per batch, observed while the write runs."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs

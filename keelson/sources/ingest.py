"""Event sources and admission rules.

The network service of the reference is not rebuilt; its data rules are:
single events over 65,536 payload bytes are refused; a batch of more than 1,000
events is refused whole; inside an accepted batch oversize events are dropped
silently and the ack reads ``batch:<accepted>``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.plans.joins import join_checked
from keelson.schema import (ACK_OK, BATCH_ACK_PREFIX, BATCH_TOO_LARGE, COMPATIBLE_VERSIONS, EVENT,
                            MAX_BATCH_EVENTS, MAX_PAYLOAD_BYTES, PAYLOAD_TOO_LARGE)


def read_event_topic(spark: SparkSession, brokers: str, topic: str, group_id: str,
                     fmt: str = "kafka", path: str | None = None, schema=None, rows: DataFrame | None = None) -> DataFrame:
    """Stream of raw event bytes in column ``value``, starting at the earliest offset, with the topic's partition,
    offset and arrival timestamp, from which order-dependent operators make their ``seq`` and arrival time.

    Offsets are tracked by the query checkpoint (the reference auto-commits).
    ``fmt`` other than "kafka" reads a file stream (for tests, where the Kafka
    connector is not on the classpath); such files must hold a ``value`` column. ``rows`` is a stream opened by the caller instead.
    """
    if fmt == "kafka":
        return (spark.readStream.format("kafka")
                .option("kafka.bootstrap.servers", brokers)
                .option("subscribe", topic)
                .option("kafka.group.id", group_id)
                .option("startingOffsets", "earliest")
                .load()
                .select("value", "partition", "offset", "timestamp"))
    if rows is None:
        reader = spark.readStream.format(fmt)
        rows = (reader if schema is None else reader.schema(schema)).load(path)
    return rows.select("value", *[c for c in ("partition", "offset", "timestamp", "seq") if c in rows.columns])


def read_event_files(spark: SparkSession, path: str, fmt: str = "parquet",
                     streaming: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """Single events as a table or stream with the fixed event schema."""
    if streaming:
        r = spark.readStream.schema(EVENT).format(fmt)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        return r.load(path)
    return spark.read.schema(EVENT).format(fmt).load(path)


def admit_events(df: DataFrame, payload_col: str = "payload", size_col: str | None = None) -> DataFrame:
    """``admitted`` and ``message`` per event (65,536 bytes pass)."""
    size = F.col(size_col) if size_col else F.octet_length(payload_col)
    ok = size <= MAX_PAYLOAD_BYTES
    return df.withColumn("admitted", ok) \
        .withColumn("message", F.when(ok, F.lit(ACK_OK)).otherwise(F.lit(PAYLOAD_TOO_LARGE)))


def received_count(admitted: DataFrame) -> DataFrame:
    return admitted.agg(F.count_if(F.col("admitted")).alias("received"))


def admit_batch_arrays(df: DataFrame, events_col: str = "events") -> DataFrame:
    """I4, nested form: one ack per batch row and the accepted events as an array."""
    evs = F.col(events_col)
    ok = F.size(evs) <= MAX_BATCH_EVENTS
    kept = F.filter(evs, lambda e: F.octet_length(e["payload"]) <= MAX_PAYLOAD_BYTES)
    accepted = F.when(ok, kept).otherwise(F.array().cast(df.schema[events_col].dataType))
    return df.withColumn("accepted", accepted) \
        .withColumn("success", ok) \
        .withColumn("message", F.when(ok, F.concat(F.lit(BATCH_ACK_PREFIX), F.size("accepted").cast("string")))
                    .otherwise(F.lit(BATCH_TOO_LARGE)))


def explode_accepted(acked: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return acked.select(*keep, F.explode("accepted").alias("event")).select(*keep, "event.*")


def batch_acks(rows: DataFrame, batch_col: str = "batch_id", size_col: str = "payload_size") -> DataFrame:
    """I4, flat form: one ack row per batch from event rows tagged with a batch id.

    The size test counts events before the oversize drop.  Partial aggregation
    keeps a large batch from landing in one task.
    """
    small = F.col(size_col) <= MAX_PAYLOAD_BYTES
    agg = rows.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_events"),
                                      F.count_if(small).alias("n_small"))
    ok = F.col("n_events") <= MAX_BATCH_EVENTS
    accepted = F.when(ok, F.col("n_small")).otherwise(F.lit(0))
    return agg.select(batch_col, "n_events", accepted.cast("bigint").alias("accepted"),
                      ok.alias("success"),
                      F.when(ok, F.concat(F.lit(BATCH_ACK_PREFIX), accepted.cast("string")))
                      .otherwise(F.lit(BATCH_TOO_LARGE)).alias("message"))


def admitted_batch_rows(rows: DataFrame, acks: DataFrame, batch_col: str = "batch_id",
                        size_col: str = "payload_size") -> DataFrame:
    """Rows that enter the flow: batch accepted and event not oversize."""
    good = acks.where(F.col("success")).select(batch_col)
    kept = join_checked(rows.where(F.col(size_col) <= MAX_PAYLOAD_BYTES), good, on=[batch_col],
                        how="left_semi")
    return kept


def filter_compatible(df: DataFrame, version_col: str = "schema_version",
                      versions: DataFrame | Iterable[int] | None = None, rejects: bool = False) -> DataFrame:
    """Keep rows whose schema version is compatible (1, 2, 3); unknown ones are not.

    ``versions`` may be a table ``(version, compatible)``; it is measured and
    broadcast for a semi (or anti, with ``rejects=True``) join.
    """
    how = "left_anti" if rejects else "left_semi"
    if versions is None or not isinstance(versions, DataFrame):
        allowed = list(versions) if versions is not None else list(COMPATIBLE_VERSIONS)
        cond = F.col(version_col).isin(allowed)
        return df.where(~cond | F.col(version_col).isNull() if rejects else cond)
    table = versions.where(F.col("compatible")).select(F.col("version").alias(version_col))
    return join_checked(df, table, on=[version_col], how=how)


def union_sources(*sources: DataFrame, tags: Sequence[str] | None = None, tag_col: str = "source") -> DataFrame:
    """All inputs meet in one flow (optionally tagged by origin)."""
    if not sources:
        raise ValueError("no sources")
    out = None
    for i, s in enumerate(sources):
        if tags is not None:
            s = s.withColumn(tag_col, F.lit(tags[i]))
        out = s if out is None else out.unionByName(s)
    return out

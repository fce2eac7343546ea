"""State of micro-batch operators as tables in a shared folder, written by batch id.

A batch that runs again after a failure reads what it read the first time and overwrites what it wrote, so every operator here may be replayed. The id of
a batch is the one Structured Streaming gives to ``foreachBatch``: batches follow each other, and only the last one can come again.

* ``read_state`` / ``write_state``: one small table per batch.
* ``first_arrivals``: the accepted ids of a stream (Q4) as a table of generations.
* ``arrival_seq``: a running row number from several order columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators.order import dense_index
from keelson.plans.joins import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, materialize, materialize_observed
from keelson.schema import DEDUP_TTL_MS
from keelson.session import child_names, delete_folder, folder_exists

ARRIVED = "arrived_ms"


def read_state(spark: SparkSession, root: str, batch_id: int) -> DataFrame | None:
    """State written by the batch just before ``batch_id`` (None if there is none): one folder, opened by its path."""
    path = f"{root}/batch_id={batch_id - 1}"
    return spark.read.parquet(path) if folder_exists(spark, path) else None


def write_state(df: DataFrame, root: str, batch_id: int) -> None:
    """State of a batch in a folder of its own. Folders older than the previous batch can't be asked for again and go."""
    df.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")
    delete_folder(df.sparkSession, f"{root}/batch_id={batch_id - 2}")


# ------------------------------------------------------------------------------------------------ accepted ids

ID_BUCKETS = 4096
GENERATIONS = 4             # parts of the ttl; a generation goes as a whole
COMPACT_AFTER = 32          # batches of one generation before their files are merged
FEW_BUCKETS = 64            # a batch with at most so many buckets reads only their row groups
_IDS = "bucket int, id string, row long, until long"


def _accepted(spark: SparkSession, root: str, batch_id: int, now: int, ttl_ms: int) -> DataFrame | None:
    """Ids accepted before this batch and not yet forgotten. Generations that are over go, and so does what an earlier attempt at this batch
    left; many small batches of a generation are merged first. A merge counts once its files are complete, and only then its sources go."""
    paths = []
    for gen in sorted(child_names(spark, root)):
        folder = f"{root}/{gen}"
        if (int(gen.split("=")[1]) + 1) * _generation_ms(ttl_ms) + ttl_ms <= now:
            delete_folder(spark, folder)
            continue
        merged, batches = [], []
        for name in child_names(spark, folder):
            kind, number = name.split("=")
            if int(number) >= batch_id:
                delete_folder(spark, f"{folder}/{name}")
            elif kind == "batch":
                batches.append(int(number))
            elif folder_exists(spark, f"{folder}/{name}/_SUCCESS"):
                merged.append(int(number))
        base = max(merged, default=-1)
        old = [f"{folder}/upto={n}" for n in merged if n < base] + [f"{folder}/batch={n}" for n in batches if n <= base]
        live = ([f"{folder}/upto={base}"] if merged else []) + [f"{folder}/batch={n}" for n in batches if n > base]
        newest = max(batches, default=base)
        if len(live) > COMPACT_AFTER:
            ids = spark.read.schema(_IDS).parquet(*live)
            target = f"{folder}/upto={newest}"
            ids.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(target)
            if folder_exists(spark, f"{target}/_SUCCESS"):
                old, live = old + live, [target]
        for path in old:
            delete_folder(spark, path)
        paths += live
    return spark.read.schema(_IDS).parquet(*paths) if paths else None


def _generation_ms(ttl_ms: int) -> int:
    return max(1, -(-ttl_ms // GENERATIONS))


def first_arrivals(batch: DataFrame, batch_id: int, root: str, id_col: str = "event_id", seq_col: str = "seq",
                   ttl_ms: int = DEDUP_TTL_MS) -> DataFrame:
    """Q4 inside ``foreachBatch``: the batch's rows with ``dedup_ok``, true for the first arrival of an id, false for later ones.

    Accepted ids are a table under ``root`` (hash bucket, id, and the arrival time up to which the id is remembered: ``ttl_ms`` after it was accepted;
    duplicates do not renew it), in one folder per generation and batch. The batch's distinct ids meet it in one equi join: the ids are broadcast to the
    table if they are few, so that it is not moved, and read only their buckets if they are very few. A batch arrives at one time
    (column ``arrived_ms``, the largest one counts); event timestamps are untrusted and play no part. Inside a batch the smallest
    ``seq_col`` is first, and without that column any one row. A null id is the empty id. Rows with ``decode_ok`` false are not accepted and
    leave nothing behind, whatever their id.
    """
    spark = batch.sparkSession
    readable = F.coalesce(F.col("decode_ok"), F.lit(False)) if "decode_ok" in batch.columns else F.lit(True)
    key = F.when(readable, F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows, seen = materialize_observed(batch.withColumns({"_id": key, "_row": F.monotonically_increasing_id()}), "arrivals", now=F.max(ARRIVED))
    now = seen["now"]
    if now is None:                                             # no rows
        return rows.drop("_id", "_row").withColumn("dedup_ok", F.lit(True))
    order = F.struct(*([seq_col] if seq_col in batch.columns else []), "_row")
    ids = rows.where("_id IS NOT NULL").groupBy(F.col("_id").alias("id")).agg(F.min(order)["_row"].alias("row")) \
        .withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(ID_BUCKETS)).cast("int"))
    ids, size = materialize_observed(ids, "arrived-ids", n=F.count(F.lit(1)), bytes=F.sum(F.octet_length("id") + 32),
                                     buckets=F.collect_set("bucket"))
    small = size["n"] <= BROADCAST_MAX_ROWS and (size["bytes"] or 0) <= BROADCAST_MAX_BYTES

    def few(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    old = _accepted(spark, root, batch_id, now, ttl_ms)
    fresh = ids
    if old is not None:
        old = old.where(F.col("until") > now)
        if len(size["buckets"]) <= FEW_BUCKETS:
            old = old.where(F.col("bucket").isin(sorted(size["buckets"])))
        known = old.select("bucket", "id").join(few(ids.select("bucket", "id")), ["bucket", "id"], "left_semi").select("id").distinct()
        fresh = ids.join(few(known), "id", "left_anti")         # known: at most the batch's ids
    path = f"{root}/gen={now // _generation_ms(ttl_ms)}/batch={batch_id}"
    fresh.select("bucket", "id", "row", F.lit(now + ttl_ms).cast("long").alias("until")).sortWithinPartitions("bucket") \
        .write.mode("overwrite").parquet(path)
    accepted = spark.read.schema(_IDS).parquet(path).select(F.col("row").alias("_row"), F.lit(True).alias("dedup_ok"))
    flagged = rows.join(few(accepted), "_row", "left").withColumn("dedup_ok", F.coalesce("dedup_ok", F.lit(False))).drop("_id", "_row")
    return materialize(flagged, "flagged")                      # read several times: joined once


# ------------------------------------------------------------------------------------------------ order

def arrival_seq(batch: DataFrame, batch_id: int, root: str, order_cols: Sequence[str], seq_col: str = "seq") -> DataFrame:
    """The batch's rows with ``seq_col``: their number in the order of ``order_cols`` (a topic's timestamp, partition and offset, say), counted on from the
    batch before. Rows of later batches come later, whatever their columns say; inside a batch the order must be total for a defined result."""
    spark = batch.sparkSession
    rows, seen = materialize_observed(batch, "ordered", n=F.count(F.lit(1)))
    prior = read_state(spark, root, batch_id)
    base = 0 if prior is None else prior.first()["next"]
    numbered = dense_index(rows, list(order_cols), n_rows=seen["n"], out_col=seq_col).withColumn(seq_col, F.col(seq_col) + F.lit(base))
    write_state(spark.createDataFrame([(base + seen["n"],)], "next long").coalesce(1), root, batch_id)
    return numbered

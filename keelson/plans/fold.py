"""Streaming ordered fold per key.

For operators whose output depends on every earlier decision of the same key
(breaker, last-N dedup), the plan is: hash exchange on the key, sort within
partitions by (key, order), then one ``mapInArrow`` pass that walks the sorted
batches and carries the state of the current key from batch to batch.

Memory per task is one Arrow batch plus one key's state, whatever the key
sizes are: a key is streamed, never collected into one group.  The sort spills.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_fold(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str],
                 step_batch: Callable[[pa.RecordBatch, dict], pa.RecordBatch],
                 schema: T.StructType, num_partitions: int | None = None) -> DataFrame:
    """Apply ``step_batch(batch, states)`` to key-sorted batches.

    ``states`` is a dict the step function may use to keep per-key state; it is
    cleared whenever a new key starts, so it holds one key at a time.
    """
    keys = list(key_cols)
    if keys:
        parts = df.repartition(num_partitions, *keys) if num_partitions else df.repartition(*keys)
    else:
        parts = df.repartition(1)
    ordered = parts.sortWithinPartitions(*keys, *order_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        for batch in batches:
            if batch.num_rows:
                yield step_batch(batch, states)

    return ordered.mapInArrow(run, schema)

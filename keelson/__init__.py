"""keelson: event quality and routing as Spark DataFrame operators.

Every public operator takes a DataFrame and returns a DataFrame, lazily, so
the same code runs on batch tables and (where noted) on Structured Streaming.
"""

from keelson.session import checkpoint_root, get_spark, scratch_path  # noqa: F401

__all__ = ["get_spark", "checkpoint_root", "scratch_path"]

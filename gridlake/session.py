"""Session settings the engine is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: small partitions are merged, skewed join partitions split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # State of streaming aggregations lives outside the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Building a column records its call site for error messages, which costs more than the column.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings; anything set on the builder afterwards wins."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shuffle_partitions(shuffled_bytes: int, target_bytes: int = 128 << 20, at_least: int = 8) -> int:
    """Partitions that keep a shuffle of the given size near ``target_bytes`` per task."""
    return max(at_least, -(-shuffled_bytes // target_bytes))

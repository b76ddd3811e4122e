"""Streaming queries built on Spark's own stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions import text as X


SALTS = 16


def distinct_keys(stream: DataFrame, row_id: str, text: str = "text", salts: int = SALTS) -> DataFrame:
    """First arrival of each content key; the state grows with the distinct keys.

    A salt from the row id spreads the copies of one text over ``salts`` tasks; the few that are left
    of each meet in a second step.
    """
    salt = F.pmod(F.xxhash64(row_id), F.lit(salts))
    keyed = stream.withColumn("content_key", X.content_key(F.col(text))).withColumn("_salt", salt)
    return keyed.dropDuplicates(["content_key", "_salt"]).dropDuplicates(["content_key"]).drop("_salt")


def distinct_keys_within(stream: DataFrame, ts: str, delay: str, text: str = "text") -> DataFrame:
    """First arrival of each content key while copies arrive within ``delay``; the state is bounded."""
    keyed = stream.withColumn("content_key", X.content_key(F.col(text)))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_key"])


def running_moments(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and variance so far per key; rows are combined before they reach the state."""
    v = F.col(value)
    return stream.groupBy(key).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("var")
    )


def live_metrics(stream: DataFrame) -> DataFrame:
    """Metric sums per set and metric so far; divided by the set's count when they are read.

    ``stream(set_name, metric, value)``.
    """
    return stream.groupBy("set_name", "metric").agg(F.sum("value").alias("value"))


def live_metrics_by_window(stream: DataFrame, ts: str, width: str, delay: str) -> DataFrame:
    """Metric sums per time window; rows later than ``delay`` are dropped and old windows close."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("window"), "set_name", "metric")
        .agg(F.sum("value").alias("value"))
    )


def live_chunk_progress(log: DataFrame) -> DataFrame:
    """Progress per chunk within the current epoch of training, updated as the log grows.

    ``log(seq, epoch, chunk_id, offset, samples, chunk_size)``.
    """
    newest = F.max(F.struct("seq", "offset"))["offset"]
    return log.groupBy("epoch", "chunk_id").agg(
        F.sum("samples").alias("samples_trained"),
        newest.alias("last_offset"),
        F.bool_or(F.col("offset") >= F.col("chunk_size")).alias("completed"),
    )


def fresh_rows(stream: DataFrame, ts: str, max_age: str, key: str) -> DataFrame:
    """Rows no older than ``max_age`` behind the newest event, each key once."""
    return stream.withWatermark(ts, max_age).dropDuplicatesWithinWatermark([key])


def write_complete(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run an aggregation over everything available and keep its latest full result."""
    def replace(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(path)

    (
        stream.writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def write_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a query without aggregation over everything available into a Parquet table."""
    (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )

"""The continuous build: micro-batches against the tables of keys and batches that it writes.

Its output is tables in any case, which other jobs read and compact; they have one partition per epoch,
so a repeated micro-batch replaces what it wrote before. State per key lives in ``keyed``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions import text as X
from gridlake.operators.sampling import numbered_batches
from gridlake.plans.storage import EpochTable

Step = Callable[[DataFrame, int], None]


def run_available(stream: DataFrame, step: Step, checkpoint: str) -> None:
    """Process everything available, micro-batch by micro-batch, and stop; resumes at the checkpoint."""
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def continuous_build(out: str, order: list[str], text: str = "text", batch_size: int = 256) -> Step:
    """Samples -> content key -> skip known keys -> numbered batches.

    Writes ``batches`` (rows with ``content_key`` and ``batch_id``), ``keys`` and ``counts`` under
    ``out``.  Of equal new samples the first in ``order``, a total order, is kept.
    """
    batches, keys, counts = (EpochTable(f"{out}/{name}") for name in ("batches", "keys", "counts"))

    def step(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        keyed = df.withColumn("content_key", X.content_key(F.col(text)))
        known = keys.before(spark, epoch, "content_key string")
        # Copies of one text meet as one row per task, not as rows.
        firsts = keyed.groupBy("content_key").agg(F.min(F.struct(*order)).alias("_first"))
        fresh = firsts.join(known, "content_key", "left_anti")
        # Found again by their place in the order, which is unique, and not by the shared key.
        new = keyed.join(fresh.select("_first"), F.struct(*order) == F.col("_first"), "left_semi")
        done = counts.before(spark, epoch, "n_batches bigint").agg(F.coalesce(F.sum("n_batches"), F.lit(0))).first()[0]
        numbered = numbered_batches(new, order, batch_size).withColumn("batch_id", F.col("batch_id") + F.lit(done))
        batches.write(numbered, epoch)
        # What follows reads the batch just written, so the input is processed once.
        written = spark.read.parquet(f"{batches.path}/epoch={epoch}")
        keys.write(written.select("content_key"), epoch)
        counts.write(
            written.agg(F.coalesce(F.max("batch_id") + 1 - F.lit(done), F.lit(0)).cast("long").alias("n_batches")),
            epoch,
        )

    return step


def with_consolidation(build: Step, compact: Callable[[], None], every: int, pending: Callable[[], int]) -> Step:
    """Run ``build`` on each micro-batch, then ``compact`` whenever ``every`` batches are waiting."""
    def step(df: DataFrame, epoch: int) -> None:
        build(df, epoch)
        if pending() >= every:
            compact()

    return step

"""Batch and chunk bookkeeping as tables: what to compact, keep, resume and verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCHES_PER_CHUNK = 100  # fixed value


def consolidation_range(batches: DataFrame, mapping: DataFrame, per_chunk: int = BATCHES_PER_CHUNK) -> DataFrame:
    """One row ``start_batch, end_batch, next_chunk_id`` of the batches ready to become chunks.

    ``batches(batch_id)`` lists the batches built, ``mapping(chunk_id, batch_id)`` those compacted.
    Zeros when no whole chunk is ready.
    """
    done = mapping.agg(F.coalesce(F.max("chunk_id"), F.lit(-1))).scalar()
    state = batches.agg(F.coalesce(F.max("batch_id") + 1, F.lit(0)).alias("_built")).withColumn("_last", done)
    n = F.lit(per_chunk)
    start = (F.col("_last") + 1) * n
    whole = F.floor((F.col("_built") - start) / n)
    ready = whole > 0
    zero = F.lit(0)
    return state.select(
        F.when(ready, start).otherwise(zero).cast("long").alias("start_batch"),
        F.when(ready, start + whole * n).otherwise(zero).cast("long").alias("end_batch"),
        F.when(ready, F.col("_last") + 1).otherwise(zero).cast("long").alias("next_chunk_id"),
    )


def consolidation_plan(batches: DataFrame, mapping: DataFrame, per_chunk: int = BATCHES_PER_CHUNK) -> DataFrame:
    """``(chunk_id, batch_id)`` of every chunk that can be completed now."""
    span = consolidation_range(batches, mapping, per_chunk)
    ids = span.where("end_batch > 0").select(
        "start_batch", "next_chunk_id", F.explode(F.expr("sequence(start_batch, end_batch - 1)")).alias("batch_id")
    )
    chunk = F.col("next_chunk_id") + F.floor((F.col("batch_id") - F.col("start_batch")) / per_chunk)
    return ids.select(chunk.alias("chunk_id"), "batch_id")


def unconsolidated(batches: DataFrame, mapping: DataFrame) -> DataFrame:
    """Batches up to the newest one that are in no chunk yet."""
    built = batches.agg(F.max("batch_id").alias("_m")).where(F.col("_m").isNotNull())
    ids = built.select(F.explode(F.expr("sequence(0L, cast(_m as bigint))")).alias("batch_id"))
    return ids.join(mapping.select("batch_id"), "batch_id", "left_anti")


def retention(df: DataFrame, keys: list[str], step: str, keep: int) -> DataFrame:
    """Adds ``kept``: whether the row is among the ``keep`` latest of its key.

    The rank limit is applied before the shuffle, so a key with very many rows is no burden.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(step))
    latest = df.select(*keys, step).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep)
    cut = latest.groupBy(*keys).agg(F.min(step).alias("_cut"))
    return df.join(cut, keys).withColumn("kept", F.col(step) >= F.col("_cut")).drop("_cut")


def chunk_progress(log: DataFrame) -> DataFrame:
    """Progress of every chunk since the last epoch marker, and where to resume.

    ``log(seq, is_marker, chunk_id, offset, samples, chunk_size)``.  Chunks seen only before the
    marker start over; a partial chunk resumes at the offset after its last one.
    """
    marker = log.agg(F.coalesce(F.max(F.when(F.col("is_marker"), F.col("seq"))), F.lit(-1))).scalar()
    steps = log.where("not is_marker").withColumn("_live", F.col("seq") > marker)
    live = F.col("_live")
    per = steps.groupBy("chunk_id").agg(
        F.coalesce(F.sum(F.when(live, F.col("samples"))), F.lit(0)).alias("samples_trained"),
        F.coalesce(F.max_by(F.when(live, F.col("offset")), F.when(live, F.col("seq"))), F.lit(0)).alias("last_offset"),
        F.coalesce(F.bool_or(live & (F.col("offset") >= F.col("chunk_size"))), F.lit(False)).alias("completed"),
    )
    return per.withColumn("resume_at", F.when(F.col("completed"), 0).otherwise(F.col("last_offset") + 1))


def training_report(log: DataFrame) -> DataFrame:
    """One row: epoch, current position, completed and known chunks, samples trained overall."""
    progress = chunk_progress(log).agg(
        F.struct(F.count_if("completed").alias("completed"), F.count(F.lit(1)).alias("known")).alias("p")
    )
    step = ~F.col("is_marker")
    newest = F.max(F.when(step, F.struct("seq", "chunk_id", "offset")))
    last_mark = F.max(F.when(F.col("is_marker"), F.col("seq")))
    sums = log.agg(
        F.count_if("is_marker").alias("epoch"),
        F.coalesce(F.sum(F.when(step, F.col("samples"))), F.lit(0)).alias("total_samples_trained"),
        newest.alias("_now"),
        F.coalesce(last_mark, F.lit(-1)).alias("_mark"),
    )
    after = F.col("_now.seq") > F.col("_mark")
    return sums.withColumn("_p", progress.scalar()).select(
        "epoch",
        "total_samples_trained",
        F.when(after, F.col("_now.chunk_id")).otherwise(0).alias("current_chunk"),
        F.when(after, F.col("_now.offset")).otherwise(0).alias("current_offset"),
        F.col("_p.completed").alias("completed_chunks"),
        F.col("_p.known").alias("total_chunks"),
    )


def chunk_inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """Chunk files with their numeric id; other names are ignored."""
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    number = F.regexp_extract(name, r"^consolidated_([^_.]+)[^/]*$", 1).try_cast("int")
    return files.withColumn("chunk_id", number).where(F.col("chunk_id").isNotNull())


def verify_files(files: DataFrame, manifest: DataFrame, digest: Column | None = None) -> DataFrame:
    """Verdict per file: size first, then SHA-256.

    ``files(path, length, content)``, ``manifest(path, checksum, size_bytes)``.  A file nobody has a
    checksum for passes as legacy; one that is listed but missing fails.
    """
    actual = files.select(
        "path", F.col("length").alias("_len"), (digest if digest is not None else F.sha2("content", 256)).alias("_sha")
    )
    joined = actual.join(manifest.select("path", "checksum", "size_bytes"), "path", "full_outer")
    verdict = (
        F.when(F.col("_sha").isNull(), "missing")
        .when(F.col("checksum").isNull(), "legacy")
        .when((F.coalesce("size_bytes", F.lit(0)) > 0) & (F.col("size_bytes") != F.col("_len")), "size_mismatch")
        .when(F.col("checksum") != F.col("_sha"), "corrupted")
        .otherwise("ok")
    )
    out = joined.select("path", verdict.alias("verdict"))
    return out.withColumn("passed", F.col("verdict").isin("ok", "legacy"))

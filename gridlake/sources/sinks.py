"""Sinks: numbered batches, compacted chunks, split datasets and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions import grid as G
from gridlake.operators import manifest as M
from gridlake.operators.sampling import numbered_batches, train_split
from gridlake.plans.bounds import broadcast_if_small, cut_lineage
from gridlake.plans.storage import exists

BATCH_ROWS = 256  # fixed value


def write_batches(df: DataFrame, path: str, order: list[str], batch_size: int = BATCH_ROWS) -> None:
    """Fixed-size batches in arrival order; batches already stored are not written again.

    Batches lie in folders of one hundred, so the number of folders stays moderate.
    """
    spark = df.sparkSession
    stored = spark.read.parquet(path).select("batch_id").distinct() if exists(spark, path) else None
    _by_group(numbered_batches(df, order, batch_size, stored)).write.mode("append").partitionBy("batch_group").parquet(path)


def _by_group(df: DataFrame) -> DataFrame:
    group = F.floor(F.col("batch_id") / M.BATCHES_PER_CHUNK)
    return df.withColumn("batch_group", group).repartition("batch_group").sortWithinPartitions("batch_id")


def compact(
    spark: SparkSession,
    batches_path: str,
    chunks_path: str,
    mapping_path: str,
    per_chunk: int = M.BATCHES_PER_CHUNK,
    schema=None,
) -> DataFrame:
    """Write every complete chunk, record its batches and return the batches that may be deleted.

    Unreadable files are skipped; with ``schema`` no file has to be opened to learn it.  A chunk replaces its own folder, so a repeated run after a failure
    leaves one copy.  Nothing is deleted here.
    """
    reader = spark.read.option("ignoreCorruptFiles", True)
    reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", True)
    source = reader.parquet(batches_path)
    mapping = (
        spark.read.parquet(mapping_path)
        if exists(spark, mapping_path)
        else spark.createDataFrame([], "chunk_id bigint, batch_id bigint")
    )
    ids = source.select("batch_id").distinct()
    plan = M.consolidation_plan(ids, mapping, per_chunk)
    # The plan depends on the mapping it extends, so it is fixed before anything is written.
    plan = cut_lineage(plan)
    rows = source.join(broadcast_if_small(plan), "batch_id")
    # A chunk holds a fixed number of batches, so one task per chunk is bounded.
    (
        rows.repartition("chunk_id")
        .sortWithinPartitions("batch_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("chunk_id")
        .parquet(chunks_path)
    )
    plan.write.mode("append").parquet(mapping_path)
    return plan


def write_dataset(
    df: DataFrame, path: str, key: str = "sample_id", ratio: float = 0.9, seed: int = 42, num_concepts: int = 2048, seq_len: int = 1024
) -> None:
    """Train and test folders and one ``dataset.json`` record each."""
    marked = train_split(df, key, ratio, seed)
    base = path.rstrip("/")
    marked.write.mode("overwrite").partitionBy("split").parquet(f"{base}/data")
    dataset_record(df.sparkSession.read.parquet(f"{base}/data"), num_concepts, seq_len).coalesce(1).write.mode(
        "overwrite"
    ).json(f"{base}/dataset.json")


def dataset_record(marked: DataFrame, num_concepts: int = 2048, seq_len: int = 1024) -> DataFrame:
    """Metadata per split; four control symbols extend the vocabulary."""
    n = F.count(F.lit(1))
    return marked.groupBy("split").agg(
        F.lit(seq_len).alias("seq_len"),
        F.lit(num_concepts + 4).alias("vocab_size"),
        F.lit(0).alias("pad_id"),
        F.lit(-100).alias("ignore_label_id"),
        F.lit(0).alias("blank_identifier_id"),
        F.lit(0).alias("num_puzzle_identifiers"),
        n.alias("total_groups"),
        F.lit(1.0).alias("mean_puzzle_examples"),
        n.alias("total_puzzles"),
        F.array(F.lit("all")).alias("sets"),
    )


def submission_documents(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """``name, document``: per puzzle a JSON object with the attempts of its test pairs under its name.

    ``attempts(name, input_hash, attempt_1, attempt_2)`` holds prediction hashes and
    ``answers(pred_hash, grid)`` their grids.
    """
    one = answers.select(F.col("pred_hash").alias("attempt_1"), F.col("grid").alias("_g1"))
    two = answers.select(F.col("pred_hash").alias("attempt_2"), F.col("grid").alias("_g2"))
    joined = attempts.join(one, "attempt_1").join(two, "attempt_2")
    pair = F.struct("input_hash", F.struct(F.col("_g1").alias("attempt_1"), F.col("_g2").alias("attempt_2")).alias("a"))
    # One entry per test pair of a puzzle, a handful by the format.
    listed = joined.groupBy("name").agg(F.array_sort(F.collect_list(pair)).alias("_p"))
    return listed.select("name", F.to_json(F.create_map("name", F.transform("_p", lambda p: p["a"]))).alias("document"))


def write_submission(documents: DataFrame, path: str) -> None:
    """JSON lines, one puzzle each."""
    documents.select("document").write.mode("overwrite").text(path)


def prediction_grids(predictions: DataFrame, grid: str = "grid") -> DataFrame:
    """``pred_hash, grid``: one grid per distinct prediction hash."""
    hashed = predictions.select(G.grid_hash(F.col(grid)).alias("pred_hash"), F.col(grid).alias("grid"))
    return hashed.groupBy("pred_hash").agg(F.first("grid").alias("grid"))

"""The dataset build as one plan: sources, derived samples, cleaning, keys and incremental skip."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions import text as X
from gridlake.operators import quality as Q
from gridlake.operators import sampling as S
from gridlake.plans.ordered import hash_order
from gridlake.schemas import LABEL

Source = Callable[[SparkSession, str], DataFrame]
Transform = Callable[[DataFrame], DataFrame]

# Columns every source is brought to before the union.
COLUMNS = {
    "sample_id": "string",
    "modality": "string",
    "text": "string",
    "payload": "binary",
    "grid": "array<array<int>>",
    "label": LABEL,
    "metadata": "map<string,string>",
}


def conform(df: DataFrame) -> DataFrame:
    """Missing sample columns as nulls, a textual label as a label struct."""
    if "label" in df.columns and df.schema["label"].dataType.simpleString() == "string":
        label = F.struct(
            F.col("label").alias("s"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("array<array<int>>").alias("grid")
        )
        df = df.withColumn("label", F.when(F.col("label").isNotNull(), label))
    missing = {c: F.lit(None).cast(t) for c, t in COLUMNS.items() if c not in df.columns}
    return df.withColumns(missing).select(*COLUMNS)


def union_sources(tables: Iterable[DataFrame]) -> DataFrame:
    """All sources in one table; ``source_ord`` keeps their order."""
    parts = [conform(t).withColumn("source_ord", F.lit(i)) for i, t in enumerate(tables)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def derive(samples: DataFrame, seed: int = 42, probability: float = 0.5, multitask: bool = True) -> DataFrame:
    """Originals, then one-sided augmentations, then distribution-learning copies.

    Samples are ordered by ``(source_ord, sample_id)`` where an order is needed.
    """
    grids = samples.withColumn("_struct", F.col("label")).withColumn("label", F.col("label.grid"))
    moved = Q.augment_problem(grids, seed, probability)
    meta = S.with_entry(F.col("metadata"), "problem_aug", F.col("problem_aug"))
    meta = F.map_concat(
        F.map_filter(meta, lambda k, _: k != "aug_input"), F.create_map(F.lit("aug_input"), F.col("aug_input").cast("string"))
    )
    turned = F.when(
        F.col("label").isNotNull(),
        F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("bigint").alias("i"), F.col("label").alias("grid")),
    ).otherwise(F.col("_struct"))
    augmented = moved.withColumn("metadata", meta).withColumn("label", turned).select(*samples.columns)
    out = samples.withColumn("derived", F.lit(0)).unionByName(augmented.withColumn("derived", F.lit(1)))
    if multitask:
        tasked = samples.withColumn("task", S.task_key(F.col("metadata"))).withColumn(
            "seq", F.struct("source_ord", "sample_id")
        )
        rows = S.distribution_rows(tasked)
        own = F.struct(
            F.lit(None).cast("string").alias("s"), F.lit(None).cast("bigint").alias("i"), F.col("grid").alias("grid")
        )
        copies = (
            rows.withColumn("sample_id", X.distribution_name(F.col("sample_id")))
            .withColumn("label", own)
            .withColumn("metadata", S.with_entry(F.col("metadata"), "task_type", F.lit("distribution_learning")))
            .select(*samples.columns)
        )
        out = out.unionByName(copies.withColumn("derived", F.lit(2)))
    return out


def clean(samples: DataFrame) -> DataFrame:
    """Cleaned text with its category and difficulty, over-tall grids cropped."""
    meta = F.col("metadata")
    category = F.try_element_at(meta, F.lit("category"))
    difficulty = F.try_element_at(meta, F.lit("difficulty"))
    return samples.withColumn("text", X.preprocess(F.col("text"), category, difficulty)).withColumn(
        "grid", X.crop_tall(F.col("grid"))
    )


def keyed(samples: DataFrame) -> DataFrame:
    """Content key from the cache key of each sample."""
    cache = X.cache_key(
        F.col("sample_id"), F.col("payload").isNotNull(), F.col("grid").isNotNull(), F.col("text"), F.lit(None).cast("string"), F.col("sample_id")
    )
    return samples.withColumn("content_key", X.content_key(cache))


def skip_known(samples: DataFrame, known: DataFrame) -> DataFrame:
    """Samples whose key is not stored yet; run before any costly step."""
    return samples.join(known.select("content_key"), "content_key", "left_anti")


def build(sources: Iterable[DataFrame], known: DataFrame | None = None, seed: int = 42, probability: float = 0.5) -> DataFrame:
    """Samples to materialise, in the order of their hash."""
    samples = keyed(clean(derive(union_sources(sources), seed, probability)))
    if known is not None:
        samples = skip_known(samples, known)
    return samples.withColumn("arrival", hash_order(F.col("sample_id"), seed))

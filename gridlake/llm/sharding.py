"""Sharding by proportional stratified interleaving, in DataFrame functions only.

The rows of each source are ranked in a seeded shuffled order, and a row's rank as a share of its
source gives its place in one common order. Every stretch of that order has the sources in the
proportions of the whole, so equal cuts give shards that match the mixture. Ranks and places are
counted through totals of small buckets of the order, so neither a large source nor the whole table
is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.llm.common import table, written

BUCKET_ROWS = 250
MOST_BUCKETS = 20_000


def numbered(rows: DataFrame, groups: list[str], place: Column, order: list[str], buckets: int) -> DataFrame:
    """Rows with ``__n``, the 1-based number in the group in the given order, and ``__of``, the group's size.

    ``place`` is a number in [0, 1) that grows with the order; it deals the rows to the buckets.
    """
    keyed = rows.withColumn("__b", F.least(F.floor(place * buckets), F.lit(buckets - 1)).cast("int"))
    sizes = keyed.groupBy(*groups, "__b").agg(F.count("*").alias("__c"))
    if groups:
        before = Window.partitionBy(*groups).orderBy("__b")
        whole = Window.partitionBy(*groups)
    else:
        # At most MOST_BUCKETS totals, one row each: small enough for one task at any size.
        before, whole = Window.partitionBy(F.lit(0)).orderBy("__b"), Window.partitionBy(F.lit(0))
    offsets = sizes.withColumn("__before", F.sum("__c").over(before) - F.col("__c")).withColumn("__of", F.sum("__c").over(whole)).drop("__c")
    inner = Window.partitionBy(*groups, "__b").orderBy(*order)
    local = keyed.withColumn("__k", F.row_number().over(inner))
    return local.join(offsets, [*groups, "__b"]).withColumn("__n", F.col("__before") + F.col("__k")).drop("__b", "__before", "__k")


def shuffle_key(seed: int, *columns: str) -> Column:
    """A fixed random hexadecimal key of a row."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *text))


def share(key: Column) -> Column:
    """The first 32 bits of the key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32)


def assign_shards(docs: DataFrame, shards: int = 8, strata: str = "source", seed: int = 2) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    The law is ``rows``: the counts of two shards differ by one at most, and each shard has each source
    in proportion to within one row at each cut. A null source is a stratum of its own, a null doc_id an
    id like any other. A null text has no bytes and the checksum of the empty text. Repeated rows are
    rows of their own; fully equal rows are interchangeable. No rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(strata)), F.lit("")).alias("__s"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = written(rows.withColumn("__key", shuffle_key(seed, "doc_id", "text_crc32")))
    total = rows.count()
    buckets = min(MOST_BUCKETS, max(1, -(-total // BUCKET_ROWS)))
    order = ["__key", "doc_id", "size"]
    ranked = numbered(rows, ["__s"], share(F.col("__key")), order, buckets)
    # A source starts at a random place of its own within its first step, so that many small sources spread too.
    start_at = share(F.md5(F.concat_ws(":", F.lit(str(seed)), "__s")))
    ranked = ranked.withColumn("__f", (F.col("__n") - 1 + start_at) / F.col("__of")).drop("__n", "__of")
    placed = numbered(ranked, [], F.col("__f"), ["__f", *order, "__s"], buckets)
    at = F.col("__n") - 1
    # Shard s takes the places from ceil(s * total / shards) on.
    shard = F.expr(f"(__n - 1) * {shards} div {max(1, total)}")
    start = F.expr(f"(({shards} - 1) + ((__n - 1) * {shards} div {max(1, total)}) * {total}) div {shards}")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (at - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, strata: str = "source", seed: int = 2) -> None:
    """Write the documents as one folder per shard, rows in the order of their slots.

    Documents are matched by doc_id, which must be unique here.
    """
    placed = assign_shards(docs, shards, strata, seed).select("doc_id", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    joined = docs.join(placed, "doc_id").repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    joined.withColumn("shard", F.col("__shard")).drop("__shard", "__slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards."""
    return assign_shards(table(spark, sf_dir, "documents"))

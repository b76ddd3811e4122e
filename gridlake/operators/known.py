"""Skip what is known already: stored keys by prefix, a Bloom sketch over them, exact answers.

Keys are hexadecimal digests. Only keys are stored and compared; rows that arrive stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.text import key_shard
from gridlake.plans.bounds import broadcast_if_small, cut_lineage, is_small

BITS_PER_KEY = 16
PROBES = 4


def store_keys(df: DataFrame, path: str, key: str = "content_key") -> None:
    """Append the distinct keys to the key table, one folder per prefix; nulls aren't keys."""
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    keys.withColumn("prefix", key_shard(F.col("key"))).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)


def _position(key: Column, probe: int, words: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(probe)), words.cast("long") * 64)


def key_sketch(known: DataFrame, key: str = "key", bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """``prefix, words``: one Bloom filter per prefix, as many bits for each as its own keys ask for.

    The bits of a prefix meet as partial sums of whole words, so a prefix with most of the keys is
    spread over its words.
    """
    keys = known.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), key_shard(F.col(key)).alias("prefix"))
    # At most 256 rows for hexadecimal keys.
    sizes = keys.groupBy("prefix").agg((F.floor(F.count(F.lit(1)) * bits_per_key / 64) + 1).alias("_words"))
    probes = F.explode(F.array(*[_position(F.col("_key"), i, F.col("_words")) for i in range(PROBES)]))
    bits = keys.join(sizes, "prefix").select("prefix", probes.alias("_at"))
    ones = bits.select("prefix", F.floor(F.col("_at") / 64).alias("_word"), F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("_mask"))
    zeros = sizes.select("prefix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_words") - 1)).alias("_word"), F.lit(0).cast("long").alias("_mask"))
    merged = ones.unionByName(zeros).groupBy("prefix", "_word").agg(F.bit_or("_mask").alias("_mask"))
    listed = F.array_sort(F.collect_list(F.struct("_word", "_mask")))
    return merged.groupBy("prefix").agg(listed.alias("_w")).select("prefix", F.transform("_w", lambda w: w["_mask"]).alias("words"))


def possible(key: Column, words: Column) -> Column:
    """Whether a key may be among those of the sketch; false is certain, and so is it without a filter."""
    hit = F.lit(True)
    for i in range(PROBES):
        at = _position(key, i, F.size(words))
        word = F.get(words, F.floor(at / 64).cast("int"))
        shifted = F.call_function("shiftright", word, F.pmod(at, F.lit(64)).cast("int"))
        hit = hit & (shifted.bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.coalesce(hit, F.lit(False))


def skip_known(df: DataFrame, known: DataFrame, key: str = "content_key", known_key: str = "key", sketch: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` whose key isn't in ``known``; rows without a key stay.

    Keys that the sketch rules out are new. Of the others the keys alone are compared with the table,
    which leaves the sketch's few errors; those are added to the new ones. So neither the rows nor the
    known ones among them are moved. A sketch too large to broadcast is left out, and all distinct
    keys that arrive are compared.
    """
    stored = known.where(F.col(known_key).isNotNull()).select(F.col(known_key).alias("_known"))
    sketch = cut_lineage(key_sketch(stored, "_known") if sketch is None else sketch)
    columns = df.columns
    if not is_small(sketch):
        asked = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_known")).distinct()
        hits = cut_lineage(asked.join(stored, "_known", "left_semi"))
        return df.join(broadcast_if_small(hits), F.col(key) == F.col("_known"), "left_anti").select(*columns)
    filters = F.broadcast(sketch.select(F.col("prefix").alias("_prefix"), F.col("words").alias("_words")))
    tested = df.join(filters, key_shard(F.col(key)) == F.col("_prefix"), "left").withColumn("_maybe", possible(F.col(key), F.col("_words"))).drop("_prefix", "_words")
    asked = tested.where("_maybe").select(F.col(key).alias("_known")).distinct()
    wrong = cut_lineage(asked.join(stored, "_known", "left_anti")).withColumn("_new", F.lit(True))
    found = tested.join(broadcast_if_small(wrong), F.col(key) == F.col("_known"), "left")
    return found.where(~F.col("_maybe") | F.col("_new")).select(*columns)

"""Skipping known keys: equal to a set difference, no false negative, errors of the sketch settled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridlake.functions.text import key_shard
from gridlake.operators import known as K


def arriving(spark, n=2000):
    key = F.when(F.col("id") % 97 != 0, F.md5((F.col("id") % 1500).cast("string")))
    return spark.range(n).select("id", key.alias("content_key"), F.repeat(F.lit("text "), 20).alias("prefix"))


def stored(spark, step=3):
    return spark.range(0, 1500, step).select(F.md5(F.col("id").cast("string")).alias("key"))


def expected(df, table):
    seen = {r.key for r in table.collect()}
    return sorted(r.id for r in df.collect() if r.content_key is None or r.content_key not in seen)


@pytest.mark.parametrize("bits", [16, 1])
def test_skip_known_is_exact(spark, bits):
    """One bit a key makes most answers of the sketch wrong; the result doesn't change."""
    df, table = arriving(spark), stored(spark)
    sketch = K.key_sketch(table, bits_per_key=bits)
    got = K.skip_known(df, table, sketch=sketch)
    assert got.columns == df.columns
    assert sorted(r.id for r in got.collect()) == expected(df, table)


def test_sketch_has_no_false_negative_and_few_errors(spark):
    table = stored(spark, 1)
    sketch = K.key_sketch(table)

    def share(keys):
        met = keys.join(F.broadcast(sketch), key_shard(F.col("key")) == F.col("prefix"), "left")
        return met.agg(F.avg(K.possible(F.col("key"), F.col("words")).cast("int"))).first()[0]

    assert share(table) == 1.0
    assert share(spark.range(10_000, 30_000).select(F.md5(F.col("id").cast("string")).alias("key"))) < 0.02


def test_large_sketch_and_empty_tables(spark, small_tasks):
    df, table = arriving(spark, 300), stored(spark)
    assert sorted(r.id for r in K.skip_known(df, table).collect()) == expected(df, table)
    assert K.skip_known(df, table.limit(0)).count() == 300
    assert K.skip_known(df.limit(0), table).count() == 0


def test_key_table_by_prefix(spark, tmp_path):
    path, df = str(tmp_path / "keys"), arriving(spark)
    K.store_keys(df.where("id < 500"), path)
    K.store_keys(df.where("id >= 1600"), path)
    table = spark.read.parquet(path)
    assert len(list((tmp_path / "keys").glob("prefix=*"))) > 200
    seen = df.where("id < 500 or id >= 1600")
    assert sorted(r.id for r in K.skip_known(df, table).collect()) == expected(df, seen.select(F.col("content_key").alias("key")))


def test_rows_are_not_moved(spark):
    """Every join that the rows pass is a broadcast; only keys are exchanged."""
    plan = K.skip_known(arriving(spark), stored(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]

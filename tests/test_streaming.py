import datetime
import time

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from gridlake.operators import metrics as M
from gridlake.operators import transitions as R
from gridlake.plans.storage import EpochTable
from gridlake.sources import sinks
from gridlake.streaming import keyed as K
from gridlake.streaming import queries as Q
from gridlake.streaming import state as S


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Events in four files written one after the other, documents in three with repeated texts."""
    base = tmp_path_factory.mktemp("stream")
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    for part in range(4):
        events.where(f"event_id between {part * 250} and {part * 250 + 249}").coalesce(1).write.mode("append").parquet(str(base / "events"))
        time.sleep(1.1)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    for part in range(3):
        rows = docs.where(f"doc_id >= {part * 50}")
        rows.withColumn("doc_id", F.col("doc_id") + 1000 * part).coalesce(1).write.mode("append").parquet(str(base / "docs"))
        time.sleep(1.1)
    return base


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df, *cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


def test_novelty_equals_batch(spark, staged, tmp_path):
    events = stream(spark, str(staged / "events")).select(F.col("event_id").alias("seq"), F.col("event_type").alias("h"))
    out = str(tmp_path)
    K.run_available(K.novelty(events, "h", "seq"), f"{out}/rows", f"{out}/ckpt")
    batch = R.novelty_bonus(
        spark.read.parquet(str(staged / "events")).select(F.col("event_id").alias("seq"), F.col("event_type").alias("h")), "h", "seq"
    )
    found = spark.read.parquet(f"{out}/rows")
    assert found.select("epoch").distinct().count() == 4
    assert K.state_table(spark, f"{out}/ckpt", "visits").agg(F.sum("n")).first()[0] == 1000
    assert rows(found, "seq", "n_before", "bonus") == rows(batch, "seq", "n_before", "bonus")


def test_tasks_equal_batch(spark, staged, tmp_path):
    events = stream(spark, str(staged / "events")).select("event_id", "user_id")
    out = str(tmp_path)
    K.run_available(K.repeated_tasks(events, "user_id", "event_id"), f"{out}/rows", f"{out}/ckpt")
    everything = spark.read.parquet(str(staged / "events"))
    firsts = everything.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    want = everything.join(firsts, ["user_id", "event_id"], "left_anti")
    assert rows(spark.read.parquet(f"{out}/rows"), "event_id") == rows(want, "event_id")


def test_ema_equals_batch(spark, staged, tmp_path):
    events = stream(spark, str(staged / "events")).select("user_id", "event_id", "value")
    out = str(tmp_path)
    K.run_available(K.running_ema(events, "user_id", ["event_id"], "value", 0.9), f"{out}/rows", f"{out}/ckpt")
    want = M.ema(spark.read.parquet(str(staged / "events")), ["user_id"], ["event_id"], "value", 0.9)
    assert rows(K.state_table(spark, f"{out}/ckpt", "average"), "user_id", "ema") == rows(want, "user_id", "ema")


def test_buffer_equals_batch(spark, staged, tmp_path):
    events = stream(spark, str(staged / "events")).select(F.col("event_id").alias("seq"), "value")
    out = str(tmp_path)
    K.run_available(K.bounded_buffer(events, "seq", 80, 300, shards=3), f"{out}/rows", f"{out}/ckpt")
    held = K.state_table(spark, f"{out}/ckpt", "rows")
    assert held.count() <= 3 * 80
    assert rows(K.newest(held, "seq", 80, 300), "seq") == [(i,) for i in range(920, 1000)]
    assert rows(K.newest(held, "seq", 80, 9), "seq") == [(i,) for i in range(990, 1000)]


def test_keyed_state_goes_on_after_a_restart(spark, tmp_path):
    made = [[(1, "a", 1.0), (2, "a", 2.0), (3, "b", 5.0)], [(4, "a", 4.0), (5, "c", 7.0)], [(6, "b", 1.0), (7, "c", 3.0), (8, "a", 0.0)]]
    path, out, schema = str(tmp_path / "in"), str(tmp_path), "seq long, k string, v double"
    for part in made:
        # A new query each time: what it knows of earlier rows comes from the checkpoint alone.
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(schema).parquet(path)
        K.run_available(K.repeated_tasks(source, "k", "seq"), f"{out}/tasks", f"{out}/c1")
        K.run_available(K.novelty(source, "k", "seq"), f"{out}/novel", f"{out}/c2")
        K.run_available(K.running_ema(source, "k", ["seq"], "v", 0.5), f"{out}/ema", f"{out}/c3")
    assert rows(spark.read.parquet(f"{out}/tasks"), "seq") == [(2,), (4,), (6,), (7,), (8,)]
    assert rows(spark.read.parquet(f"{out}/novel"), "seq", "n_before") == [(1, 0), (2, 1), (3, 0), (4, 2), (5, 0), (6, 1), (7, 1), (8, 3)]
    assert rows(K.state_table(spark, f"{out}/c3", "average"), "k", "n", "ema") == [("a", 4, 1.375), ("b", 2, 3.0), ("c", 2, 5.0)]


def test_idle_buffers_are_emptied_and_late_rows_dropped(spark, tmp_path):
    path, out, schema = str(tmp_path / "in"), str(tmp_path), "seq long, ts timestamp"
    day = datetime.datetime(2024, 1, 1)
    dealt = spark.range(100).select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("shard")).collect()
    one, other = ([r["id"] for r in dealt if r["shard"] == x][:12] for x in (0, 1))
    # One shard has rows on the first day only; the other goes on, at last with a row of the first day.
    parts = [[(i, day) for i in one], [(i, day + datetime.timedelta(days=5)) for i in other[:3]], [(other[3], day + datetime.timedelta(days=5)), (other[4], day)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(schema).parquet(path).withWatermark("ts", "1 hour")
        K.run_available(K.bounded_buffer(source, "seq", 10, 1000, shards=2, idle_ms=86_400_000, ts="ts"), f"{out}/rows", f"{out}/ckpt")
    held = K.state_table(spark, f"{out}/ckpt", "rows")
    assert rows(held, "seq") == [(i,) for i in other[:4]]
    assert rows(spark.read.parquet(f"{out}/rows"), "shard", "n")[:2] == [(0, 0), (0, 10)]


def test_time_to_live_forgets_tasks(spark, tmp_path):
    path, out, schema = str(tmp_path / "in"), str(tmp_path), "seq long, k string"
    for seq in (1, 2):
        spark.createDataFrame([(seq, "a")], schema).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(schema).parquet(path)
        K.run_available(K.repeated_tasks(source, "k", "seq", ttl_ms=1000), f"{out}/rows", f"{out}/ckpt")
        time.sleep(1.5)
    # The second row is a first one again: the first was forgotten.
    assert spark.read.parquet(f"{out}/rows").count() == 0


def test_build_skips_known_and_compacts(spark, staged, tmp_path):
    docs = stream(spark, str(staged / "docs"))
    out = str(tmp_path)
    build = S.continuous_build(out, ["doc_id"], batch_size=1)
    compacted = []

    def pending():
        return spark.read.parquet(f"{out}/batches").select("batch_id").distinct().count() - 100 * len(compacted)

    def compact():
        done = sinks.compact(spark, f"{out}/batches", f"{out}/chunks", f"{out}/mapping")
        compacted.extend(r.chunk_id for r in done.select("chunk_id").distinct().collect())

    S.run_available(docs, S.with_consolidation(build, compact, 100, pending), f"{out}/ckpt")
    stored = spark.read.parquet(f"{out}/batches")
    texts = spark.read.parquet(str(staged / "docs")).select("text").distinct().count()
    assert stored.count() == texts == stored.select("content_key").distinct().count()
    assert sorted(r.batch_id for r in stored.select("batch_id").collect()) == list(range(texts))
    assert spark.read.parquet(f"{out}/chunks").count() == 100 * len(compacted) > 0


def test_repeated_epoch_changes_nothing(spark, tmp_path):
    step = S.continuous_build(str(tmp_path), ["id"], batch_size=2)
    first = spark.createDataFrame([(i, f"t{i % 4}") for i in range(8)], "id long, text string")
    second = spark.createDataFrame([(i, f"t{i % 6}") for i in range(8, 20)], "id long, text string")
    for df, epoch in [(first, 0), (second, 1), (second, 1), (second, 1)]:
        step(df, epoch)
    found = rows(spark.read.parquet(f"{tmp_path}/batches"), "id", "batch_id")
    assert found == [(0, 0), (1, 0), (2, 1), (3, 1), (10, 2), (11, 2)]


def test_stateful_queries(spark, staged, tmp_path):
    docs = stream(spark, str(staged / "docs"))
    Q.write_append(Q.distinct_keys(docs, "doc_id").select("content_key"), str(tmp_path / "keys"), str(tmp_path / "c1"))
    texts = spark.read.parquet(str(staged / "docs")).select("text").distinct().count()
    assert spark.read.parquet(str(tmp_path / "keys")).count() == texts
    events = stream(spark, str(staged / "events"))
    Q.write_complete(Q.running_moments(events, "event_type", "value"), str(tmp_path / "m"), str(tmp_path / "c2"))
    batch = Q.running_moments(spark.read.parquet(str(staged / "events")), "event_type", "value")
    assert rows(spark.read.parquet(str(tmp_path / "m")), "event_type", "count", "mean") == rows(batch, "event_type", "count", "mean")


def test_watermarks_bound_the_state(spark, staged, tmp_path):
    events = stream(spark, str(staged / "events"))
    fresh = Q.fresh_rows(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "event_id")
    Q.write_append(fresh.select("event_id"), str(tmp_path / "f"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 1000
    named = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("set_name"), F.lit("v").alias("metric"), "value")
    live = Q.live_metrics_by_window(named, "ts", "1 day", "1 hour")
    Q.write_append(live, str(tmp_path / "w"), str(tmp_path / "c2"))
    closed = spark.read.parquet(str(tmp_path / "w"))
    assert closed.count() > 0 and closed.groupBy("window", "set_name").count().where("count > 1").count() == 0


def test_within_watermark_dedup(spark, staged, tmp_path):
    docs = stream(spark, str(staged / "docs")).withColumn("ts", (F.col("doc_id") + 1_700_000_000).cast("timestamp"))
    out = Q.distinct_keys_within(docs, "ts", "2 hours")
    Q.write_append(out.select("content_key"), str(tmp_path / "k"), str(tmp_path / "c"))
    found = spark.read.parquet(str(tmp_path / "k"))
    assert found.count() == found.distinct().count()


def test_epoch_table(spark, tmp_path):
    table = EpochTable(str(tmp_path / "t"))
    assert table.before(spark, 3, "x long").count() == 0
    table.write(spark.range(2).toDF("x"), 0)
    table.write(spark.range(5).toDF("x"), 1)
    table.write(spark.range(3).toDF("x"), 1)
    assert table.before(spark, 2, "x long").count() == 5
    assert table.before(spark, 1, "x long").count() == 2
    assert table.last(spark, 2, "x long").count() == 3

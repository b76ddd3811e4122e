"""Streaming queries: each reads a given table as a stream and returns what the stream wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.plans.storage import work_dir
from gridlake.queries.registry import query, table
from gridlake.queries.storage import PROGRESS_SQL
from gridlake.queries.transitions import NOVELTY_SQL
from gridlake.streaming import keyed as K
from gridlake.streaming import queries as Q
from gridlake.streaming import state as S


#: Input of one micro-batch, about: what a processor puts in order is one key's rows of one of them.
MICRO_BATCH = 256 << 20


def stream(spark, sf_dir, name):
    """The table as a stream over its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", MICRO_BATCH).parquet(f"{sf_dir}/{name}.parquet*")


@query("""with k as (select sha256(text || '_224_224') as k from documents)
select k as content_key, 1::bigint as n from k group by k""")
def stream_dedup(spark, sf_dir):
    out = work_dir(spark, "stream-dedup")
    docs = Q.distinct_keys(stream(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("content_key")
    Q.write_append(docs, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").groupBy("content_key").agg(F.count("*").alias("n"))


@query("""select event_type, count(*) as count, round(avg(value), 6) as mean, round(var_samp(value), 6) as var from events group by event_type""")
def stream_running_stats(spark, sf_dir):
    out = work_dir(spark, "stream-stats")
    stats = Q.running_moments(stream(spark, sf_dir, "events"), "event_type", "value")
    Q.write_complete(stats, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select(
        "event_type", "count", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var")
    )


@query("""with n as (select event_id, user_id, row_number() over (partition by user_id order by event_id) as rn from events)
select event_id, user_id from n where rn >= 2""")
def stream_task_state(spark, sf_dir):
    out = work_dir(spark, "stream-tasks")
    rows = stream(spark, sf_dir, "events").select("event_id", "user_id")
    K.run_available(K.repeated_tasks(rows, "user_id", "event_id"), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select("event_id", "user_id")


@query(f"with {NOVELTY_SQL} select seq, n_before, round(bonus, 6) as bonus from novel")
def stream_novelty(spark, sf_dir):
    out = work_dir(spark, "stream-novelty")
    rows = stream(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat_ws(":", "event_type", F.hour("ts")).alias("state_hash")
    )
    K.run_available(K.novelty(rows, "state_hash", "seq"), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select("seq", "n_before", F.round("bonus", 6).alias("bonus"))


@query("""with e as (select user_id, list(value order by ts, event_id) as vs from events group by user_id)
select user_id, round(list_reduce(vs, lambda a, v: 0.9::double * a + 0.1::double * v), 6) as ema from e""")
def stream_ema(spark, sf_dir):
    out = work_dir(spark, "stream-ema")
    rows = stream(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    K.run_available(K.running_ema(rows, "user_id", ["ts", "event_id"], "value", 0.9), f"{out}/rows", f"{out}/checkpoint")
    return K.state_table(spark, f"{out}/checkpoint", "average").select("user_id", F.round("ema", 6).alias("ema"))


@query("""with c as (select event_id as seq, value from events where event_id >= (select max(event_id) from events) - 5000)
select seq, value from c order by seq desc limit 3000""")
def stream_buffer(spark, sf_dir):
    out = work_dir(spark, "stream-buffer")
    rows = stream(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "value")
    K.run_available(K.bounded_buffer(rows, "seq", 3000, 5000), f"{out}/rows", f"{out}/checkpoint")
    found = K.state_table(spark, f"{out}/checkpoint", "rows").select("seq", "value")
    return K.newest(found, "seq", 3000, 5000)


@query("""with d as (select doc_id, text, row_number() over (partition by text order by doc_id) as rn from documents),
k as (select doc_id, row_number() over (order by doc_id) - 1 as spot from d where rn = 1)
select doc_id, spot // 256 as batch_id from k""")
def stream_build(spark, sf_dir):
    out = work_dir(spark, "stream-build")
    docs = stream(spark, sf_dir, "documents").select("doc_id", "text")
    S.run_available(docs, S.continuous_build(out, ["doc_id"]), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/batches").select("doc_id", "batch_id")


@query("""select event_type as set_name, 'value' as metric, round(sum(value), 4) as value from events group by 1
union all select event_type, 'count', count(*) from events group by 1""")
def stream_metrics(spark, sf_dir):
    out = work_dir(spark, "stream-metrics")
    entries = F.array(
        F.struct(F.lit("value").alias("metric"), F.col("value").alias("value")),
        F.struct(F.lit("count").alias("metric"), F.lit(1.0).alias("value")),
    )
    rows = stream(spark, sf_dir, "events").select(F.col("event_type").alias("set_name"), F.explode(entries).alias("e"))
    live = Q.live_metrics(rows.select("set_name", "e.metric", "e.value"))
    Q.write_complete(live, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").withColumn("value", F.round("value", 4))


@query(f"""with {PROGRESS_SQL}
select chunk_id, (seq // 4000) as epoch, sum(samples)::bigint as samples_trained, arg_max(offs, seq) as last_offset,
  bool_or(offs >= chunk_size) as completed from log group by all""")
def stream_chunk_progress(spark, sf_dir):
    out = work_dir(spark, "stream-progress")
    schema = table(spark, sf_dir, "events").schema
    ev = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    log = ev.select(
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") / 4000).alias("epoch"),
        (F.floor(F.col("event_id") / 100) % 40).alias("chunk_id"),
        ((F.col("event_id") % 100) * 5 + 5).alias("offset"),
        (F.rint("value").cast("long") % 9 + 1).alias("samples"),
        (F.col("user_id") % 90 + 400).alias("chunk_size"),
    )
    Q.write_complete(Q.live_chunk_progress(log), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows")

"""Queries over splits, epochs, batches and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import metrics as M
from gridlake.operators import quality as Q
from gridlake.operators import sampling as S
from gridlake.plans.ordered import hash_order
from gridlake.queries.fixtures import HIERARCHY, hierarchy
from gridlake.queries.registry import query, table


@query("""with h as (select o_orderkey, ('0x' || substr(md5(o_orderkey::varchar || '|42'), 1, 8))::bigint as d from orders)
select o_orderkey, case when d < 3865470566 then 'train' else 'test' end as split from h""")
def split_train_test(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return S.train_split(orders, "o_orderkey")


ORDER_SQL = f"""{HIERARCHY},
draws as (select *, md5(puzzle_id::varchar || '|5|2') as h from puzzles),
picked as (select set_name, group_id, puzzle_id, size from draws
           qualify row_number() over (partition by set_name, group_id order by h) = 1),
ranked as (select *, row_number() over (partition by set_name order by md5(group_id::varchar || '|5|2')) - 1 as rank from picked),
lanes as (select *, (rank % 2)::int as shard, rank // 2 as shard_pos from ranked)"""


@query(f"with {ORDER_SQL} select set_name, group_id, puzzle_id, size, rank, shard, shard_pos from lanes")
def stride_shards(spark, sf_dir):
    draw = hash_order(F.col("puzzle_id"), 5, 2)
    picked = (
        hierarchy(spark, sf_dir)
        .groupBy("set_name", "group_id")
        .agg(F.min(F.struct(draw.alias("h"), "puzzle_id", "size")).alias("p"))
        .select("set_name", "group_id", "p.puzzle_id", "p.size")
    )
    return S.stride_shards(S.epoch_order(picked, ["set_name"], ["group_id"], 5, 2), "rank", 2)


PACK_SQL = f"""{ORDER_SQL},
walk(set_name, shard, shard_pos, batch_id, take, fill, done) as (
  select set_name, shard, -1::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint from lanes group by all
  union all
  select l.set_name, l.shard, l.shard_pos, w.done, least(l.size, 64 - w.fill),
    case when w.fill + least(l.size, 64 - w.fill) >= 64 then 0 else w.fill + least(l.size, 64 - w.fill) end,
    w.done + case when w.fill + least(l.size, 64 - w.fill) >= 64 then 1 else 0 end
  from walk w join lanes l on l.set_name = w.set_name and l.shard = w.shard and l.shard_pos = w.shard_pos + 1),
packed as (
  select w.set_name, w.shard, w.batch_id, w.shard_pos, l.group_id, l.puzzle_id, l.size, w.take
  from walk w join lanes l using (set_name, shard, shard_pos))"""


@query(f"with recursive {PACK_SQL} select * from packed")
def epoch_batches(spark, sf_dir):
    return S.epoch_batches(hierarchy(spark, sf_dir), 64, seed=5, epoch=2, shards=2)


@query(f"""with recursive {PACK_SQL},
ex as (select l_orderkey as puzzle_id, row_number() over (
    partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as example_id from lineitem),
r as (select *, row_number() over (partition by puzzle_id order by md5(puzzle_id::varchar || '|' || example_id || '|5|2')) as rn from ex),
c as (select p.*, example_id, rn from r join packed p using (puzzle_id) where rn <= take)
select set_name, shard, batch_id, (row_number() over (partition by set_name, shard, batch_id order by shard_pos, rn) - 1)::int as pos,
  group_id, puzzle_id, example_id from c""")
def epoch_examples(spark, sf_dir):
    from gridlake.plans.ordered import with_position

    batches = S.epoch_batches(hierarchy(spark, sf_dir), 64, seed=5, epoch=2, shards=2)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    numbered = with_position(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    examples = numbered.select(F.col("l_orderkey").alias("puzzle_id"), (F.col("pos") + 1).alias("example_id"))
    return S.epoch_examples(batches, examples, 64, seed=5, epoch=2)


@query("""with r as (select o_orderpriority as set_name, o_orderkey as example_id,
  row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as rank from orders)
select set_name, example_id, (rank % 3)::int as shard, (rank // 3) // 128 as batch_id, ((rank // 3) % 128)::int as pos from r""")
def test_batches(spark, sf_dir):
    ex = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("set_name"), F.col("o_orderkey").alias("example_id")
    )
    return S.test_batches(ex, ["set_name"], ["example_id"], 128, shards=3)


@query("""with r as (select o_orderpriority as set_name, o_orderkey as inputs, (o_custkey % 11)::int as label,
  row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as rank from orders),
b as (select set_name, rank // 128 as batch_id, (rank % 128)::int as pos, inputs, label, inputs as puzzle_id from r),
n as (select set_name, batch_id, count(*) as n from b group by all)
select set_name, batch_id, pos, inputs, case when label = 3 then -100 else label end as label, puzzle_id from b
union all
select set_name, batch_id, p::int as pos, 0 as inputs, -100 as label, -1 as puzzle_id from n, range(128) t(p) where p >= n""")
def padded_batches(spark, sf_dir):
    """Batches of orders padded to 128 rows; the stored label 3 stands for an ignored one."""
    ex = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("set_name"),
        F.col("o_orderkey").alias("inputs"),
        (F.col("o_custkey") % 11).cast("int").alias("label"),
        F.col("o_orderkey").alias("puzzle_id"),
    )
    batches = S.test_batches(ex, ["set_name"], ["inputs"], 128).drop("shard")
    pads = {"inputs": F.lit(0).cast("long"), "label": F.lit(-100), "puzzle_id": F.lit(-1).cast("long")}
    return S.pad_batches(batches, ["set_name", "batch_id"], 128, pads, ignore=3)


@query("""with r as (select doc_id, row_number() over (order by md5(doc_id::varchar || '|1')) - 1 as spot from documents)
select doc_id, spot // 256 as batch_id from r""")
def sink_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", hash_order(F.col("doc_id"), 1).alias("arrival"))
    return S.numbered_batches(docs, ["arrival"]).select("doc_id", "batch_id")


@query("""select event_id, value from events order by ts, event_id offset 234""")
def resume_rows(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return S.skip_rows(ev, ["ts", "event_id"], 234).select("event_id", "value")


SAMPLES_SQL = """
samples as (
  select conv_id * 100 + turn as seq, case when conv_id % 3 = 0 then 'conv' || conv_id % 10
    when conv_id % 3 = 1 then 'role_' || role else 'unknown' end as task, turn % 4 <> 3 as has_grid from conversations)"""


def task_samples(spark, sf_dir):
    """Messages as samples whose task is in ``task_id``, in ``puzzle_id`` or missing."""
    conv = table(spark, sf_dir, "conversations")
    kind = F.col("conv_id") % 3
    meta = (
        F.when(kind == 0, F.create_map(F.lit("task_id"), F.concat(F.lit("conv"), F.col("conv_id") % 10), F.lit("puzzle_id"), F.lit("x")))
        .when(kind == 1, F.create_map(F.lit("puzzle_id"), F.concat(F.lit("role_"), F.col("role"))))
        .otherwise(F.create_map(F.lit("other"), F.lit("y")))
    )
    rows = conv.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
        meta.alias("metadata"),
        F.when(F.col("turn") % 4 != 3, F.array(F.array(F.col("turn").cast("int")))).alias("grid"),
    )
    return rows.withColumn("task", S.task_key(F.col("metadata")))


@query(f"""with {SAMPLES_SQL},
n as (select *, row_number() over (partition by task order by seq) as rn from samples)
select task, seq, seq || '_distlearn' as sample_id, 'distribution_learning' as task_type from n where rn >= 2 and has_grid""")
def distlearn_rows(spark, sf_dir):
    rows = S.distribution_rows(task_samples(spark, sf_dir))
    marked = rows.withColumn("metadata", S.with_entry(F.col("metadata"), "task_type", F.lit("distribution_learning")))
    return marked.select(
        "task", "seq", F.concat(F.col("seq"), F.lit("_distlearn")).alias("sample_id"), F.try_element_at("metadata", F.lit("task_type")).alias("task_type")
    )


@query(f"""with {SAMPLES_SQL},
n as (select *, row_number() over (partition by task order by seq) as rn, count(*) over (partition by task) as k from samples)
select task, seq from n where k >= 2 and rn <= 5 and has_grid""")
def distlearn_batch(spark, sf_dir):
    return S.distribution_rows(task_samples(spark, sf_dir), streaming=False).select("task", "seq")


@query("""with b as (select doc_id, case when n_chars < 800 then 'easy' when n_chars < 3000 then 'medium' else 'hard' end as bucket,
    md5(doc_id::varchar || '|3') as h from documents),
r as (select *, row_number() over (partition by bucket order by h) - 1 as rk, (select count(*) from documents) as n from b)
select doc_id, bucket from r where rk < floor(n * case bucket when 'medium' then 0.5::double else 0.25 end)""")
def difficulty_balance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", hash_order(F.col("doc_id"), 3).alias("h"))
    return Q.balance_by_difficulty(docs, "n_chars", 800, 3000, "h").select("doc_id", "bucket")


@query("""select doc_id, quality, round(case when doc_id % 4 = 0 then null else n_chars / 5000.0::double end, 6) as solvability
from documents left join labels using (doc_id)
where coalesce(case when doc_id % 4 = 0 then null else n_chars / 5000.0::double end, 1.0) >= 0.3""")
def quality_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    score = F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") / 5000.0)
    scored = docs.join(labels, "doc_id", "left").withColumn("solvability", score)
    kept = Q.filter_low_quality(scored)
    return kept.select("doc_id", "quality", F.round("solvability", 6).alias("solvability"))


@query("""with r as (select doc_id, n_chars, row_number() over (order by n_chars desc, doc_id) - 1 as rk from documents)
select doc_id, case when (rk // 8) % 2 = 0 then rk % 8 else 7 - rk % 8 end::int as shard from r""")
def balanced_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return S.balanced_shards(docs, "n_chars", "doc_id", 8).select("doc_id", "shard")


@query("""with r as (select doc_id, n_chars, row_number() over (order by n_chars desc, doc_id) - 1 as rk from documents),
s as (select case when (rk // 8) % 2 = 0 then rk % 8 else 7 - rk % 8 end as shard, sum(n_chars) as t from r group by 1)
select round(stddev_pop(t) / (avg(t) + 1e-6::double), 6) as load_balance from s""")
def shard_balance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    sharded = S.balanced_shards(docs, "n_chars", "doc_id", 8)
    return M.load_balance(sharded, "shard", "n_chars").withColumn("load_balance", F.round("load_balance", 6))


@query(f"""with {HIERARCHY},
d as (select set_name, count(distinct group_id) as g, count(*) as n, avg(size) as m from puzzles group by set_name)
select 0 as pad_id, -100 as ignore_label_id, 0 as blank_identifier_id, 2052 as vocab_size, 12 as seq_len,
  (count(*) * 7)::bigint as num_puzzle_identifiers, sum(g)::bigint as total_groups, round(sum(m * n) / sum(n), 6) as mean_puzzle_examples,
  sum(n)::bigint as total_puzzles, 'all' as sets from d""")
def merged_metadata(spark, sf_dir):
    """One dataset per order priority, merged."""
    per = hierarchy(spark, sf_dir).groupBy("set_name").agg(
        F.count_distinct("group_id").alias("total_groups"),
        F.count("*").alias("total_puzzles"),
        F.avg("size").alias("mean_puzzle_examples"),
    )
    described = per.select(
        F.lit(0).alias("pad_id"), F.lit(-100).alias("ignore_label_id"), F.lit(0).alias("blank_identifier_id"),
        F.lit(2052).alias("vocab_size"), F.lit(12).alias("seq_len"), F.lit(7).cast("long").alias("num_puzzle_identifiers"),
        "total_groups", "mean_puzzle_examples", "total_puzzles", F.array(F.lit("all")).alias("sets"),
    )
    merged = S.merge_metadata(described)
    return merged.withColumn("mean_puzzle_examples", F.round("mean_puzzle_examples", 6)).withColumn(
        "sets", F.array_join("sets", ",")
    )

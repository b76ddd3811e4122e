"""Queries over run metrics, timings and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import numeric as N
from gridlake.operators import metrics as M
from gridlake.plans.bounds import spread
from gridlake.queries.registry import query, table

METRIC_SQL = """
ev as (select *, (props::json ->> '$.k')::double as k from events),
run_metrics as (
  select event_id // 500 as step, event_type as set_name, unnest(['lm_loss', 'accuracy', 'count']) as metric,
         unnest([value, k, 1.0::double]) as value from ev)"""


def run_metrics(spark, sf_dir):
    """Each event as one run of the set named by its type, with a loss, an accuracy and a count."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    entries = F.array(
        F.struct(F.lit("lm_loss").alias("metric"), F.col("value").alias("value")),
        F.struct(F.lit("accuracy").alias("metric"), k.alias("value")),
        F.struct(F.lit("count").alias("metric"), F.lit(1.0).alias("value")),
    )
    rows = ev.select(
        F.floor(F.col("event_id") / 500).alias("step"), F.col("event_type").alias("set_name"), F.explode(entries).alias("e")
    )
    return rows.select("step", "set_name", "e.metric", "e.value")


@query(f"""with {METRIC_SQL}, s as (select set_name, metric, sum(value) as v from run_metrics group by all)
select a.set_name, a.metric, round(a.v / b.v, 6) as value from s a join s b using (set_name)
where a.metric <> 'count' and b.metric = 'count'""")
def metric_reduce(spark, sf_dir):
    return M.reduce_by_set(run_metrics(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"""with {METRIC_SQL}, s as (select step, metric, sum(value) as v from run_metrics group by all)
select a.step, a.metric, round(a.v / case when a.metric like '%loss' then 768 else greatest(b.v, 1) end, 6) as value
from s a join s b using (step) where b.metric = 'count'""")
def metric_reduce_train(spark, sf_dir):
    return M.reduce_training(run_metrics(spark, sf_dir), 768).withColumn("value", F.round("value", 6))


@query("""with t as (select l_linenumber as seq_len, l_extendedprice / 100 as ms, l_orderkey * 1000000 + l_partkey as id from lineitem),
r as (select *, row_number() over (partition by seq_len order by ms, id) - 1 as pos, count(*) over (partition by seq_len) as n from t)
select seq_len, round(avg(ms), 2) as mean, round(min(ms), 2) as min, round(max(ms), 2) as max,
  round(max(ms) filter (pos = n // 2), 2) as p50, round(max(ms) filter (pos = floor(n * 0.95::double)), 2) as p95,
  round(max(ms) filter (pos = floor(n * 0.99::double)), 2) as p99 from r group by seq_len""")
def latency_stats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("seq_len"),
        (F.col("l_extendedprice") / 100).alias("ms"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("id"),
    )
    return M.latency_summary(li, ["seq_len"], "ms", "id")


LAYERS = [
    "H_level.0.attn", "H_init", "L_level.1.mlp", "L_init", "q_head.weight", "memory.keys", "embed_tokens",
    "lm_head.weight", "rotary.cos",
]

TELEMETRY_SQL = f"""
raw as (
  select (year(l_shipdate) * 12 + month(l_shipdate))::int as step,
         {LAYERS}[(l_partkey % {len(LAYERS)} + 1)::int] as name,
         l_quantity * case when month(l_shipdate) % 5 = 0 then 1.3e-8::double when month(l_shipdate) % 5 = 1 then 3 else 1 end as norm,
         l_discount * case when month(l_shipdate) % 4 = 0 then 20 else 1 end as dead from lineitem),
layers as (select step, name, max(norm) as grad_norm, avg(dead) as dead_ratio from raw group by all),
sums as (
  select step, avg(grad_norm) as norm_mean, stddev_pop(grad_norm) as norm_std, max(grad_norm) as norm_max,
    min(grad_norm) as norm_min, avg(dead_ratio) as dead_mean, max(dead_ratio) as dead_max from layers group by step)"""


def layers(spark, sf_dir):
    """Shipping months as training steps, with the norms and dead shares of nine layers."""
    li = table(spark, sf_dir, "lineitem")
    month = F.month("l_shipdate")
    scale = F.when(month % 5 == 0, F.lit(1.3e-8)).when(month % 5 == 1, F.lit(3.0)).otherwise(F.lit(1.0))
    dead = F.col("l_discount") * F.when(month % 4 == 0, F.lit(20.0)).otherwise(F.lit(1.0))
    name = F.get(F.array(*[F.lit(n) for n in LAYERS]), (F.col("l_partkey") % len(LAYERS)).cast("int"))
    return li.groupBy((F.year("l_shipdate") * 12 + month).alias("step"), name.alias("name")).agg(
        F.max(F.col("l_quantity") * scale).alias("grad_norm"), F.avg(dead).alias("dead_ratio")
    )


@query(f"""with {TELEMETRY_SQL},
w as (select *, row_number() over (order by step) as n,
        var_pop(norm_mean) over (order by step rows between 9 preceding and current row) as v from sums),
f as (select *, list_filter([case when norm_mean < 1e-5 then 'vanishing_gradients' end, case when norm_max > 100 then 'exploding_gradients' end,
   case when dead_mean > 0.5 then 'dead_neurons' end, case when n > 10 and v > 100 then 'unstable_training' end], lambda x: x is not null) as fl from w)
select step, round(norm_mean, 6) as norm_mean, round(norm_std, 6) as norm_std, round(norm_max, 6) as norm_max,
  round(norm_min, 6) as norm_min, round(dead_mean, 6) as dead_mean, round(dead_max, 6) as dead_max,
  case when len(fl) = 0 then 'healthy' else array_to_string(fl, ',') end as issues from f""")
def telemetry_diagnosis(spark, sf_dir):
    report = M.diagnose(layers(spark, sf_dir))
    names = ["norm_mean", "norm_std", "norm_max", "norm_min", "dead_mean", "dead_max"]
    return report.select("step", *[F.round(n, 6).alias(n) for n in names], F.array_join("issues", ",").alias("issues"))


@query(f"""with {TELEMETRY_SQL},
c as (select *, case when name like '%H\\_level%' escape '\\' or name like '%H\\_init%' escape '\\' then 'H_level'
  when name like '%L\\_level%' escape '\\' or name like '%L\\_init%' escape '\\' then 'L_level' when contains(name, 'q_head') then 'q_head'
  when contains(name, 'memory') then 'memory' when contains(name, 'embed') then 'embed' when contains(name, 'lm_head') then 'lm_head' end as component from layers)
select step, component, round(avg(grad_norm), 6) as norm_mean, round(max(grad_norm), 6) as norm_max
from c where component is not null group by all""")
def telemetry_components(spark, sf_dir):
    out = M.component_summary(layers(spark, sf_dir))
    return out.select("step", "component", F.round("norm_mean", 6).alias("norm_mean"), F.round("norm_max", 6).alias("norm_max"))


@query("""with v as (
  select label, case when x::double between -0.02 and 0.02 then x::double * 1e-6 else x::double end as g,
         round(x::double, 1) as p from (select label, unnest(embedding) as x from embeddings))
select label as layer, round(sqrt(sum(g * g)), 6) as grad_norm, round(avg(g), 6) as grad_mean, round(stddev_samp(g), 6) as grad_std,
  round(max(abs(g)), 6) as grad_max, round(avg((abs(g) < 1e-8::double)::int), 6) as dead_ratio,
  round(avg((abs(g) < 1e-6::double)::int), 6) as sparsity, round(sqrt(sum(p * p)), 6) as param_norm,
  round(sqrt(sum(g * g)) / (sqrt(sum(p * p)) + 1e-8::double), 6) as grad_to_param from v group by label""")
def layer_statistics(spark, sf_dir):
    """Embedding values as the gradients of ten layers; small ones are pushed towards zero."""
    values = spread(table(spark, sf_dir, "embeddings")).select("label", F.explode("embedding").alias("e"))
    x = F.col("e").cast("double")
    rows = values.select(
        F.col("label").alias("layer"),
        F.when(x.between(-0.02, 0.02), x * 1e-6).otherwise(x).alias("g"),
        F.round(x, 1).alias("p"),
    )
    out = M.layer_statistics(rows, ["layer"], "g", "p")
    return out.select("layer", *[F.round(c, 6).alias(c) for c in out.columns if c != "layer"])


RUNNING_SQL = """
b as (select event_type, ts::date as day, count(value) as n, avg(value) as m, coalesce(var_samp(value), 0) as v from events group by all),
l as (select event_type, list({'day': day, 'n': n::double, 'm': m, 'v': v} order by day) as bs from b group by event_type),
idx as (select event_type, unnest(range(1, len(bs) + 1)) as i, bs from l),
folded as (
  select event_type, bs[i].day as day, list_reduce(
    list_transform(bs[1:i], lambda x: {'n': x.n, 'm': x.m, 'v': x.v}),
    lambda a, x: {'n': a.n + x.n, 'm': a.m + (x.m - a.m) * x.n / (a.n + x.n),
       'v': (a.v * a.n + x.v * x.n + (x.m - a.m) * (x.m - a.m) * a.n * x.n / (a.n + x.n)) / (a.n + x.n)}) as s from idx)"""


@query(f"""with {RUNNING_SQL}
select event_type, day::varchar as day, s.n::bigint as count, round(s.m, 6) as mean, round(s.v, 6) as var from folded""")
def running_stats(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    batches = M.batch_statistics(ev, ["event_type"], "day", "value")
    out = M.running_statistics(batches, ["event_type"], "day")
    return out.select(
        "event_type", F.col("day").cast("string").alias("day"), "count", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var")
    )


@query(f"""with {RUNNING_SQL},
fin as (select event_type, arg_max(s, day) as s from folded group by event_type)
select event_id, round((value - s.m) / (sqrt(s.v) + 1e-8::double), 6) as z, round(value, 6) as back from events join fin using (event_type)""")
def normalised_values(spark, sf_dir):
    """Events normalised with the final running statistics of their type, and brought back."""
    ev = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    running = M.running_statistics(M.batch_statistics(ev, ["event_type"], "day", "value"), ["event_type"], "day")
    final = running.groupBy("event_type").agg(F.max_by("mean", "day").alias("m"), F.max_by("var", "day").alias("v"))
    z = N.normalize(F.col("value"), F.col("m"), F.col("v"))
    rows = ev.join(F.broadcast(final), "event_type").withColumn("z", z)
    back = N.denormalize(F.col("z"), F.col("m"), F.col("v"))
    return rows.select("event_id", F.round("z", 6).alias("z"), F.round(back, 6).alias("back"))


@query("""with e as (select user_id, list(value order by ts, event_id) as vs from events group by user_id)
select user_id, round(list_reduce(vs, lambda a, v: 0.9::double * a + 0.1::double * v), 6) as ema,
  round(list_reduce(list_concat([0.0::double], vs), lambda a, v: 0.99::double * a + 0.01::double * v), 6) as from_zero from e""")
def ema(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    a = M.ema(ev, ["user_id"], ["ts", "event_id"], "value", 0.9)
    b = M.ema(ev, ["user_id"], ["ts", "event_id"], "value", 0.99, start=0.0)
    return a.join(b.withColumnRenamed("ema", "from_zero"), "user_id").select(
        "user_id", F.round("ema", 6).alias("ema"), F.round("from_zero", 6).alias("from_zero")
    )


@query("""with a as (select user_id, case event_type when 'view' then 0 when 'click' then 1 else 2 end as action from events)
select user_id, count(*) filter (action = 0) as n_continue, count(*) filter (action = 1) as n_halt,
  count(*) filter (action = 2) as n_expand, round(count(*) filter (action = 2) * 100.0::double / count(*), 6) as expand_pct from a group by user_id""")
def action_distribution(spark, sf_dir):
    action = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    ev = table(spark, sf_dir, "events").select("user_id", action.alias("action"))
    return M.action_distribution(ev, ["user_id"], "action").withColumn("expand_pct", F.round("expand_pct", 6))


@query("""with t as (select l_suppkey as w, sum(l_quantity) as t from lineitem group by 1)
select round(stddev_pop(t) / (avg(t) + 1e-6::double), 6) as load_balance from t""")
def load_balance(spark, sf_dir):
    return M.load_balance(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity").withColumn(
        "load_balance", F.round("load_balance", 6)
    )


@query("""with e as (select label, i, sum(embedding[i + 1]::double) as s from embeddings, range(64) t(i) group by all)
select label, i::int as dim, round(s, 6) as total, sign(s)::int as sign from e""")
def keyed_vector_sum(spark, sf_dir):
    out = M.keyed_vector_sum(table(spark, sf_dir, "embeddings"), "label", "embedding", 64)
    rows = out.select("label", F.posexplode(F.arrays_zip("total", "sign")).alias("dim", "s"))
    return rows.select("label", "dim", F.round("s.total", 6).alias("total"), F.col("s.sign").cast("int").alias("sign"))

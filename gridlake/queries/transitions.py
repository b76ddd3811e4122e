"""Queries over transition tables derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import numeric as N
from gridlake.operators import transitions as R
from gridlake.queries.registry import query, table

TRANSITION_SQL = """
tr as (
  select event_id as seq, user_id, row_number() over w as step,
    case event_type when 'view' then 0 when 'click' then 1 else 2 end as action, round(value / 100, 6) as reward,
    value as s1, hour(ts)::double as s2, lead(value) over w as n1, lead(hour(ts)::double) over w as n2
  from events window w as (partition by user_id order by ts, event_id)),
transitions as (
  select seq, user_id, step, action, reward, s1, s2, coalesce(n1, s1) as n1, coalesce(n2, s2) as n2, n1 is null as done from tr)"""


def transitions(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    steps = ev.select(
        F.col("event_id").alias("seq"),
        "user_id",
        "ts",
        "event_id",
        action.alias("action"),
        F.round(F.col("value") / 100, 6).alias("reward"),
        "value",
    )
    state = F.array(F.col("value"), F.hour("ts").cast("double"))
    return R.to_transitions(steps, ["user_id"], ["ts", "event_id"], state)


@query(f"with {TRANSITION_SQL} select seq, user_id, step, action, reward, s1, s2, n1, n2, done from transitions", name="transitions")
def transitions_query(spark, sf_dir):
    return transitions(spark, sf_dir).select(
        "seq", "user_id", "step", "action", "reward",
        F.get("state", F.lit(0)).alias("s1"), F.get("state", F.lit(1)).alias("s2"),
        F.get("next_state", F.lit(0)).alias("n1"), F.get("next_state", F.lit(1)).alias("n2"), "done",
    )


@query("""with t as (
  select vec_id, i, label, embedding[i * 16 + 1]::double as h, row_number() over (partition by vec_id order by i) as n
  from embeddings, range(4) x(i))
select vec_id, n as step, h as state, coalesce(lead(h) over w, h) as next_state, lead(h) over w is null as done,
  case when lead(h) over w is not null then -0.01::double when label < 5 then 1.0 else -1.0 end as reward
from t window w as (partition by vec_id order by i)""")
def trajectory_rewards(spark, sf_dir):
    """Four steps per vector, rewarded at the end by whether its label is below five."""
    emb = table(spark, sf_dir, "embeddings")
    steps = emb.select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    state = F.get("embedding", F.col("i") * 16).cast("double")
    out = R.to_transitions(steps, ["vec_id"], ["i"], state, correct=F.col("label") < 5)
    return out.select("vec_id", "step", "state", "next_state", "done", "reward")


# Action values of three actions, derived from the state of a transition.
Q_SQL = f"""{TRANSITION_SQL},
q as (
  select *, [ln(1 + s1), ln(1 + s2), ln(2 + s1 + s2) / 2] as qs, [ln(1 + n1), ln(1 + n2), ln(2 + n1 + n2) / 2] as qn,
    [ln(3 + n2), ln(5 + n1), 0.5::double] as qt from transitions),
e as (
  select *, qs[action + 1] as cur,
    reward + 0.99::double * list_max(qn) * (case when done then 0 else 1 end) as t1,
    reward + 0.99::double * qt[list_position(qn, list_max(qn))] * (case when done then 0 else 1 end) as t2 from q),
td as (select *, cur - t1 as td, cur - t2 as td2 from e)"""


def td_errors(spark, sf_dir):
    tr = transitions(spark, sf_dir)

    def values(name):
        a, b = F.get(name, F.lit(0)), F.get(name, F.lit(1))
        return F.array(F.ln(1 + a), F.ln(1 + b), F.ln(2 + a + b) / 2)

    a, b = F.get("next_state", F.lit(0)), F.get("next_state", F.lit(1))
    frozen = F.array(F.ln(3 + b), F.ln(5 + a), F.lit(0.5))
    scored = tr.withColumn("q", values("state")).withColumn("q_next", values("next_state")).withColumn("q_frozen", frozen)
    target = R.td_target(F.col("reward"), R.max_q(F.col("q_next")), F.col("done"))
    target2 = R.td_target(F.col("reward"), R.double_q(F.col("q_next"), F.col("q_frozen")), F.col("done"))
    return scored.withColumn("td_error", R.td_error(F.col("q"), F.col("action"), target)).withColumn(
        "td_double", R.td_error(F.col("q"), F.col("action"), target2)
    )


@query(f"""with {Q_SQL}
select seq, round(td, 6) as td_error, round(td2, 6) as td_double, round(td * td, 6) as squared,
  round(case when abs(td2) < 1 then 0.5 * td2 * td2 else abs(td2) - 0.5 end, 6) as huber from td""")
def td_error(spark, sf_dir):
    td, td2 = F.col("td_error"), F.col("td_double")
    return td_errors(spark, sf_dir).select(
        "seq",
        F.round(td, 6).alias("td_error"),
        F.round(td2, 6).alias("td_double"),
        F.round(td * td, 6).alias("squared"),
        F.round(N.huber(td2), 6).alias("huber"),
    )


@query(f"""with {Q_SQL},
kept as (select * from td where abs(td) >= 0.5),
held as (select * from kept order by seq desc limit 2000)
select (select count(*) from held) as size, round((select avg(reward) from held), 6) as mean_reward,
  round((select stddev_pop(reward) from held), 6) as std_reward, round((select avg(step) from held), 6) as mean_episode_length,
  (select count(*) from td) as total_attempts, round((select count(*) from held) / 2000.0::double, 6) as utilization,
  (select count(*) from td where abs(td) < 0.5) as rejected_count,
  round((select avg((abs(td) < 0.5)::int) from td), 6) as rejection_rate,
  printf('%.1f%%', (select avg((abs(td) < 0.5)::int) from td) * 100) as memory_savings""")
def replay_stats(spark, sf_dir):
    stats = R.buffer_stats(td_errors(spark, sf_dir), 2000, threshold=0.5)
    for name in ("mean_reward", "std_reward", "mean_episode_length", "utilization", "rejection_rate"):
        stats = stats.withColumn(name, F.round(name, 6))
    return stats


@query("""with k as (select event_id as seq, user_id % 17 as who from events where user_id % 17 <> 0),
c as (select * from k where seq >= (select max(seq) from k) - 5000)
select seq, who from c order by seq desc limit 3000""")
def replay_retain(spark, sf_dir):
    """Padding dropped, old rows dropped, then the last 3000 rows kept."""
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 17).alias("who"))
    real = R.drop_blank(ev, "who", 0)
    return R.retain(R.drop_old(real, "seq", 5000), 3000)


@query("""select event_id as seq, value from events order by md5(event_id::varchar || '|7'), event_id
limit least(256, (select count(*) from events))""")
def replay_uniform(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "value")
    return R.sample_uniform(ev, 256, seed=7)


@query("""with n as (select count(*) as n from events),
r as (select event_id as seq, md5(event_id::varchar || '|9') as h, row_number() over (order by event_id desc) as back from events),
f as (select seq, h, back <= least(1000, (select n from n) // 10) as recent from r),
k as (select *, row_number() over (partition by recent order by h) as rn from f)
select seq, recent from k where (recent and rn <= 64) or (not recent and rn <= 192)""")
def replay_recent_mix(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))
    return R.sample_recent_mix(ev, 256, seed=9)


@query("""with w as (
  select event_id as seq, pow(value + 0.01, 0.6) as w,
    (('0x' || substr(md5(event_id::varchar || '|11'), 1, 8))::bigint + 1) / (pow(2, 32) + 1) as u from events),
k as (select seq, w, -ln(u) / w as key from w order by key, seq limit 256),
s as (select seq, pow((select count(*) from w) * w / (select sum(w) from w), -0.401) as raw from k)
select seq, round(raw / (select max(raw) from s), 6) as weight from s""")
def replay_prioritized(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.col("value") + 0.01).alias("priority")
    )
    drawn = R.sample_prioritized(ev, 256, seed=11)
    return drawn.select("seq", F.round("weight", 6).alias("weight"))


@query(f"""with {Q_SQL},
upd as (select seq, abs(td) + 1e-6::double as p from td where action = 1),
top as (select greatest(1.0, (select max(p) from upd), (select max(reward) from td where action = 2)) as t)
select seq, round(case when action = 1 then (select p from upd where upd.seq = td.seq) when action = 2 then reward
  else (select t from top) end, 6) as priority from td""")
def replay_priorities(spark, sf_dir):
    """Clicks get new errors, views are new rows, the others keep their priority."""
    td = td_errors(spark, sf_dir)
    held = td.select("seq", F.when(F.col("action") == 2, F.col("reward")).alias("priority"))
    errors = td.where("action = 1").select("seq", "td_error")
    return R.update_priorities(held, errors).select("seq", F.round("priority", 6).alias("priority"))


NOVELTY_SQL = """
visits as (
  select event_id as seq, user_id, event_type || ':' || hour(ts) as state_hash,
    row_number() over (partition by event_type || ':' || hour(ts) order by event_id) - 1 as n_before from events),
novel as (select *, 0.1::double / (sqrt(n_before + 1) + 1e-8::double) as bonus from visits)"""


def novelty(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat_ws(":", "event_type", F.hour("ts")).alias("state_hash"),
        (F.col("value") / 100).alias("rnd_error"),
        F.when(F.col("user_id") % 3 != 0, F.col("value") / 50).alias("dynamics_error"),
    )
    return R.novelty_bonus(ev, "state_hash", "seq")


@query(f"""with {NOVELTY_SQL}
select seq, state_hash, n_before, round(bonus, 6) as bonus,
  round(bonus + value / 100 * 0.1 + coalesce(case when e.user_id % 3 <> 0 then value / 50 * 0.05 end, 0), 6) as intrinsic
from novel join events e on e.event_id = seq""")
def novelty_bonus(spark, sf_dir):
    total = R.intrinsic_total(F.col("bonus"), {"rnd_error": 0.1, "dynamics_error": 0.05})
    return novelty(spark, sf_dir).select(
        "seq", "state_hash", "n_before", F.round("bonus", 6).alias("bonus"), F.round(total, 6).alias("intrinsic")
    )


REWARD_SQL = f"""{NOVELTY_SQL},
g as (
  select event_id as seq, event_id // 200 as batch, value / 500 as acc,
    case event_type when 'view' then 0 when 'click' then 1 else 2 end as action,
    event_type = 'click' as halted, value > 30 as correct,
    value / 500 - coalesce(lag(value / 500) over (partition by user_id order by ts, event_id), 0) as gain from events),
rw as (
  select g.*, gain - 0.01::double + case when halted then case when correct then 1.0 else -0.5 end else 0 end
    + case when gain > 0 then 0.5 else 0 end + case when action = 2 and gain > 0 then 0.1::double else 0 end + n.bonus as reward
  from g join novel n using (seq))"""


def shaped_rewards(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        "user_id", "ts", "event_id", "event_type", "value",
        F.floor(F.col("event_id") / 200).alias("batch"),
        (F.col("value") / 500).alias("acc"),
    )
    kind = F.col("event_type")
    gains = R.improvement(ev, ["user_id"], ["ts", "event_id"], "acc", "gain")
    bonus = novelty(spark, sf_dir).select("seq", "bonus")
    action = F.when(kind == "view", 0).when(kind == "click", 1).otherwise(2)
    reward = R.shaped_reward(
        F.col("gain"), kind == "click", F.col("value") > 30, action, F.col("bonus"), with_memory=True
    )
    return gains.join(bonus, "seq").withColumn("reward", reward)


@query(f"""with {REWARD_SQL},
b as (select batch, count(*) as n, avg(reward) as m, coalesce(var_samp(reward), 0) as v from rw group by batch),
bs as (select list({{'batch': batch, 'n': n::double, 'm': m, 'v': v}} order by batch) as bs from b),
i as (select unnest(range(1, len(bs) + 1)) as i, bs from bs),
f as (select bs[i].batch as batch, list_reduce(list_transform(bs[1:i], lambda x: {{'n': x.n, 'm': x.m, 'v': x.v}}),
    lambda a, x: {{'n': a.n + x.n, 'm': a.m + (x.m - a.m) * x.n / (a.n + x.n),
       'v': (a.v * a.n + x.v * x.n + (x.m - a.m) * (x.m - a.m) * a.n * x.n / (a.n + x.n)) / (a.n + x.n)}}) as s from i)
select seq, round(gain, 6) as gain, round(reward, 6) as reward,
  round(case when s.n > 100 then (reward - s.m) / (sqrt(s.v) + 1e-8::double) else reward end, 6) as normalised
from rw join f using (batch)""")
def shaped_reward(spark, sf_dir):
    scaled = R.normalise_rewards(shaped_rewards(spark, sf_dir), "batch")
    return scaled.select("seq", *[F.round(c, 6).alias(c) for c in ("gain", "reward", "normalised")])


@query("""with c as (
  select vec_id, label, embedding[1]::double as gain, vec_id % 4 as e, vec_id % 3 as k,
    (select avg(sqrt(s)) from (select j, sum(embedding[j * 16 + i + 1]::double ** 2) as s from range(4) a(j), range(16) b(i) group by j)) as n
  from embeddings)
select vec_id, round(10 * gain - 0.01::double * e * 4 + 0.005::double * k + 0.1::double * least(greatest(n, 0), 1)
  + case when label < 3 then case when label = 0 then 1.0 else -0.5 end else 0 end, 6) as reward from c""")
def capsule_reward(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: N.norm(F.slice("embedding", j * 16 + 1, F.lit(16))))
    reward = R.capsule_reward(
        F.get("embedding", F.lit(0)).cast("double"),
        F.col("vec_id") % 4,
        N.mean(parts),
        F.col("label") < 3,
        F.col("label") == 0,
        F.col("vec_id") % 3,
    )
    return emb.select("vec_id", F.round(reward, 6).alias("reward"))

"""Queries over model outputs: scores, tokens, votes and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import numeric as N
from gridlake.operators import evaluation as E
from gridlake.plans.bounds import spread
from gridlake.queries.fixtures import LOGITS, PREDICTIONS, TOKENS, logits, predictions, tokens
from gridlake.queries.registry import query, table


def _rounded(df, *names):
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


LOSS_SQL = f"""{TOKENS},
peak as (select vec_id, pos, label, max(x) as top from token_scores group by all),
mass as (select t.vec_id, t.pos, sum(exp(x - top)) as z from token_scores t join peak p using (vec_id, pos) group by all),
losses as (
  select p.vec_id, p.pos, p.label, ln(z) - (x - top) as nll, exp(top - top) / z as conf
  from peak p join mass using (vec_id, pos)
  left join token_scores s on s.vec_id = p.vec_id and s.pos = p.pos and s.cls = p.label)"""

RANK_SQL = f"""{LOGITS},
ranks as (
  select a.vec_id, a.label, count(*) filter (b.x > a.x or (b.x = a.x and b.cls < a.cls)) as rank
  from scores a join scores b using (vec_id) where a.cls = a.label group by all)"""


@query(f"""with {RANK_SQL}
select round(avg((rank < 1)::int), 6) as top1, round(avg((rank < 5)::int), 6) as top5, count(*) as total from ranks""")
def topk_accuracy(spark, sf_dir):
    return _rounded(E.topk_accuracy(logits(spark, sf_dir)), "top1", "top5")


@query(f"""with {RANK_SQL}
select label, count(*) filter (rank < 1) as correct, count(*) as total, round(avg((rank < 1)::int), 6) as accuracy
from ranks group by label""")
def per_class_accuracy(spark, sf_dir):
    return _rounded(E.class_accuracy(logits(spark, sf_dir)), "accuracy")


@query(f"""with {RANK_SQL}, per as (
  select label, count(*) as n, count(*) filter (rank < 1) as t1, count(*) filter (rank < 5) as t5 from ranks group by label)
select round(sum(t1)::double / sum(n), 6) as top1, round(sum(t5)::double / sum(n), 6) as top5,
  round(avg(t1::double / n), 6) as mean_per_class from per""")
def vision_report(spark, sf_dir):
    return _rounded(E.vision_report(logits(spark, sf_dir)), "top1", "top5", "mean_per_class")


@query(f"""with {LOSS_SQL}
select round(avg(nll), 6) as loss, round(exp(avg(nll)), 6) as perplexity, count(nll) as n_tokens
from losses where label <> -100""")
def perplexity(spark, sf_dir):
    return _rounded(E.perplexity(tokens(spark, sf_dir)), "loss", "perplexity")


@query(f"""with {TOKENS},
s as (select vec_id, pos, label, cls, case when x < 0 then 1 / (1 - x + 1e-30::double) else x + 1 end as s from token_scores),
l as (select vec_id, pos, label, -ln(max(s) filter (cls = label) / sum(s)) as nll from s where label <> -100 group by all)
select vec_id, round(avg(nll), 6) as loss, round(exp(avg(nll)), 6) as perplexity, count(nll) as n_tokens from l group by vec_id""")
def perplexity_stablemax(spark, sf_dir):
    return _rounded(E.perplexity(tokens(spark, sf_dir), ["vec_id"], loss="stablemax"), "loss", "perplexity")


@query(f"""with {LOSS_SQL},
stream as (select vec_id * 54 + pos as spot, coalesce(nll, 0) as nll from losses),
n as (select count(*) as n from stream),
chunks as (select spot // 128 as k, avg(nll) as l from stream, n where (spot // 128) * 128 < n - 128 and spot % 128 > 0 group by 1)
select round(exp(avg(l)), 2) as perplexity, round(avg(l), 4) as avg_loss, count(*) as chunks from chunks""")
def chunked_perplexity(spark, sf_dir):
    toks = tokens(spark, sf_dir)
    nll = F.coalesce(N.cross_entropy(F.col("logits"), F.col("label")), F.lit(0.0))
    stream = toks.select((F.col("vec_id") * 54 + F.col("pos")).alias("at"), nll.alias("nll"))
    n_tokens = table(spark, sf_dir, "embeddings").count() * 54
    return E.chunked_perplexity(stream, "at", "nll", 128, n_tokens)


SEQUENCE_SQL = f"""{LOSS_SQL},
best as (select vec_id, pos, label, arg_max(cls, x * 1000 - cls * 1e-9::double) as pred from token_scores group by all),
conf as (select vec_id, pos, 1 / z as c from mass),
seqs as (
  select b.vec_id, count(*) filter (label <> -100) as n_scored, count(*) filter (label <> -100 and label = pred) as n_correct,
         sum(case when label <> -100 then c else 0 end) as s
  from best b join conf using (vec_id, pos) group by b.vec_id),
seq_metrics as (
  select *, n_correct::double / greatest(n_scored, 1) as accuracy, n_correct = n_scored as exact,
         s / greatest(n_scored, 1) as confidence from seqs)"""


@query(f"""with {SEQUENCE_SQL}
select vec_id, n_scored, n_correct, round(accuracy, 6) as accuracy, exact, round(confidence, 6) as confidence,
  confidence > 0.8 as confident from seq_metrics""")
def token_exact(spark, sf_dir):
    return _rounded(E.sequence_metrics(tokens(spark, sf_dir), "vec_id"), "accuracy", "confidence")


@query(f"""with {SEQUENCE_SQL},
h as (select s.*, vec_id % 4 <> 0 as halted, embedding[1]::double as q_halt, e.label + 1 as steps
      from seq_metrics s join embeddings e using (vec_id)),
v as (select *, halted and n_scored > 0 as valid from h)
select count(*) filter (valid) as count, round(sum(case when valid then accuracy else 0 end), 6) as accuracy,
  count(*) filter (valid and exact) as exact_accuracy, count(*) filter (valid and (q_halt >= 0) = exact) as q_halt_accuracy,
  sum(case when valid then steps else 0 end)::bigint as steps from v""")
def halting_report(spark, sf_dir):
    seqs = E.sequence_metrics(tokens(spark, sf_dir), "vec_id")
    extra = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("vec_id") % 4 != 0).alias("halted"),
        F.get("embedding", F.lit(0)).cast("double").alias("q_halt"),
        (F.col("label") + 1).alias("steps"),
    )
    return _rounded(E.halting_report(seqs.join(extra, "vec_id")), "accuracy")


@query(f"""with {TOKENS},
d as (select t.vec_id, t.pos, k, case when t.pos + k < 54 then n.label else -100 end as target
      from tokens t cross join (values (1), (2), (3)) h(k)
      left join tokens n on n.vec_id = t.vec_id and n.pos = t.pos + k)
select vec_id, k, string_agg(target::varchar, ',' order by pos) as targets from d group by all""")
def horizon_targets(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    labels = F.transform(
        F.sequence(F.lit(0), F.lit(53)),
        lambda p: F.when(p % 5 == 0, -100).otherwise((F.col("label") + p) % 10).cast("int"),
    )
    rows = emb.select("vec_id", labels.alias("labels"))
    forms = F.array(
        *[
            F.struct(F.lit(k).alias("k"), N.horizon_targets(F.col("labels"), k).alias("t"))
            for k in (1, 2, 3)
        ]
    )
    out = rows.select("vec_id", F.explode(forms).alias("s"))
    text = F.array_join(F.transform("s.t", lambda x: x.cast("string")), ",")
    return out.select("vec_id", "s.k", text.alias("targets"))


@query("""with per as (
  select l_partkey, count(*) as n, count(*) filter (l_returnflag = 'N') as c from lineitem group by l_partkey),
e as (
  select n, c, k, case when n < k then 0.0::double when c >= k then 1.0::double
    else 1 - coalesce(list_product([greatest((n - c - i)::double / (n - i), 0) for i in range(k)]), 1) end as p
  from per, (values (1), (5), (10)) t(k))
select round(avg(p) filter (k = 1), 6) as pass_at_1, round(avg(p) filter (k = 5), 6) as pass_at_5,
  round(avg(p) filter (k = 10), 6) as pass_at_10, count(*) // 3 as problems from e""")
def pass_at_k(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    report = E.pass_at_k_report(li, "l_partkey", F.col("l_returnflag") == "N")
    return _rounded(report, "pass_at_1", "pass_at_5", "pass_at_10")


@query("""with per as (
  select l_partkey, count(*) as n, count(*) filter (l_returnflag = 'N') as c from lineitem group by l_partkey),
e as (
  select k, case when n < k then 0.0::double
    else 1 - coalesce(list_product([greatest((n - c - i)::double / (n - i), 0) for i in range(k)]), 1) end as p
  from per, (values (1), (5)) t(k))
select round(avg(p) filter (k = 1), 6) as pass_at_1, round(avg(p) filter (k = 5), 6) as pass_at_5,
  count(*) // 2 as problems from e""")
def pass_at_k_unbiased(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    report = E.pass_at_k_report(li, "l_partkey", F.col("l_returnflag") == "N", (1, 5), unbiased=True)
    return _rounded(report, "pass_at_1", "pass_at_5")


# Puzzles come from the suppliers, so the last five names have no prediction at all.
VOTE_SQL = f"""{PREDICTIONS},
truth as (
  select distinct s_suppkey % 55 as name, i as input_hash, (s_suppkey % 55 + i) % 7 as label_hash
  from supplier, range(3) t(i)),
votes as (
  select name, input_hash, pred_hash, count(*) as votes, avg(q) as quality, min(seq) as first_seq
  from predictions group by all),
ranked as (
  select *, row_number() over (partition by name, input_hash order by votes desc, quality desc, first_seq) as rank from votes)"""


def vote_truth(spark, sf_dir):
    name = F.col("s_suppkey") % 55
    pairs = table(spark, sf_dir, "supplier").select(name.alias("name")).distinct()
    inputs = pairs.withColumn("input_hash", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")))
    return inputs.withColumn("label_hash", (F.col("name") + F.col("input_hash")) % 7)


@query(f"""with {VOTE_SQL},
hit as (select t.name, t.input_hash, r.rank from truth t left join ranked r
        on r.name = t.name and r.input_hash = t.input_hash and r.pred_hash = t.label_hash),
per as (
  select name, avg(coalesce(rank <= 1, false)::int) as p1, avg(coalesce(rank <= 2, false)::int) as p2,
    avg(coalesce(rank <= 5, false)::int) as p5, avg(coalesce(rank <= 10, false)::int) as p10,
    avg(coalesce(rank <= 100, false)::int) as p100, avg(coalesce(rank <= 1000, false)::int) as p1000
  from hit group by name)
select round(avg(p1), 6) as pass_at_1, round(avg(p2), 6) as pass_at_2, round(avg(p5), 6) as pass_at_5,
  round(avg(p10), 6) as pass_at_10, round(avg(p100), 6) as pass_at_100, round(avg(p1000), 6) as pass_at_1000,
  count(*) as puzzles from per""")
def vote_pass_k(spark, sf_dir):
    report = E.vote_pass_report(predictions(spark, sf_dir), vote_truth(spark, sf_dir))
    return _rounded(report, *[f"pass_at_{k}" for k in E.PASS_KS])


@query(f"""with {VOTE_SQL}
select t.name, t.input_hash, t.label_hash, r.rank from truth t left join ranked r
on r.name = t.name and r.input_hash = t.input_hash and r.pred_hash = t.label_hash""")
def vote_ranks(spark, sf_dir):
    return E.vote_ranks(predictions(spark, sf_dir), vote_truth(spark, sf_dir))


@query(f"""with {VOTE_SQL}, top as (select r.* from ranked r join truth t using (name, input_hash) where rank <= 2)
select name, input_hash, max(pred_hash) filter (rank = 1) as attempt_1,
  coalesce(max(pred_hash) filter (rank = 2), max(pred_hash) filter (rank = 1)) as attempt_2 from top group by all""")
def vote_submission(spark, sf_dir):
    return E.submission(predictions(spark, sf_dir), vote_truth(spark, sf_dir))


@query("""with m as (
  select vec_id, i, embedding[i + 1]::double / 2 as t, embedding[i + 11]::double / 2 as s from embeddings, range(10) x(i)),
z as (select vec_id, ln(sum(exp(t))) as zt, ln(sum(exp(s))) as zs from m group by vec_id),
per as (
  select vec_id, sum(exp(t - zt) * ((t - zt) - (s - zs))) as kl, avg((2 * t - 2 * s) * (2 * t - 2 * s)) as mse
  from m join z using (vec_id) group by vec_id)
select round(avg(kl) * 4, 6) as kl, round(avg(mse), 6) as logit_mse from per""")
def distillation_report(spark, sf_dir):
    emb = spread(table(spark, sf_dir, "embeddings"))
    pairs = emb.select(
        F.slice("embedding", 1, 10).alias("teacher"), F.slice("embedding", 11, 10).alias("student")
    )
    return _rounded(E.distillation_report(pairs), "kl", "logit_mse")


THINK_SQL = """
steps as (
  select l_orderkey as task, row_number() over (
      partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as step,
    case when l_quantity = 7 then 'nan'::double else l_extendedprice end as loss,
    l_discount * 10 as halt_prob, l_tax * 12 as q_max, l_quantity / 100 as q_std from lineitem),
good as (select *, coalesce(halt_prob > 0.95 or (q_max > 0.8 and q_std < 0.1), false) as done from steps where not isnan(loss)),
fin as (select task, min(step) filter (done) as fin from good group by task)"""


@query(f"""with {THINK_SQL}
select g.task, round(avg(loss), 6) as loss, round(avg(halt_prob), 6) as halt_prob, count(*) as thinking_steps,
  bool_or(fin is not null) as task_completed
from good g join fin using (task) where fin is null or step <= fin group by g.task""")
def thinking_report(spark, sf_dir):
    """Lines of an order as thinking steps; a quantity of 7 stands for a broken loss."""
    from gridlake.plans.ordered import with_position

    li = table(spark, sf_dir, "lineitem")
    numbered = with_position(
        li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"),
        ["l_orderkey"],
        ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
    )
    broken = F.when(F.col("l_quantity") == 7, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    steps = numbered.select(
        F.col("l_orderkey").alias("task"),
        F.col("pos").alias("step"),
        broken.alias("loss"),
        (F.col("l_discount") * 10).alias("halt_prob"),
        (F.col("l_tax") * 12).alias("q_max"),
        (F.col("l_quantity") / 100).alias("q_std"),
    )
    return _rounded(E.thinking_report(steps, "task", "step", ["loss", "halt_prob"]), "loss", "halt_prob")


def _grams(n: int) -> str:
    return f"""
p{n} as (select i, list_reduce(ws[k:k + {n - 1}], lambda a, b: a || ' ' || b) as g, count(*) as c
        from pw, unnest(range(1, len(ws) - {n - 1} + 1)) t(k) group by all),
r{n} as (select i, list_reduce(ws[k:k + {n - 1}], lambda a, b: a || ' ' || b) as g, count(*) as c
        from rw, unnest(range(1, len(ws) - {n - 1} + 1)) t(k) group by all),
s{n} as (select sum(p.c)::bigint as t, sum(least(p.c, coalesce(r.c, 0)))::bigint as m from p{n} p left join r{n} r using (i, g))"""


@query(rf"""with pairs as (
  select a.conv_id * 100 + a.turn as i, a.text as p, b.text as r from conversations a
  join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1),
pw as (select i, list_filter(string_split_regex(p, '\s+'), lambda x: x <> '') as ws from pairs),
rw as (select i, list_filter(string_split_regex(r, '\s+'), lambda x: x <> '') as ws from pairs),
{_grams(1)}, {_grams(2)}, {_grams(3)}, {_grams(4)},
l as (select (select sum(len(ws)) from pw) as lp, (select sum(len(ws)) from rw) as lr)
select s1.m as m1, s2.m as m2, s3.m as m3, s4.m as m4,
  round(case when s1.m * s2.m * s3.m * s4.m = 0 then 0 else
    (case when lp >= lr then 1 else exp(1 - lr / lp::double) end) *
    exp((ln(s1.m::double / s1.t) + ln(s2.m::double / s2.t) + ln(s3.m::double / s3.t) + ln(s4.m::double / s4.t)) / 4) end, 6) as bleu
from s1, s2, s3, s4, l""")
def caption_bleu(spark, sf_dir):
    """Each message scored against the one after it."""
    conv = spread(table(spark, sf_dir, "conversations"))
    after = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    pairs = conv.select("conv_id", "turn", F.col("text").alias("p")).join(after, ["conv_id", "turn"])
    return _rounded(E.bleu(pairs, ["conv_id", "turn"], "p", "r"), "bleu")


@query(f"""with {LOGITS},
e as (select vec_id, cls, x, exp(x - max(x) over (partition by vec_id)) as e from scores),
p as (select vec_id, cls, e / sum(e) over (partition by vec_id) as p from e),
c as (select *, sum(p) over (partition by vec_id order by p desc, cls rows between unbounded preceding and 1 preceding) as before from p),
k as (select * from c where coalesce(before, 0) <= 0.7)
select vec_id, cls::int as cls, round(p / sum(p) over (partition by vec_id), 6) as p from k""")
def top_p(spark, sf_dir):
    rows = logits(spark, sf_dir).select("vec_id", N.softmax(F.col("logits")).alias("ps"))
    kept = rows.select("vec_id", F.explode(N.nucleus(F.col("ps"), 0.7)).alias("s"))
    return kept.select("vec_id", "s.cls", F.round("s.p", 6).alias("p"))


@query(f"""with {LOGITS},
e as (select vec_id, cls, x, exp(x - max(x) over (partition by vec_id)) as e from scores),
p as (select vec_id, cls, e / sum(e) over (partition by vec_id) as p from e)
select vec_id, round(-sum(p * ln(p + 1e-8::double)), 6) as entropy, round(max(p), 6) as max_p,
  round(1 / (1 + exp(-max(x) filter (cls = 0))), 6) as sigmoid0
from p join scores using (vec_id, cls) group by vec_id""")
def softmax_entropy(spark, sf_dir):
    ps = N.softmax(F.col("logits"))
    return logits(spark, sf_dir).select(
        "vec_id",
        F.round(N.entropy(ps), 6).alias("entropy"),
        F.round(F.array_max(ps), 6).alias("max_p"),
        F.round(N.sigmoid(F.get("logits", F.lit(0))), 6).alias("sigmoid0"),
    )

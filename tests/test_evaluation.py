import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridlake.functions import numeric as N
from gridlake.operators import evaluation as E
from gridlake.operators import metrics as M
from gridlake.plans import registry


def scalar(spark, expr):
    return spark.range(1).select(expr).first()[0]


def array(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_softmax_family(spark):
    ps = scalar(spark, N.softmax(array(1000, 1001, 999)))
    assert abs(sum(ps) - 1) < 1e-12 and ps[1] == max(ps)
    logs = scalar(spark, N.stablemax_log(array(-1, 0, 3)))
    s = [0.5, 1.0, 4.0]
    assert all(abs(a - math.log(b / 5.5)) < 1e-12 for a, b in zip(logs, s))
    assert scalar(spark, N.cross_entropy(array(1, 2), F.lit(-100))) is None
    assert abs(scalar(spark, N.cross_entropy(array(0, 0), F.lit(1))) - math.log(2)) < 1e-12
    assert scalar(spark, N.argmax(array(1, 3, 3))) == 1


@pytest.mark.parametrize("n,c,k", [(5, 0, 1), (5, 2, 3), (10, 3, 5), (2, 1, 3), (4, 4, 4), (200, 7, 10), (6, 5, 3)])
def test_pass_at_k_equals_binomials(spark, n, c, k):
    plain = 0.0 if n < k else 1 - math.comb(n - c, k) / math.comb(n, k)
    shortcut = 0.0 if n < k else 1.0 if c >= k else plain
    assert abs(scalar(spark, N.pass_at_k(F.lit(n), F.lit(c), k, unbiased=True)) - plain) < 1e-12
    assert abs(scalar(spark, N.pass_at_k(F.lit(n), F.lit(c), k)) - shortcut) < 1e-12


def test_nucleus(spark):
    kept = scalar(spark, N.nucleus(array(0.1, 0.5, 0.25, 0.15), 0.6))
    assert [r.cls for r in kept] == [1, 2]
    assert abs(sum(r.p for r in kept) - 1) < 1e-12
    assert [r.cls for r in scalar(spark, N.nucleus(array(0.2, 0.8), 0.0))] == [1]


def test_horizon_targets(spark):
    labels = F.array(*[F.lit(x) for x in (1, 2, 3)])
    assert scalar(spark, N.horizon_targets(labels, 1)) == [2, 3, -100]
    assert scalar(spark, N.horizon_targets(labels, 5)) == [-100, -100, -100]


def vote_oracle(preds, truth, ks):
    tally = defaultdict(list)
    for name, inp, pred, q, seq in preds:
        tally[(name, inp)].append((pred, q, seq))
    per = defaultdict(list)
    for name, inp, label in truth:
        stats = defaultdict(list)
        for pred, q, seq in tally[(name, inp)]:
            stats[pred].append((q, seq))
        order = sorted(stats, key=lambda p: (-len(stats[p]), -sum(q for q, _ in stats[p]) / len(stats[p]), min(s for _, s in stats[p])))
        per[name].append([label in order[:k] for k in ks])
    return [sum(sum(h[i] for h in hits) / len(hits) for hits in per.values()) / len(per) for i in range(len(ks))]


def test_votes_equal_brute_force(spark):
    rng = random.Random(1)
    # one puzzle holds most of the votes, one has none at all
    preds = [(0 if rng.random() < 0.6 else rng.randrange(5), rng.randrange(2), rng.randrange(6), rng.choice([0.25, 0.5]), i) for i in range(400)]
    truth = [(n, i, rng.randrange(6)) for n in range(6) for i in range(2)]
    p = spark.createDataFrame(preds, "name long, input_hash long, pred_hash long, q double, seq long")
    t = spark.createDataFrame(truth, "name long, input_hash long, label_hash long")
    ks = (1, 2, 5)
    row = E.vote_pass_report(p, t, ks).first()
    assert [round(row[f"pass_at_{k}"], 9) for k in ks] == [round(x, 9) for x in vote_oracle(preds, truth, ks)]
    assert row["puzzles"] == 6
    sub = E.submission(p.where("pred_hash = 0"), t).collect()
    assert all(r.attempt_1 == r.attempt_2 == 0 for r in sub)


def test_empty_reports(spark):
    none = spark.createDataFrame([], "logits array<double>, label int")
    assert E.topk_accuracy(none).first()["top1"] == 0.0
    assert E.vision_report(none).first()["mean_per_class"] == 0.0
    ignored = spark.createDataFrame([([1.0, 2.0], -100)], "logits array<double>, label int")
    row = E.perplexity(ignored).first()
    assert row["perplexity"] == float("inf") and row["n_tokens"] == 0
    seq = E.sequence_metrics(ignored.withColumn("s", F.lit(1)), "s").first()
    assert seq["n_scored"] == 0 and seq["accuracy"] == 0


def test_topk_ties_and_order(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0], 1), ([1.0, 1.0, 0.0], 0), ([0.0, 0.0, 9.0], 2)], "logits array<double>, label int")
    row = E.topk_accuracy(df, (1, 2)).first()
    assert (round(row["top1"], 6), row["top2"]) == (round(2 / 3, 6), 1.0)


def test_bleu(spark):
    same = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "id int, p string, r string")
    assert abs(E.bleu(same, ["id"], "p", "r").first()["bleu"] - 1) < 1e-12
    off = spark.createDataFrame([(1, "x y", "a b")], "id int, p string, r string")
    assert E.bleu(off, ["id"], "p", "r").first()["bleu"] == 0.0
    clipped = spark.createDataFrame([(1, "the the the", "the cat")], "id int, p string, r string")
    assert E.bleu(clipped, ["id"], "p", "r", max_n=1).first()["m1"] == 1


def test_bleu_counts_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(E, "BLEU_CHARS", 200, raising=False)
    r = random.Random(3)
    rows = [(i % 50, *(" ".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in "pr")) for i in range(120)]
    rows += [(None, "a b", "a b"), (7, None, "a"), (8, "a", None)]
    asked = []
    real = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *cols: asked.append((n, cols)) or real(self, n, *cols))
    got = E.bleu(spark.createDataFrame(rows, "id int, p string, r string"), ["id"], "p", "r")
    shared = Counter()
    for n in range(1, 5):
        mine, other = Counter(), Counter()
        for i, p, ref in rows:
            for text, to in ((p, mine), (ref, other)):
                ws = (text or "").split()
                to.update((i, *ws[k : k + n]) for k in range(len(ws) - n + 1))
        shared[n] = sum((mine & other).values())
    assert [got.first()[f"m{n}"] for n in range(1, 5)] == [shared[n] for n in range(1, 5)]
    chars = sum(len(p or "") + len(ref or "") for _, p, ref in rows)
    assert asked and asked[0][0] >= chars / 200
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "gram" in x]


def test_chunked_perplexity_drops_the_last_part(spark):
    df = spark.range(10).select(F.col("id").alias("pos"), F.lit(1.0).alias("loss"))
    assert E.chunked_perplexity(df, "pos", "loss", 4, 10).first()["chunks"] == 2
    assert E.chunked_perplexity(df, "pos", "loss", 5, 10).first()["chunks"] == 1
    assert E.chunked_perplexity(df, "pos", "loss", 4, 10, max_chunks=1).first()["chunks"] == 1
    assert E.chunked_perplexity(df, "pos", "loss", 20, 10).first()["perplexity"] == float("inf")


def test_registry_checks_columns(spark):
    df = spark.createDataFrame([([1.0, 0.0], 0)], "logits array<double>, label int")
    assert registry.evaluate(df, "accuracy").first()["top1"] == 1.0
    with pytest.raises(ValueError, match="label"):
        registry.evaluate(df.drop("label"), "accuracy")
    with pytest.raises(KeyError):
        registry.evaluate(df, "unknown")


def test_nearest_rank_percentiles(spark):
    rng = random.Random(2)
    values = [round(rng.random() * 100, 3) for _ in range(101)]
    df = spark.createDataFrame([("a", v, i) for i, v in enumerate(values)] + [("b", 5.0, 999)], "k string, ms double, id int")
    rows = {r.k: r for r in M.latency_summary(df, ["k"], "ms", "id").collect()}
    s = sorted(values)
    assert rows["a"].p50 == round(s[101 // 2], 2) and rows["a"].p95 == round(s[int(101 * 0.95)], 2)
    assert rows["b"].p99 == 5.0


def test_running_statistics_equal_fold(spark):
    rng = random.Random(3)
    data = [("x", d, rng.gauss(1e4, 1)) for d in range(12) for _ in range(1 if d == 3 else 5)]
    df = spark.createDataFrame(data, "k string, day int, v double")
    out = M.running_statistics(M.batch_statistics(df, ["k"], "day", "v"), ["k"], "day").orderBy("day").collect()
    count, mean, var = 0, 0.0, 1.0
    for d, row in enumerate(out):
        xs = [v for _, day, v in data if day == d]
        m, n = sum(xs) / len(xs), len(xs)
        v = sum((x - m) ** 2 for x in xs) / (n - 1) if n > 1 else 0.0
        delta = m - mean
        m2 = var * count + v * n + delta**2 * count * n / (count + n)
        mean += delta * n / (count + n)
        var, count = m2 / (count + n), count + n
        assert row["count"] == count and abs(row["mean"] - mean) < 1e-6 and abs(row["var"] - var) < 1e-6


def test_ema_equals_loop(spark):
    values = [1.0, 5.0, 2.0, 8.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    x = values[0]
    for v in values[1:]:
        x = 0.9 * x + 0.1 * v
    assert abs(M.ema(df, ["k"], ["i"], "v", 0.9).first()["ema"] - x) < 1e-12
    y = 4.0
    for v in values:
        y = 0.9 * y + 0.1 * v
    assert abs(M.ema(df, ["k"], ["i"], "v", 0.9, start=4.0).first()["ema"] - y) < 1e-12


def test_metric_reduction(spark):
    rows = [("a", "count", 2.0), ("a", "acc", 3.0), ("b", "count", 0.0), ("b", "acc", 1.0)]
    df = spark.createDataFrame(rows, "set_name string, metric string, value double")
    got = {r.set_name: r.value for r in M.reduce_by_set(df).collect()}
    assert got == {"a": 1.5, "b": None}
    steps = df.withColumn("step", F.lit(1))
    assert {r.metric: r.value for r in M.reduce_training(steps, 8).collect()}["acc"] == 2.0


def test_diagnosis_flags(spark):
    layers = [(s, "l", 1e-7 if s < 3 else 500.0, 0.9 if s == 1 else 0.0) for s in range(14)]
    df = spark.createDataFrame(layers, "step int, name string, grad_norm double, dead_ratio double")
    got = {r.step: r.issues for r in M.diagnose(df).collect()}
    assert got[0] == ["vanishing_gradients"]
    assert got[1] == ["vanishing_gradients", "dead_neurons"]
    assert got[5] == ["exploding_gradients"]
    assert got[11] == ["exploding_gradients", "unstable_training"]
    assert got[13] == ["exploding_gradients"]


def test_component_rules(spark):
    names = ["H_level.q_head", "L_init", "x.q_head", "memory.embed", "embed", "lm_head", "other"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(M.component(F.col("n"))).collect()]
    assert got == ["H_level", "L_level", "q_head", "memory", "embed", "lm_head", None]

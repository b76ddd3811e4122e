"""Reduction of run metrics, telemetry health and running statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.operators.vectors import vector_sums
from gridlake.plans.ordered import bounded_window, drop_layout, prefix_sums, with_position


def reduce_by_set(metrics: DataFrame) -> DataFrame:
    """Sum of each metric of a set over the set's ``count``; ``count`` itself is dropped.

    ``metrics(set_name, metric, value)``.
    """
    sums = metrics.groupBy("set_name", "metric").agg(F.sum("value").alias("value"))
    counts = sums.where("metric = 'count'").select("set_name", F.col("value").alias("_count"))
    return (
        sums.where("metric <> 'count'")
        .join(counts, "set_name")
        .select("set_name", "metric", F.try_divide("value", "_count").alias("value"))
    )


def reduce_training(metrics: DataFrame, batch_size: int) -> DataFrame:
    """Per step: losses over the global batch size, other metrics over ``max(count, 1)``."""
    sums = metrics.groupBy("step", "metric").agg(F.sum("value").alias("value"))
    per_step = Window.partitionBy("step")
    # A step has a handful of metrics after the aggregation, so this window stays small.
    count = F.max(F.when(F.col("metric") == "count", F.col("value"))).over(per_step)
    divisor = F.when(F.endswith("metric", F.lit("loss")), F.lit(float(batch_size))).otherwise(
        F.greatest(F.coalesce(count, F.lit(0.0)), F.lit(1.0))
    )
    return sums.select("step", "metric", (F.col("value") / divisor).alias("value"))


def latency_summary(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """mean, min, max and nearest-rank p50, p95, p99 rounded to 2 digits.

    The percentile of q is the element ``floor(n q)`` of the sorted values.
    """
    ranked = with_position(df.select(*keys, value, tie), keys, [value, tie], "_pos")
    # Without keys a constant stands in, so that one join serves both cases.
    by = keys or ["_all"]
    every = [F.col(k) for k in keys] or [F.lit(0).alias("_all")]
    sizes = df.groupBy(*every).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    at = {"p50": F.floor(F.col("_n") / 2), "p95": F.floor(F.col("_n") * 0.95), "p99": F.floor(F.col("_n") * 0.99)}
    picks = [F.max(F.when(F.col("_pos") == index, F.col(value))).alias(name) for name, index in at.items()]
    joined = ranked.select(*every, value, "_pos").join(sizes, by)
    best = joined.groupBy(*by, "mean", "min", "max").agg(*picks)
    names = ["mean", "min", "max", "p50", "p95", "p99"]
    return best.select(*keys, *[F.round(n, 2).alias(n) for n in names])


# Component of a layer by the first matching substring of its name.
COMPONENTS = [
    ("H_level", ("H_level", "H_init")),
    ("L_level", ("L_level", "L_init")),
    ("q_head", ("q_head",)),
    ("memory", ("memory",)),
    ("embed", ("embed",)),
    ("lm_head", ("lm_head",)),
]


def component(name: Column) -> Column:
    """Component a layer belongs to, null for none."""
    out = None
    for label, parts in COMPONENTS:
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(name, F.lit(part))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def layer_statistics(gradients: DataFrame, keys: list[str], value: str, param: str) -> DataFrame:
    """Norm, mean, std, largest magnitude, dead share, sparsity and norm ratio per layer.

    ``gradients`` has one row per parameter value.
    """
    g, p = F.col(value), F.col(param)
    per = gradients.groupBy(*keys).agg(
        F.sqrt(F.sum(g * g)).alias("grad_norm"),
        F.avg(g).alias("grad_mean"),
        F.stddev_samp(g).alias("grad_std"),
        F.max(F.abs(g)).alias("grad_max"),
        F.avg((F.abs(g) < 1e-8).cast("int")).alias("dead_ratio"),
        F.avg((F.abs(g) < 1e-6).cast("int")).alias("sparsity"),
        F.sqrt(F.sum(p * p)).alias("param_norm"),
    )
    return per.withColumn("grad_to_param", F.col("grad_norm") / (F.col("param_norm") + 1e-8))


def telemetry_summary(layers: DataFrame) -> DataFrame:
    """Per step: mean, std (population), max and min of the norms, mean and max dead share."""
    return layers.groupBy("step").agg(
        F.avg("grad_norm").alias("norm_mean"),
        F.stddev_pop("grad_norm").alias("norm_std"),
        F.max("grad_norm").alias("norm_max"),
        F.min("grad_norm").alias("norm_min"),
        F.avg("dead_ratio").alias("dead_mean"),
        F.max("dead_ratio").alias("dead_max"),
    )


def component_summary(layers: DataFrame) -> DataFrame:
    """Mean and largest norm per step and component."""
    return (
        layers.withColumn("component", component(F.col("name")))
        .where(F.col("component").isNotNull())
        .groupBy("step", "component")
        .agg(F.avg("grad_norm").alias("norm_mean"), F.max("grad_norm").alias("norm_max"))
    )


def diagnose(layers: DataFrame, recent: int = 10) -> DataFrame:
    """Issues at every step, from that step and the spread of the last ``recent`` step means."""
    summary = telemetry_summary(layers)
    src, order, core = bounded_window(summary, [], ["step"], before=recent - 1, position="_at")
    last = order.rowsBetween(1 - recent, 0)
    spread = F.when(F.col("_at") >= recent, F.var_pop("norm_mean").over(last))
    flags = F.array_compact(
        F.array(
            F.when(F.col("norm_mean") < 1e-5, F.lit("vanishing_gradients")),
            F.when(F.col("norm_max") > 100, F.lit("exploding_gradients")),
            F.when(F.col("dead_mean") > 0.5, F.lit("dead_neurons")),
            F.when(F.col("_spread") > 100, F.lit("unstable_training")),
        )
    )
    return (
        drop_layout(src.withColumn("_spread", spread).where(core))
        .withColumn("_flags", flags)
        .withColumn(
            "issues",
            F.when(F.size("_flags") == 0, F.array(F.lit("healthy"))).otherwise(F.col("_flags")),
        )
        .drop("_spread", "_flags", "_at")
    )


def batch_statistics(df: DataFrame, keys: list[str], batch: str, value: str) -> DataFrame:
    """Size, mean and unbiased variance of every batch; the variance of one row is 0."""
    return df.groupBy(*keys, batch).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"),
    )


def running_statistics(batches: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """Count, mean and variance after each batch.

    Merging batch after batch has a closed form in prefix sums: with N rows so far the mean is
    sum(n m) / N and the variance is (sum(n v) + sum(n m^2)) / N - mean^2.  The means are taken
    relative to the key's overall mean, which keeps the last difference accurate.
    """
    mid = (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mid")
    d = F.col("mean") - F.col("_mid")
    if keys:
        joined = batches.join(batches.groupBy(*keys).agg(mid), keys)
    else:
        joined = batches.withColumn("_mid", batches.agg(mid).scalar())
    sums = prefix_sums(
        joined,
        keys,
        [batch],
        {"count": F.col("n"), "_s1": F.col("n") * d, "_s2": F.col("n") * (F.col("var") + d * d)},
    )
    shift = F.col("_s1") / F.col("count")
    return sums.select(
        *keys,
        batch,
        "count",
        (F.col("_mid") + shift).alias("mean"),
        (F.col("_s2") / F.col("count") - shift * shift).alias("var"),
    )


def ema(
    df: DataFrame, keys: list[str], order: list[str], value: str, mu: float, start: float | None = None
) -> DataFrame:
    """Last value of ``x <- mu x + (1 - mu) v`` per key, in order.

    The recurrence unrolls to a weighted sum over the dense position, so a plain aggregate computes
    it, with partial sums before the shuffle.  Without ``start`` the first value starts the average.
    """
    numbered = with_position(df, keys, order, "_pos")
    n = F.count(F.lit(1)).alias("_n")
    joined = numbered.join(df.groupBy(*keys).agg(n), keys) if keys else numbered.withColumn("_n", df.agg(n).scalar())
    decay = F.pow(F.lit(mu), F.col("_n") - 1 - F.col("_pos"))
    weight = F.lit(1 - mu)
    if start is None:
        weight = F.when(F.col("_pos") == 0, F.lit(1.0)).otherwise(weight)
    out = F.sum(weight * decay * F.col(value))
    if start is not None:
        out = out + F.pow(F.lit(mu), F.max("_n")) * start
    return joined.groupBy(*keys).agg(out.alias("ema"))


def action_distribution(df: DataFrame, keys: list[str], action: str) -> DataFrame:
    """Counts of continue (0), halt (1), expand (2) and the share of expand in percent."""
    a = F.col(action)
    return df.groupBy(*keys).agg(
        F.count_if(a == 0).alias("n_continue"),
        F.count_if(a == 1).alias("n_halt"),
        F.count_if(a == 2).alias("n_expand"),
        (F.count_if(a == 2) / F.count(a) * 100).alias("expand_pct"),
    )


def load_balance(df: DataFrame, worker: str, cost: str) -> DataFrame:
    """Spread of the workers' total cost over its mean; lower is better."""
    per = df.groupBy(worker).agg(F.sum(cost).alias("_t"))
    return per.agg((F.stddev_pop("_t") / (F.avg("_t") + 1e-6)).alias("load_balance"))


def keyed_vector_sum(df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """Element-wise sum of the vectors of each key, and its sign; null vectors are left out."""
    return vector_sums(df, key, vec, dim).select(key, "total", F.transform("total", F.signum).alias("sign"))

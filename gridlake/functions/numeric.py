"""Numeric functions over scalars and small arrays, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlake.functions.arrays import let
from gridlake.schemas import IGNORE_LABEL_ID


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def mean(xs: Column) -> Column:
    return F.try_divide(total(xs), F.size(xs))


def doubles(xs: Column) -> Column:
    return F.transform(xs, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine similarity; the product of the norms is kept away from zero."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def mse(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))))


def argmax(xs: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x.cast("double")))


def _shifted(xs: Column) -> Column:
    return let(F.array_max(xs), lambda top: F.transform(xs, lambda x: x.cast("double") - top))


def softmax(xs: Column) -> Column:
    def scaled(es: Column) -> Column:
        return let(total(es), lambda s: F.transform(es, lambda e: e / s))

    return let(F.transform(_shifted(xs), F.exp), scaled)


def log_softmax(xs: Column) -> Column:
    def scaled(zs: Column) -> Column:
        return let(F.ln(total(F.transform(zs, F.exp))), lambda s: F.transform(zs, lambda z: z - s))

    return let(_shifted(xs), scaled)


def stablemax_log(xs: Column) -> Column:
    """Log-probabilities of ``s(x) = x + 1`` for x >= 0 and ``1 / (1 - x + 1e-30)`` below."""
    def s(x: Column) -> Column:
        x = x.cast("double")
        return F.when(x < 0, 1 / (1 - x + F.lit(1e-30))).otherwise(x + 1)

    def scaled(ss: Column) -> Column:
        return let(total(ss), lambda t: F.transform(ss, lambda v: F.ln(v / t)))

    return let(F.transform(xs, s), scaled)


# Losses by name: log-probabilities of the classes.
LOG_PROBABILITY = {"softmax": log_softmax, "stablemax": stablemax_log}


def cross_entropy(
    logits: Column, label: Column, loss: str = "softmax", ignore: int = IGNORE_LABEL_ID
) -> Column:
    """Negative log-probability of the label; null for an ignored position."""
    picked = F.get(LOG_PROBABILITY[loss](logits), F.when(label != ignore, label))
    return -picked


def entropy(ps: Column) -> Column:
    return -total(F.transform(ps, lambda p: p * F.ln(p + F.lit(1e-8))))


def normalize(x: Column, mu: Column, var: Column, eps: float = 1e-8) -> Column:
    return (x - mu) / (F.sqrt(var) + F.lit(eps))


def denormalize(z: Column, mu: Column, var: Column, eps: float = 1e-8) -> Column:
    return z * (F.sqrt(var) + F.lit(eps)) + mu


def huber(error: Column, delta: float = 1.0) -> Column:
    a = F.abs(error)
    return F.when(a < delta, F.lit(0.5) * error * error / delta).otherwise(a - F.lit(0.5 * delta))


def pass_at_k(n: Column, c: Column, k: int, unbiased: bool = False) -> Column:
    """Chance that one of ``k`` draws out of ``n`` attempts with ``c`` passes is a pass.

    By default ``c >= k`` counts as 1; ``unbiased`` drops that shortcut.
    """
    # 1 - C(n-c, k) / C(n, k) as a product of k factors, so no large binomial appears.
    factors = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (n - c - i) / (n - i))
    product = F.aggregate(factors, F.lit(1.0), lambda acc, f: acc * F.greatest(f, F.lit(0.0)))
    out = F.when(n < k, F.lit(0.0))
    if not unbiased:
        out = out.when(c >= k, F.lit(1.0))
    return out.otherwise(1 - product)


def label_rank(logits: Column, label: Column) -> Column:
    """Number of classes ranked before the label; equal scores rank by class index."""
    def ahead(score: Column) -> Column:
        return F.size(
            F.filter(
                F.transform(logits, lambda x, i: (x > score) | ((x == score) & (i < label))), lambda b: b
            )
        )

    return let(F.get(logits, label), ahead)


def nucleus(probabilities: Column, p: float) -> Column:
    """Top-p truncation: ``(class, probability)`` in descending order, renormalised.

    An entry goes once the entries before it already hold more than ``p``.
    """
    ranked = F.reverse(
        F.array_sort(
            F.transform(probabilities, lambda x, i: F.struct(x.alias("p"), (-i).alias("neg")))
        )
    )
    start = F.struct(
        F.lit(0.0).alias("seen"), F.array().cast("array<struct<p:double,neg:int>>").alias("kept")
    )

    def step(acc: Column, s: Column) -> Column:
        keep = acc["seen"] <= p
        return F.struct(
            (acc["seen"] + s["p"]).alias("seen"),
            F.when(keep, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"),
        )

    kept = F.aggregate(ranked, start, step, lambda acc: acc["kept"])

    def rescale(ks: Column) -> Column:
        mass = total(F.transform(ks, lambda s: s["p"]))
        return let(
            mass,
            lambda m: F.transform(
                ks, lambda s: F.struct((-s["neg"]).alias("cls"), (s["p"] / m).alias("p"))
            ),
        )

    return let(kept, rescale)


def horizon_targets(labels: Column, depth: int, ignore: int = IGNORE_LABEL_ID) -> Column:
    """Labels ``depth`` positions ahead; the tail is ignored."""
    n = F.size(labels)
    tail = F.array_repeat(F.lit(ignore), F.least(F.lit(depth), n))
    return F.concat(F.slice(labels, F.lit(depth + 1), F.greatest(n - depth, F.lit(0))), tail)

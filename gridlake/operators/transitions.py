"""Transition tables: building, rewards, temporal-difference errors and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import numeric as N
from gridlake.operators import metrics as M
from gridlake.plans.ordered import (
    bounded_window,
    drop_layout,
    first_rows,
    hash_number,
    hash_order,
    last_rows,
    with_position,
)

STEP_PENALTY = 0.01  # fixed value
RECENT_WINDOW = 1000  # fixed value


def to_transitions(
    steps: DataFrame,
    keys: list[str],
    order: list[str],
    state: Column,
    penalty: float = STEP_PENALTY,
    correct: Column | None = None,
) -> DataFrame:
    """Ordered steps of each trajectory as ``step, state, next_state, done``.

    The last step is its own successor.  With ``correct`` the reward is minus the penalty before the
    end and +1 or -1 at the end.
    """
    src, window, core = bounded_window(
        steps.withColumn("state", state), keys, order, after=1, position="step"
    )
    following = F.lead("state").over(window)
    out = drop_layout(src.withColumn("_next", following).where(core))
    done = F.col("_next").isNull()
    out = out.withColumn("next_state", F.coalesce("_next", "state")).withColumn("done", done)
    if correct is not None:
        final = F.when(correct, F.lit(1.0)).otherwise(F.lit(-1.0))
        out = out.withColumn("reward", F.when(F.col("done"), final).otherwise(F.lit(-penalty)))
    return out.withColumn("step", F.col("step") + 1).drop("_next")


def improvement(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Difference to the previous row of the key; the first row is compared with 0."""
    src, window, core = bounded_window(df, keys, order, before=1)
    change = F.col(value) - F.coalesce(F.lag(value).over(window), F.lit(0.0))
    return drop_layout(src.withColumn(out, change).where(core))


def novelty_bonus(df: DataFrame, state_hash: str, seq: str, beta: float = 0.1) -> DataFrame:
    """``beta / (sqrt(n + 1) + 1e-8)`` with the earlier visits n of the same state."""
    seen = with_position(df, [state_hash], [seq], "n_before")
    bonus = F.lit(beta) / (F.sqrt(F.col("n_before") + 1) + F.lit(1e-8))
    return seen.withColumn("bonus", bonus)


def keep_informative(df: DataFrame, threshold: float, td: str = "td_error") -> DataFrame:
    """Selective storage: drop known errors below the threshold; a threshold of 0 keeps all."""
    if threshold <= 0:
        return df
    return df.where(F.col(td).isNull() | (F.abs(F.col(td)) >= threshold))


def drop_blank(df: DataFrame, identifier: str, blank: int) -> DataFrame:
    """Remove padding rows."""
    return df.where(F.col(identifier) != blank)


def drop_old(df: DataFrame, seq: str, max_age: int) -> DataFrame:
    """Remove rows more than ``max_age`` arrivals older than the newest."""
    return df.where(F.col(seq) >= df.agg(F.max(seq) - max_age).scalar())


def retain(df: DataFrame, capacity: int, seq: str = "seq") -> DataFrame:
    """Bounded buffer: the last ``capacity`` rows by arrival."""
    return last_rows(df, seq, capacity)


def _clamped(df: DataFrame, n: int) -> tuple[int, int]:
    size = df.count()
    if size == 0:
        raise ValueError("cannot sample from an empty table")
    return min(n, size), size


def sample_uniform(df: DataFrame, n: int, seed: int, seq: str = "seq") -> DataFrame:
    """``n`` distinct rows, all of them if there are fewer."""
    n, _ = _clamped(df, n)
    return first_rows(df, hash_order(F.col(seq), seed), n)


def sample_recent_mix(
    df: DataFrame, n: int, seed: int, seq: str = "seq", recent_fraction: float = 0.25
) -> DataFrame:
    """A share of the sample from the newest rows, the rest from the older ones.

    The newest are the last ``min(1000, size // 10)`` rows.
    """
    n, size = _clamped(df, n)
    window = min(RECENT_WINDOW, size // 10)
    n_recent = int(n * recent_fraction)
    order = hash_order(F.col(seq), seed)
    marked = F.lit(False)
    if window > 0:
        # The newest sequence numbers are a bounded list of at most 1000.
        newest = df.select(seq).orderBy(F.desc(seq)).limit(window)
        marked = F.col(seq) >= newest.agg(F.min(seq)).scalar()
    flagged = df.withColumn("recent", marked)
    recent = first_rows(flagged.where("recent"), order, min(n_recent, window))
    old = first_rows(flagged.where("not recent"), order, n - n_recent)
    return recent.unionByName(old)


def next_beta(beta: float, increment: float = 0.001) -> float:
    """Bias correction used by a draw; it grows before the draw and ends at 1."""
    return min(1.0, beta + increment)


def sample_prioritized(
    df: DataFrame,
    n: int,
    seed: int,
    seq: str = "seq",
    priority: str = "priority",
    alpha: float = 0.6,
    beta: float = 0.4,
) -> DataFrame:
    """``n`` distinct rows drawn with probability proportional to ``priority ** alpha``.

    Every row gets the key ``-ln(u) / weight`` from a hash of its number, and the smallest keys win:
    weighted sampling without replacement in one pass.  ``weight`` corrects the bias, scaled to a
    maximum of 1 in the sample.
    """
    n, size = _clamped(df, n)
    u = (hash_number(hash_order(F.col(seq), seed)) + 1) / F.lit(2.0**32 + 1)
    weighted = df.withColumn("_w", F.pow(priority, F.lit(alpha)))
    drawn = first_rows(weighted, [-F.ln(u) / F.col("_w"), F.col(seq)], n)
    mass = weighted.agg(F.sum("_w")).scalar()
    raw = F.pow(F.lit(float(size)) * F.col("_w") / mass, F.lit(-next_beta(beta)))
    # The largest correction belongs to the smallest weight that was drawn.
    rarest = drawn.agg(F.min("_w")).scalar()
    top = F.pow(F.lit(float(size)) * rarest / mass, F.lit(-next_beta(beta)))
    return drawn.withColumn("weight", raw / top).drop("_w")


def update_priorities(df: DataFrame, errors: DataFrame, key: str = "seq", floor: float = 1.0) -> DataFrame:
    """Priority ``abs(error) + 1e-6`` where an error is given; new rows get the largest so far.

    ``df.priority`` is null for rows that are new; ``errors(key, td_error)``.
    """
    fresh = errors.select(key, (F.abs("td_error") + F.lit(1e-6)).alias("_new"))
    tops = [df.agg(F.max("priority")).scalar(), fresh.agg(F.max("_new")).scalar()]
    joined = df.join(fresh, key, "left")
    top = F.greatest(*tops, F.lit(floor))
    return joined.withColumn("priority", F.coalesce(F.col("_new"), F.col("priority"), top)).drop("_new")


def td_target(reward: Column, next_value: Column, done: Column, gamma: float = 0.99) -> Column:
    return reward + F.lit(gamma) * next_value * (~done).cast("double")


def max_q(q_next: Column) -> Column:
    return F.array_max(q_next)


def double_q(q_online: Column, q_target: Column) -> Column:
    """Value, in the target table, of the action the online table prefers."""
    return F.get(q_target, N.argmax(q_online))


def td_error(q: Column, action: Column, target: Column) -> Column:
    return F.get(q, action) - target


# Fixed values of the shaped reward.
TERMINAL_CORRECT = 1.0
TERMINAL_INCORRECT = -0.5
MEMORY_BONUS = 0.5
EXPAND_BONUS = 0.1
EXPAND = 2


def shaped_reward(
    gain: Column,
    halted: Column,
    correct: Column,
    action: Column,
    intrinsic: Column | float = 0.0,
    with_memory: bool = False,
    penalty: float = STEP_PENALTY,
) -> Column:
    """Accuracy gain minus the step penalty plus terminal, memory, expansion and intrinsic terms."""
    terminal = F.when(halted, F.when(correct, TERMINAL_CORRECT).otherwise(TERMINAL_INCORRECT)).otherwise(0.0)
    memory = F.when(gain > 0, MEMORY_BONUS).otherwise(0.0) if with_memory else F.lit(0.0)
    expand = F.when((action == EXPAND) & (gain > 0), EXPAND_BONUS).otherwise(0.0)
    extra = intrinsic if isinstance(intrinsic, Column) else F.lit(intrinsic)
    return gain - F.lit(penalty) + terminal + memory + extra + expand


def normalise_rewards(df: DataFrame, batch: str, reward: str = "reward", warm_up: int = 100) -> DataFrame:
    """Rewards scaled by the running statistics that include their batch, after the warm-up."""
    running = M.running_statistics(M.batch_statistics(df, [], batch, reward), [], batch)
    joined = df.join(running, batch)
    scaled = N.normalize(F.col(reward), F.col("mean"), F.col("var"))
    out = F.when(F.col("count") > warm_up, scaled).otherwise(F.col(reward))
    return joined.withColumn("normalised", out).drop("count", "mean", "var")


def capsule_reward(
    gain: Column,
    n_expansions: Column,
    checksum_norm: Column,
    terminal: Column,
    correct: Column,
    n_concepts: Column | int = 0,
    children: int = 4,
) -> Column:
    """``10 gain - 0.01 e m + 0.005 c + 0.1 clamp(norm) + terminal``."""
    concepts = n_concepts if isinstance(n_concepts, Column) else F.lit(n_concepts)
    end = F.when(terminal, F.when(correct, TERMINAL_CORRECT).otherwise(TERMINAL_INCORRECT)).otherwise(0.0)
    clamped = F.least(F.greatest(checksum_norm, F.lit(0.0)), F.lit(1.0))
    return (
        F.lit(10.0) * gain
        - F.lit(0.01) * n_expansions * children
        + F.lit(0.005) * concepts
        + F.lit(0.1) * clamped
        + end
    )


def intrinsic_total(bonus: Column, errors: dict[str, float]) -> Column:
    """Novelty bonus plus weighted prediction-error columns; a missing error adds nothing."""
    out = bonus
    for name, weight in errors.items():
        out = out + F.coalesce(F.col(name) * F.lit(weight), F.lit(0.0))
    return out


def buffer_stats(
    df: DataFrame, capacity: int, threshold: float = 0.0, seq: str = "seq", reward: str = "reward", step: str = "step"
) -> DataFrame:
    """Size, utilisation, reward statistics and rejections of a bounded selective buffer."""
    stored = keep_informative(df, threshold)
    n = F.count(F.lit(1))
    held = retain(stored, capacity, seq).agg(
        F.count(F.lit(1)).alias("size"),
        F.coalesce(F.avg(reward), F.lit(0.0)).alias("mean_reward"),
        F.coalesce(F.stddev_pop(reward), F.lit(0.0)).alias("std_reward"),
        F.coalesce(F.avg(step), F.lit(0.0)).alias("mean_episode_length"),
    )
    row = held.withColumn("total_attempts", df.agg(n).scalar())
    rejected = F.col("total_attempts") - stored.agg(n).scalar()
    rate = F.col("rejected_count") / F.greatest("total_attempts", F.lit(1))
    return (
        row.withColumn("utilization", F.col("size") / capacity)
        .withColumn("rejected_count", rejected)
        .withColumn("rejection_rate", rate)
        .withColumn("memory_savings", F.format_string("%.1f%%", F.col("rejection_rate") * 100))
    )

"""Splits, epoch order, batch packing and sharding; every choice is read from a hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.plans.bounds import broadcast_if_small, cut_lineage
from gridlake.plans.ordered import hash_number, hash_order, join_by, rows_from, with_position


def train_split(df: DataFrame, key: str, ratio: float = 0.9, seed: int = 42) -> DataFrame:
    """``split`` is ``train`` for a share ``ratio`` of the keys, ``test`` for the others."""
    draw = hash_number(hash_order(F.col(key), seed))
    return df.withColumn("split", F.when(draw < int(ratio * 2**32), "train").otherwise("test"))


def epoch_order(df: DataFrame, keys: list[str], ids: list[str], seed: int, epoch: int, out: str = "rank") -> DataFrame:
    """Seeded shuffle: the position of each row of a key in the epoch's order."""
    mixed = df.withColumn("_h", hash_order(*[F.col(i) for i in ids], seed, epoch))
    return with_position(mixed, keys, ["_h"], out).drop("_h")


def stride_shards(df: DataFrame, rank: str, shards: int) -> DataFrame:
    """Strided sharding: ``shard`` and the position inside it."""
    n = F.lit(shards)
    return df.withColumn("shard", F.pmod(F.col(rank), n).cast("int")).withColumn(
        "shard_pos", F.floor(F.col(rank) / shards)
    )


def test_batches(df: DataFrame, keys: list[str], order: list[str], batch_size: int, shards: int = 1) -> DataFrame:
    """Batches in stored order inside each shard: ``shard, batch_id, pos``."""
    numbered = with_position(df, keys, order, "_rank")
    sharded = stride_shards(numbered, "_rank", shards)
    return (
        sharded.withColumn("batch_id", F.floor(F.col("shard_pos") / batch_size))
        .withColumn("pos", F.pmod("shard_pos", F.lit(batch_size)).cast("int"))
        .drop("_rank", "shard_pos")
    )


def numbered_batches(df: DataFrame, order: list[str], batch_size: int = 256, stored: DataFrame | None = None) -> DataFrame:
    """Fixed-size batches in arrival order, a total order; those in ``stored(batch_id)`` are left out.

    The order columns alone are numbered, and only rows of the batches asked for are moved.
    """
    numbered = with_position(df.select(*order), [], order, "_at")
    numbered = numbered.withColumn("batch_id", F.floor(F.col("_at") / batch_size)).drop("_at")
    if stored is not None:
        numbered = numbered.join(stored, "batch_id", "left_anti").select(*order, "batch_id")
    return join_by(df, numbered, order)


def skip_rows(df: DataFrame, order: list[str], n: int, take: int | None = None) -> DataFrame:
    """Resume after ``n`` rows of a total order, optionally with at most ``take`` rows."""
    return rows_from(df, order, n, None if take is None else n + take)


# --- distribution learning ----------------------------------------------------------------------


def task_key(metadata: Column) -> Column:
    """Task of a sample: ``task_id``, else ``puzzle_id``, else ``unknown``."""
    return F.coalesce(
        F.try_element_at(metadata, F.lit("task_id")),
        F.try_element_at(metadata, F.lit("puzzle_id")),
        F.lit("unknown"),
    )


def with_entry(metadata: Column, key: str, value: Column) -> Column:
    """Metadata with one entry set; the new value wins."""
    kept = F.map_filter(metadata, lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(F.lit(key), value))


def distribution_rows(
    df: DataFrame, task: str = "task", seq: str = "seq", grid: str = "grid", streaming: bool = True, head: int = 5
) -> DataFrame:
    """Samples that get a copy with the input as its own label.

    ``streaming``: every sample with a grid from the second of its task onward.  Otherwise: the first
    ``head`` samples of each task that has at least two.
    """
    if streaming:
        # Only the first sample per task is needed, a small aggregate even for a hot task.
        first = df.groupBy(task).agg(F.min(seq).alias("_first"))
        later = df.join(broadcast_if_small(first), task).where(F.col(seq) > F.col("_first"))
        return later.where(F.col(grid).isNotNull()).drop("_first")
    order = Window.partitionBy(task).orderBy(seq)
    heads = df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(head, 2))
    size = F.count(F.lit(1)).over(Window.partitionBy(task))
    kept = heads.withColumn("_n", size).where((F.col("_n") >= 2) & (F.col("_r") <= head))
    return kept.where(F.col(grid).isNotNull()).drop("_r", "_n")


# --- greedy packing -----------------------------------------------------------------------------

BLOCK_ITEMS = 20_000
FAN = 512

_BLOCK = "lane long, block long, ends array<int>, filled array<long>"
_START = "lane long, block long, start int, first_batch long"


def _run(sizes: np.ndarray, batch_size: int, start: int):
    """Batch and taken amount of each item, from a given fill level."""
    batch, fill = 0, start
    batches, takes = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        take = min(int(size), batch_size - fill)
        batches[i], takes[i] = batch, take
        fill += take
        if fill >= batch_size:
            batch, fill = batch + 1, 0
    return batches, takes


def _effect(sizes: np.ndarray, batch_size: int):
    """End level and number of filled batches for every start level at once."""
    fill, filled = np.arange(batch_size), np.zeros(batch_size, np.int64)
    for size in sizes:
        fill = fill + np.minimum(size, batch_size - fill)
        full = fill >= batch_size
        filled += full
        fill[full] = 0
    return fill, filled


def _chain(effects: pd.DataFrame):
    """Effect of consecutive blocks taken together."""
    ends = filled = None
    for e, f in zip(effects["ends"], effects["filled"]):
        e, f = np.asarray(e), np.asarray(f)
        if ends is None:
            ends, filled = e, f
        else:
            filled, ends = filled + f[ends], e[ends]
    return ends, filled


def _starts(effects: DataFrame, first: DataFrame | None, n_blocks: int, fan: int) -> DataFrame:
    """Start level and first batch of every block, by composing block effects ``fan`` at a time."""
    def walk(blocks: pd.DataFrame, start: int, batch: int) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        rows = []
        for block, e, f in zip(blocks["block"], blocks["ends"], blocks["filled"]):
            rows.append((block, start, batch))
            start, batch = int(e[start]), batch + int(f[start])
        out = pd.DataFrame(rows, columns=["block", "start", "first_batch"])
        out.insert(0, "lane", blocks["lane"].iloc[0])
        return out

    if n_blocks <= fan:
        return effects.groupBy("lane").applyInPandas(lambda b: walk(b, 0, 0), _START)
    grouped = effects.withColumn("_super", F.floor(F.col("block") / fan))

    def compose(blocks: pd.DataFrame) -> pd.DataFrame:
        ends, filled = _chain(blocks.sort_values("block"))
        return pd.DataFrame(
            {"lane": [blocks["lane"].iloc[0]], "block": [blocks["_super"].iloc[0]], "ends": [ends], "filled": [filled]}
        )

    supers = grouped.groupBy("lane", "_super").applyInPandas(compose, _BLOCK)
    above = _starts(supers, None, -(-n_blocks // fan), fan).withColumnRenamed("block", "_super")

    def descend(blocks: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty or start.empty:
            return pd.DataFrame({"lane": [], "block": [], "start": [], "first_batch": []})
        return walk(blocks, int(start["start"].iloc[0]), int(start["first_batch"].iloc[0]))

    return (
        grouped.groupBy("lane", "_super").cogroup(above.groupBy("lane", "_super")).applyInPandas(descend, _START)
    )


def pack_greedily(
    items: DataFrame, lane: str, pos: str, size: str, batch_size: int, block_items: int = BLOCK_ITEMS, fan: int = FAN
) -> DataFrame:
    """Fill batches in order: an item gives ``min(size, room)`` rows and its surplus is dropped.

    Adds ``batch_id`` and ``take`` per lane.  The fill level is a recurrence over the whole lane, yet
    a block of items is fully described by what it makes of each of the ``batch_size`` possible
    levels.  These effects are computed block by block, composed up and down a shallow tree, and then
    every block is replayed from its known start, so no lane has to fit one task.
    """
    blocked = items.withColumn("_block", F.floor(F.col(pos) / block_items)).withColumn(
        "_lane", F.col(lane).cast("long")
    )

    def effect(rows: pd.DataFrame) -> pd.DataFrame:
        ends, filled = _effect(rows.sort_values("_p")["_s"].to_numpy(), batch_size)
        return pd.DataFrame(
            {"lane": [rows["_lane"].iloc[0]], "block": [rows["_block"].iloc[0]], "ends": [ends], "filled": [filled]}
        )

    slim = blocked.select("_lane", "_block", F.col(pos).alias("_p"), F.col(size).cast("long").alias("_s"))
    n_blocks = (slim.agg(F.max("_block")).first()[0] or 0) + 1
    if n_blocks == 1:
        starts = slim.select(F.col("_lane").alias("lane"), F.col("_block").alias("block")).distinct()
        starts = starts.withColumn("start", F.lit(0)).withColumn("first_batch", F.lit(0).cast("long"))
    else:
        effects = slim.groupBy("_lane", "_block").applyInPandas(effect, _BLOCK)
        starts = _starts(effects, None, n_blocks, fan)

    def replay(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or start.empty:
            return pd.DataFrame({"_lane": [], "_p": [], "batch_id": [], "take": []})
        rows = rows.sort_values("_p")
        batches, takes = _run(rows["_s"].to_numpy(), batch_size, int(start["start"].iloc[0]))
        return pd.DataFrame(
            {"_lane": rows["_lane"], "_p": rows["_p"], "batch_id": batches + int(start["first_batch"].iloc[0]), "take": takes}
        )

    named = starts.select(F.col("lane").alias("_lane"), F.col("block").alias("_block"), "start", "first_batch")
    placed = (
        slim.groupBy("_lane", "_block")
        .cogroup(named.groupBy("_lane", "_block"))
        .applyInPandas(replay, "_lane long, _p long, batch_id long, take long")
    )
    return (
        blocked.join(placed, (blocked["_lane"] == placed["_lane"]) & (blocked[pos] == placed["_p"]))
        .drop("_lane", "_block", "_p")
    )


def epoch_batches(
    puzzles: DataFrame, batch_size: int, seed: int, epoch: int = 0, shards: int = 1, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """Training batches of an epoch: one random puzzle per group, groups shuffled and packed greedily.

    ``puzzles(set_name, group_id, puzzle_id, size)``; returns them with ``shard, batch_id, take``.
    """
    draw = hash_order(F.col("puzzle_id"), seed, epoch)
    # The smallest hash per group picks a puzzle; the minimum is taken before the shuffle too.
    picked = puzzles.groupBy("set_name", "group_id").agg(
        F.min(F.struct(draw.alias("h"), "puzzle_id", "size")).alias("p")
    ).select("set_name", "group_id", "p.puzzle_id", "p.size")
    # One short row per group is left of the puzzles; it is measured, ranked and numbered below.
    picked = cut_lineage(picked)
    ranked = epoch_order(picked, ["set_name"], ["group_id"], seed, epoch)
    sharded = stride_shards(ranked, "rank", shards)
    # A lane is one (set, shard); the sets are few and are numbered by name.
    sets = picked.select("set_name").distinct()
    number = F.row_number().over(Window.orderBy("set_name")) - 1
    lanes = sharded.join(broadcast_if_small(sets.withColumn("_set", number)), "set_name").withColumn(
        "lane", F.col("_set") * shards + F.col("shard")
    )
    # The order is read several times below: to count blocks, to compute their effects, to replay them.
    lanes = cut_lineage(lanes)
    packed = pack_greedily(lanes, "lane", "shard_pos", "size", batch_size, block_items)
    return packed.select("set_name", "shard", "batch_id", "shard_pos", "group_id", "puzzle_id", "size", "take")


def epoch_examples(
    batches: DataFrame, examples: DataFrame, batch_size: int, seed: int, epoch: int = 0
) -> DataFrame:
    """Examples of the packed puzzles: ``take`` of each in hash order, numbered inside their batch.

    ``examples(puzzle_id, example_id)``.
    """
    mixed = examples.withColumn("_h", hash_order(F.col("puzzle_id"), F.col("example_id"), seed, epoch))
    order = Window.partitionBy("puzzle_id").orderBy("_h")
    # No puzzle gives more than a batch, so the constant limit prunes before the shuffle.
    ranked = mixed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= batch_size)
    chosen = ranked.join(batches, "puzzle_id").where(F.col("_r") <= F.col("take"))
    inside = Window.partitionBy("set_name", "shard", "batch_id").orderBy("shard_pos", "_r")
    return chosen.withColumn("pos", F.row_number().over(inside) - 1).select(
        "set_name", "shard", "batch_id", "pos", "group_id", "puzzle_id", "example_id"
    )


def pad_batches(
    df: DataFrame, batch: list[str], batch_size: int, pads: dict[str, Column], ignore: int | None, label: str = "label"
) -> DataFrame:
    """Batches filled up to their size with pad rows; the stored ignore id becomes -100.

    ``pads`` gives the pad value of each column besides the batch keys and ``pos``.
    """
    shown = df
    if ignore is not None:
        shown = df.withColumn(label, F.when(F.col(label) == ignore, F.lit(-100)).otherwise(F.col(label)))
    counts = df.groupBy(*batch).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < batch_size)
    extra = counts.select(
        *batch, F.explode(F.sequence(F.col("_n").cast("int"), F.lit(batch_size - 1))).alias("pos")
    )
    for name, value in pads.items():
        extra = extra.withColumn(name, value)
    return shown.select(*batch, "pos", *pads).unionByName(extra.select(*batch, "pos", *pads))


# --- balanced shards ----------------------------------------------------------------------------


def balanced_shards(df: DataFrame, cost: str, tie: str, shards: int) -> DataFrame:
    """Shards of nearly equal total cost: ranks by falling cost dealt out in serpentine order."""
    by_cost = df.withColumn("_neg", -F.col(cost))
    ranked = with_position(by_cost, [], ["_neg", tie], "_rank")
    at = F.pmod("_rank", F.lit(shards))
    turn = F.pmod(F.floor(F.col("_rank") / shards), F.lit(2))
    shard = F.when(turn == 0, at).otherwise(F.lit(shards - 1) - at)
    return ranked.withColumn("shard", shard.cast("int")).drop("_neg", "_rank")


def merge_metadata(datasets: DataFrame) -> DataFrame:
    """Metadata of a union of datasets; raises when their shapes are not compatible.

    Counts add up and the mean puzzle size is weighted by the number of puzzles.
    """
    fixed = [
        "seq_len", "vocab_size", "pad_id", "ignore_label_id", "blank_identifier_id", "sets", "num_puzzle_identifiers",
    ]
    same = [F.count_distinct(F.to_json(F.struct(c))).alias(f"_d_{c}") for c in fixed]
    merged = datasets.agg(
        *same,
        *[F.first(c).alias(c) for c in fixed[:-1]],
        F.sum("num_puzzle_identifiers").alias("num_puzzle_identifiers"),
        F.sum("total_groups").alias("total_groups"),
        F.sum("total_puzzles").alias("total_puzzles"),
        F.sum(F.col("mean_puzzle_examples") * F.col("total_puzzles")).alias("_w"),
    )
    problem = F.lit(None).cast("string")
    for c in reversed(fixed):
        problem = F.when(F.col(f"_d_{c}") > 1, F.lit(f"datasets differ in {c}")).otherwise(problem)
    mean = F.when(F.col("total_puzzles") > 0, F.col("_w") / F.col("total_puzzles")).otherwise(0.0)
    checked = merged.withColumn("mean_puzzle_examples", mean).withColumn(
        "total_puzzles",
        F.when(problem.isNotNull(), F.raise_error(problem).cast("long")).otherwise(F.col("total_puzzles")),
    )
    return checked.select(
        "pad_id", "ignore_label_id", "blank_identifier_id", "vocab_size", "seq_len", "num_puzzle_identifiers",
        "total_groups", "mean_puzzle_examples", "total_puzzles", "sets",
    )

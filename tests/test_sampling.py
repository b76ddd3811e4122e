import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridlake.operators import sampling as S
from gridlake.operators import transitions as R


def pack_loop(sizes, batch):
    out, fill, k = [], 0, 0
    for s in sizes:
        take = min(s, batch - fill)
        out.append((k, take))
        fill += take
        if fill >= batch:
            fill, k = 0, k + 1
    return out


@pytest.mark.parametrize("block,fan", [(1000, 512), (7, 512), (3, 2), (1, 3)])
def test_packing_equals_loop(spark, block, fan):
    rng = random.Random(block)
    lanes = {
        0: [rng.randrange(1, 30) for _ in range(60)],
        1: [1] * 40,
        2: [100, 3, 16, 16, 5],
        3: [16] * 9,
    }
    data = [(lane, i, s) for lane, sizes in lanes.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(data, "lane long, pos long, size int")
    got = S.pack_greedily(df, "lane", "pos", "size", 16, block_items=block, fan=fan).collect()
    found = {(r.lane, r.pos): (r.batch_id, r.take) for r in got}
    assert len(got) == len(data)
    for lane, sizes in lanes.items():
        assert [found[(lane, i)] for i in range(len(sizes))] == pack_loop(sizes, 16)


def test_epoch_examples_fill_batches_without_repeats(spark):
    rng = random.Random(8)
    puzzles = [("s", p // 3, p, 200 if p == 0 else rng.randrange(1, 12)) for p in range(90)]
    df = spark.createDataFrame(puzzles, "set_name string, group_id long, puzzle_id long, size long")
    ex = df.select("puzzle_id", F.explode(F.sequence(F.lit(1).cast("long"), "size")).alias("example_id"))
    batches = S.epoch_batches(df, 32, seed=1, block_items=5)
    rows = S.epoch_examples(batches, ex, 32, seed=1).collect()
    seen = {(r.puzzle_id, r.example_id) for r in rows}
    assert len(seen) == len(rows)
    sizes = {}
    for r in rows:
        sizes.setdefault(r.batch_id, []).append(r.pos)
    for b, pos in sizes.items():
        assert sorted(pos) == list(range(len(pos))) and len(pos) <= 32
    assert all(len(p) == 32 for b, p in sizes.items() if b != max(sizes))
    again = S.epoch_examples(S.epoch_batches(df, 32, seed=1, block_items=50), ex, 32, seed=1).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    other = S.epoch_batches(df, 32, seed=1, epoch=1).select("puzzle_id").collect()
    assert {r[0] for r in other} != {r[0] for r in batches.select("puzzle_id").collect()}


def test_split_share(spark):
    df = S.train_split(spark.range(4000), "id")
    share = df.where("split = 'train'").count() / 4000
    assert 0.87 < share < 0.93


def test_padding(spark):
    df = spark.createDataFrame([(0, 0, 5, 3), (0, 1, 6, 9), (1, 0, 7, 3)], "b int, pos int, x int, label int")
    out = S.pad_batches(df, ["b"], 2, {"x": F.lit(0), "label": F.lit(-100)}, ignore=3)
    assert sorted(map(tuple, out.collect())) == [(0, 0, 5, -100), (0, 1, 6, 9), (1, 0, 7, -100), (1, 1, 0, -100)]


def test_metadata(spark):
    map_type = spark.createDataFrame([({"puzzle_id": "p"},), ({"task_id": "t", "puzzle_id": "p"},), ({},)], "m map<string,string>")
    assert [r[0] for r in map_type.select(S.task_key(F.col("m"))).collect()] == ["p", "t", "unknown"]
    merged = map_type.select(S.with_entry(F.col("m"), "task_id", F.lit("new"))).collect()
    assert [r[0]["task_id"] for r in merged] == ["new"] * 3


META = "pad_id int, ignore_label_id int, blank_identifier_id int, vocab_size int, seq_len int, num_puzzle_identifiers long, total_groups long, mean_puzzle_examples double, total_puzzles long, sets array<string>"


def test_metadata_merge(spark):
    rows = [(0, None, 0, 10, 5, 7, 2, 1.0, 10, ["all"]), (0, None, 0, 10, 5, 7, 3, 4.0, 30, ["all"])]
    row = S.merge_metadata(spark.createDataFrame(rows, META)).first()
    assert (row.total_groups, row.total_puzzles, row.mean_puzzle_examples, row.num_puzzle_identifiers) == (5, 40, 3.25, 14)
    empty = S.merge_metadata(spark.createDataFrame([(0, None, 0, 10, 5, 7, 0, 0.0, 0, ["all"])], META)).first()
    assert empty.mean_puzzle_examples == 0.0
    with pytest.raises(PySparkException, match="seq_len"):
        S.merge_metadata(spark.createDataFrame([rows[0], (0, None, 0, 10, 6, 7, 3, 4.0, 30, ["all"])], META)).collect()


def buffer(spark, n):
    return spark.range(n).select(F.col("id").alias("seq"), (F.col("id") % 7 + 1).cast("double").alias("priority"))


def test_samples_have_no_duplicates(spark):
    df = buffer(spark, 500)
    for out in (R.sample_uniform(df, 60, 1), R.sample_recent_mix(df, 60, 1), R.sample_prioritized(df, 60, 1)):
        seqs = [r.seq for r in out.collect()]
        assert len(seqs) == len(set(seqs)) == 60
    mix = R.sample_recent_mix(df, 60, 1).collect()
    assert sum(r.recent for r in mix) == 15 and all(r.seq >= 450 for r in mix if r.recent)
    assert max(r.weight for r in R.sample_prioritized(df, 60, 1).collect()) == 1.0


@pytest.mark.parametrize("top", [10, 10**6])
def test_large_samples_use_blocks(spark, small_tasks, monkeypatch, top):
    from gridlake.plans import ordered

    monkeypatch.setattr(ordered, "TOP_ROWS", top)
    df = buffer(spark, 90)
    got = [sorted(r.seq for r in f(df, 40, 3).collect()) for f in (R.sample_uniform, R.sample_prioritized)]
    monkeypatch.setattr(ordered, "TOP_ROWS", 10**6)
    want = [sorted(r.seq for r in f(df, 40, 3).collect()) for f in (R.sample_uniform, R.sample_prioritized)]
    assert got == want


def test_sample_edges(spark):
    assert R.sample_uniform(buffer(spark, 3), 10, 1).count() == 3
    few = R.sample_recent_mix(buffer(spark, 8), 8, 1).collect()
    assert not any(r.recent for r in few) and len(few) == 6
    with pytest.raises(ValueError):
        R.sample_uniform(buffer(spark, 0), 1, 1)


def test_prioritised_draws_follow_the_weights(spark):
    df = buffer(spark, 700)
    light = heavy = 0
    for seed in range(6):
        rows = R.sample_prioritized(df, 100, seed, alpha=1.0).collect()
        light += sum(r.priority == 1 for r in rows)
        heavy += sum(r.priority == 7 for r in rows)
    assert heavy > 3 * light


def test_transitions_end(spark):
    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 9.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {(r.k, r.step): (r.next_state, r.done, r.reward) for r in R.to_transitions(df, ["k"], ["t"], F.col("v"), correct=F.col("k") == "a").collect()}
    assert got == {("a", 1): (2.0, False, -0.01), ("a", 2): (2.0, True, 1.0), ("b", 1): (9.0, True, -1.0)}


def test_priorities_of_new_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "seq int, priority double")
    errors = spark.createDataFrame([(3, -5.0)], "seq int, td_error double")
    got = {r.seq: round(r.priority, 6) for r in R.update_priorities(df, errors).collect()}
    assert got == {1: 2.0, 2: 5.000001, 3: 5.000001}


def test_buffer_stats(spark):
    df = spark.createDataFrame([(i, float(i), i, 0.1 if i % 2 else None) for i in range(10)], "seq int, reward double, step int, td_error double")
    row = R.buffer_stats(df, 3, threshold=0.5).first()
    assert (row["size"], row["total_attempts"], row["rejected_count"], row["memory_savings"]) == (3, 10, 5, "50.0%")
    assert row["mean_reward"] == 6.0 and round(row["std_reward"], 6) == round((8 / 3) ** 0.5, 6)


def test_distribution_rows(spark):
    rows = [("a", 1, [[1]]), ("a", 2, None), ("a", 3, [[3]]), ("b", 4, [[4]])]
    df = spark.createDataFrame(rows, "task string, seq int, grid array<array<int>>")
    assert [r.seq for r in S.distribution_rows(df).collect()] == [3]
    assert sorted(r.seq for r in S.distribution_rows(df, streaming=False).collect()) == [1, 3]


def test_balanced_shards(spark):
    df = spark.range(100).select("id", (F.col("id") + 1).alias("cost"))
    sums = [r[0] for r in S.balanced_shards(df, "cost", "id", 4).groupBy("shard").agg(F.sum("cost")).select("sum(cost)").collect()]
    assert len(sums) == 4 and max(sums) - min(sums) <= 4

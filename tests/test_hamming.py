"""Exact nearest codes against all distances."""

import random

import pytest

from gridlake.operators import hamming as H

BANK = "key_id long, code array<int>, rank int, distance int"


def apart(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b))


def expected(queries, bank, k):
    out = set()
    for q, code in queries:
        if code is not None:
            near = sorted((apart(code, c), i) for i, c in bank if c is not None)[:k]
            out |= {(q, i, d, r + 1) for r, (d, i) in enumerate(near)}
    return out


def made(seed, n, m, size):
    """Random codes, clusters of few changed bits around some of them, and many copies of one."""
    r = random.Random(seed)
    centres = [[r.getrandbits(size) for _ in range(m)] for _ in range(6)]
    rows = []
    for i in range(n):
        code = list(r.choice(centres)) if i % 4 else [r.getrandbits(size) for _ in range(m)]
        for _ in range(r.randrange(7)):
            at = r.randrange(m)
            code[at] ^= 1 << r.randrange(size)
        rows.append((i, list(centres[0]) if i % 3 == 0 else code))
    return rows


@pytest.mark.parametrize("m, size, k, blocks", [(8, 16, 5, (512, 8192)), (4, 6, 12, (3, 50)), (1, 5, 3, (512, 8192))])
def test_nearest_codes_equal_all_distances(spark, monkeypatch, m, size, k, blocks):
    monkeypatch.setattr(H, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(H, "KEY_BLOCK", blocks[1])
    bank = [*made(1, 400, m, size), (900, None)]
    queries = [*made(2, 30, m, size), *bank[:10], (901, None)]
    keys = spark.createDataFrame([(*r, 1, 1) for r in bank], BANK).repartition(4)
    asked = spark.createDataFrame(queries, "query_id long, code array<int>")
    got = [tuple(r) for r in H.nearest_codes(asked, keys, size, k).collect()]
    want = [(q, *rest) for q, code in queries for _, *rest in sorted(expected([(q, code)], bank, k), key=lambda x: x[3])]
    assert sorted(got) == sorted(want)


def test_clusters_are_found_without_comparing_all(spark, monkeypatch):
    def never(*args):
        raise AssertionError("compared with all keys")

    monkeypatch.setattr(H, "compared", never)
    r = random.Random(4)
    centres = [[r.getrandbits(16) for _ in range(8)] for _ in range(40)]
    bank = [(40 * j + i, [x ^ (1 << j % 16 if n == j % 8 else 0) for n, x in enumerate(c)]) for i, c in enumerate(centres) for j in range(20)]
    keys = spark.createDataFrame(bank, "key_id long, code array<int>")
    asked = spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "query_id long, code array<int>")
    got = {tuple(x) for x in H.nearest_codes(asked, keys, 16, 10).collect()}
    assert got == expected(list(enumerate(centres)), bank, 10)


def test_few_keys_and_none(spark):
    keys = spark.createDataFrame([(2, [1, 2]), (1, [1, 2])], "key_id long, code array<int>")
    asked = spark.createDataFrame([(7, [1, 3])], "query_id long, code array<int>")
    assert sorted(tuple(r) for r in H.nearest_codes(asked, keys, 8, 5).collect()) == [(7, 1, 1, 1), (7, 2, 1, 2)]
    assert H.nearest_codes(asked, keys.limit(0), 8, 5).count() == 0
    assert H.nearest_codes(asked.limit(0), keys, 8, 5).count() == 0


def random_codes(n):
    r = random.Random(9)
    return [(i, [r.getrandbits(16) for _ in range(8)]) for i in range(n)], "key_id long, code array<int>"


def test_look_ups_cost_no_more_than_comparing(spark, monkeypatch):
    bank, schema = random_codes(600)
    looked = []

    def counted(codes, size, radius, made=H.looked_up):
        out = made(codes, size, radius)
        looked.append(out.count())
        return out

    monkeypatch.setattr(H, "looked_up", counted)
    keys = spark.createDataFrame(bank, schema)
    got = {tuple(x) for x in H.nearest_codes(keys.withColumnRenamed("key_id", "query_id"), keys, 16, 4).collect()}
    assert got == expected(bank, bank, 4)
    assert sum(looked) * H.LOOKUP_COST <= 600 * 600


def test_keys_with_a_common_sub_code_are_compared(spark, monkeypatch):
    monkeypatch.setattr(H, "FEW_MEETINGS", 0)
    monkeypatch.setattr(H, "probed", lambda *args: pytest.fail("made pairs of all codes"))
    bank, schema = random_codes(600)
    bank = [(i, [7, *c[1:]]) for i, c in bank]
    keys = spark.createDataFrame(bank, schema)
    got = {tuple(x) for x in H.nearest_codes(keys.withColumnRenamed("key_id", "query_id"), keys, 16, 4).collect()}
    assert got == expected(bank, bank, 4)


def test_values_looked_up_are_not_broadcast(spark):
    """10 000 codes make 9.6 million values at radius 2; Spark takes them for a table of a few hundred KB."""
    codes = spark.range(10_000).selectExpr("transform(sequence(0, 7), i -> cast((id * 7919 + i * 104729) % 65536 as int)) as query_code", "id as key_id").localCheckpoint()
    index = codes.selectExpr("key_id", "query_code as code", "posexplode(query_code) as (at, value)").localCheckpoint()
    plan = H.probed(H.looked_up(codes.select("query_code"), 16, 2), index)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_comparing_leaves_one_row_a_code(spark, monkeypatch):
    """What leaves the comparison doesn't grow with the blocks of keys, and pairs of blocks aren't shuffled."""
    monkeypatch.setattr(H, "QUERY_BLOCK", 70)
    monkeypatch.setattr(H, "KEY_BLOCK", 50)
    bank, schema = random_codes(600)
    keys = spark.createDataFrame(bank, schema)
    met = H.compared(keys.selectExpr("code as query_code").distinct(), keys, 600, 8, 16, 4)
    assert met.count() == 600
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan


def test_keys_of_several_tasks_and_ties(spark, monkeypatch):
    for name, most in (("KEYS_AT_ONCE", 150), ("KEY_BLOCK", 40), ("QUERY_BLOCK", 33), ("TILE", 400), ("LOOKUP_COST", 10**9)):
        monkeypatch.setattr(H, name, most)
    r = random.Random(5)
    bank = [(r.getrandbits(62) - 2**61, [r.getrandbits(3), r.getrandbits(3)]) for _ in range(600)]
    keys = spark.createDataFrame(bank, "key_id long, code array<int>").repartition(5)
    asked = [(i, [a, b]) for i, (a, b) in enumerate((a, b) for a in range(8) for b in range(8))]
    got = {tuple(x) for x in H.nearest_codes(spark.createDataFrame(asked, "query_id long, code array<int>"), keys, 3, 7).collect()}
    assert got == expected(asked, bank, 7)


def test_look_ups_move_few_rows_per_code_and_key(spark, monkeypatch):
    monkeypatch.setattr(H, "LOOKUP_COST", 1)
    monkeypatch.setattr(H, "FEW_MEETINGS", 0)
    bank, schema = random_codes(600)
    looked = []

    def counted(codes, size, radius, made=H.looked_up):
        out = made(codes, size, radius)
        looked.append(out.count())
        return out

    monkeypatch.setattr(H, "looked_up", counted)
    keys = spark.createDataFrame(bank, schema)
    got = {tuple(x) for x in H.nearest_codes(keys.withColumnRenamed("key_id", "query_id"), keys, 16, 4).collect()}
    assert got == expected(bank, bank, 4)
    assert looked and max(looked) <= 16 * 1200

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.functions import grid as G
from gridlake.operators import expand as E
from gridlake.operators import quality as Q

SHAPES = [(1, 1), (1, 5), (4, 1), (2, 3), (3, 2), (30, 30)]


def random_grids(seed=1):
    rng = np.random.default_rng(seed)
    shapes = SHAPES + [tuple(rng.integers(1, 9, 2)) for _ in range(30)]
    return [rng.integers(0, rng.integers(1, 4), s).tolist() for s in shapes]


@pytest.fixture(scope="module")
def grids(spark):
    rows = [(i, g) for i, g in enumerate(random_grids())]
    return spark.createDataFrame(rows, "id long, grid array<array<int>>").persist()


def collect(df, *cols):
    return {r[0]: r[1:] if len(cols) > 1 else r[1] for r in df.select("id", *cols).collect()}


NUMPY = {
    0: lambda a: a,
    1: lambda a: np.rot90(a, 1),
    2: lambda a: np.rot90(a, 2),
    3: lambda a: np.rot90(a, 3),
    4: np.fliplr,
    5: np.flipud,
    6: lambda a: a.T,
    7: lambda a: np.fliplr(np.rot90(a, 1)),
}


@pytest.mark.parametrize("tid", range(8))
def test_dihedral_equals_numpy_and_inverts(grids, tid):
    moved = collect(grids, G.dihedral(F.col("grid"), tid))
    by_column = collect(grids.withColumn("t", F.lit(tid)), G.dihedral(F.col("grid"), F.col("t")))
    back = collect(grids, G.inverse_dihedral(G.dihedral(F.col("grid"), tid), tid))
    for i, g in enumerate(random_grids()):
        want = NUMPY[tid](np.array(g)).tolist()
        assert moved[i] == want and by_column[i] == want and back[i] == g


def test_dihedral_forms_are_closed(grids):
    """Two transforms in a row equal one of the eight."""
    eight = [G.to_text(G.dihedral(F.col("grid"), t)) for t in range(8)]
    for a in range(8):
        for b in (1, 4, 6):
            both = G.to_text(G.dihedral(G.dihedral(F.col("grid"), a), b))
            assert grids.where(~F.array_contains(F.array(*eight), both)).count() == 0


def test_unknown_transform_is_identity(grids):
    assert grids.where(G.dihedral(F.col("grid"), F.lit(9)) != F.col("grid")).count() == 0


def test_hash_knows_the_shape(spark):
    rows = spark.createDataFrame([(0, [[1, 2, 3], [4, 5, 6]]), (1, [[1, 2], [3, 4], [5, 6]])], "id long, grid array<array<int>>")
    assert len(set(collect(rows, G.grid_hash(F.col("grid"))).values())) == 2


def test_scaling_round_trip(grids):
    g = F.col("grid")
    assert grids.where(G.downscale(G.upscale(g, 3), 3) != g).count() == 0
    assert grids.where(G.height(G.vupscale(g, 2)) != 2 * G.height(g)).count() == 0


def test_halves_skip_the_middle(spark):
    rows = spark.createDataFrame([(0, [[1], [2], [3]])], "id long, grid array<array<int>>")
    g = F.col("grid")
    top, bottom = collect(rows, G.tophalf(g), G.bottomhalf(g))[0]
    assert (top, bottom) == ([[1]], [[3]])


def test_colours_and_ties(spark):
    rows = spark.createDataFrame([(0, [[3, 1], [1, 3]]), (1, [[2]])], "id long, grid array<array<int>>")
    g = F.col("grid")
    got = collect(rows, G.mostcolor(g), G.leastcolor(g), G.palette(g))
    assert tuple(got[0]) == (1, 1, [1, 3]) and tuple(got[1]) == (2, 2, [2])


def test_valid_rect_equals_loop(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(40):
        x = rng.integers(2, 12, (30, 30))
        x[rng.random((30, 30)) < 0.03 * (i % 5)] = 0
        data.append((i, x.tolist()))
    rows = spark.createDataFrame(data, "id long, grid array<array<int>>")
    got = collect(rows, G.valid_rect(F.col("grid")))
    for i, x in data:
        a, best, width = np.array(x), (0, 0), 30
        for r in range(1, 31):
            bad = [c for c in range(width) if not 2 <= a[r - 1, c] <= 11]
            width = min([width, *bad])
            if r * width > best[0] * best[1]:
                best = (r, width)
        want = (a[: best[0], : best[1]] - 2).tolist()
        assert got[i] == want


def test_validity(spark):
    cases = [([[1]], True), ([[1, 2], [3]], False), ([[10]], False), ([[-1]], False), ([], False), ([[]], False), ([[0] * 31], False)]
    rows = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(cases)], "id long, grid array<array<int>>")
    got = collect(rows, G.is_valid(F.col("grid")))
    assert [got[i] for i in range(len(cases))] == [ok for _, ok in cases]


def test_difficulty_of_extremes(spark):
    rows = spark.createDataFrame(
        [(0, [[1]], [[1]]), (1, [[1, 2], [3, 4]], [[2, 1], [4, 3]])], "id long, a array<array<int>>, b array<array<int>>"
    )
    got = collect(rows.withColumn("s", G.difficulty(F.col("a"), F.col("b"))), "s.transformation", "s.pattern")
    assert tuple(got[0]) == (0.0, 0.0)
    assert tuple(round(x, 6) for x in got[1]) == (0.7, 1.0)


def test_text_round_trip(grids):
    assert grids.where(G.from_text(G.to_text(F.col("grid"))) != F.col("grid")).count() == 0
    cells = G.explode_cells(grids)
    back = G.collect_cells(cells, ["id"]).withColumnRenamed("grid", "again")
    assert grids.join(back, "id").where(F.col("grid") != F.col("again")).count() == 0


def test_periods_and_compress(spark):
    rows = spark.createDataFrame(
        [(0, [[1, 2, 1, 2], [3, 4, 3, 4]]), (1, [[1, 1], [1, 1]]), (2, [[1, 2, 3]])], "id long, grid array<array<int>>"
    )
    g = F.col("grid")
    got = collect(rows, G.hperiod(g), G.vperiod(g))
    assert {k: tuple(v) for k, v in got.items()} == {0: (2, 2), 1: (1, 1), 2: (3, 1)}
    one = spark.createDataFrame([(0, [[0, 0, 0], [1, 0, 2], [0, 0, 1]])], "id long, grid array<array<int>>")
    assert collect(one, G.compress(g))[0] == [[1, 2], [0, 1]]


def test_rule_verification(spark):
    rows = spark.createDataFrame(
        [("a", 1, [[1, 2]], [[2, 1]]), ("a", 2, [[1, 2]], [[2, 1]]), ("a", 3, [[3, 4]], [[3, 4]]), ("b", 4, [[5, 5]], [[5, 5]])],
        "task string, seq long, input array<array<int>>, output array<array<int>>",
    )
    report = {r.task: (r.n, r.n_ok, r.solved) for r in Q.verify_rule(rows, G.vmirror, ["task"]).collect()}
    assert report == {"a": (3, 2, False), "b": (1, 1, True)}
    kept = Q.verified_examples(rows, G.vmirror, ["task"], "seq").collect()
    assert [r.seq for r in kept] == [1]
    funnel = {r.task: tuple(r)[1:] for r in Q.verification_funnel(rows, G.vmirror, ["task"], "seq").collect()}
    assert funnel == {"a": (3, 3, 2, 2, 1), "b": (1, 1, 1, 0, 0)}
    capped = Q.verified_examples(rows, lambda g: F.reverse(F.transform(g, F.reverse)), ["task"], "seq", cap=1)
    assert capped.groupBy("task").count().where("count > 1").count() == 0


def test_table_functions_equal_the_column_form(spark):
    """Lateral calls in SQL and DataFrames give the rows of ``augment_dihedral``; equal forms of a sample fold."""
    grids = [("a", [[1, 2], [3, 4]]), ("b", [[1, 1], [1, 1]]), ("c", [[1, 2, 3]]), ("d_aug", [[0]]), ("e", None)]
    df = spark.createDataFrame(grids, "sample_id string, grid array<array<int>>")
    plain = lambda x: sorted((r.sample_id, str(r.grid)) for r in x.where("sample_id not like 'e%'").collect())
    want = plain(Q.augment_dihedral(df))
    assert plain(E.augment_samples(df)) == want and len(want) == 32
    assert E.augment_samples(df).where("sample_id like 'e%' and grid is null").count() == 8
    E.register(spark)
    df.createOrReplaceTempView("_samples")
    assert plain(spark.sql("select f.* from _samples s, lateral augment_sample(s.sample_id, s.grid) f")) == want
    forms = E.augment_samples(df).withColumn("source_id", F.substring("sample_id", 1, 1))
    counts = E.distinct_forms(forms).groupBy(F.substring("sample_id", 1, 1).alias("s")).count().collect()
    assert {r["s"]: r["count"] for r in counts} == {"a": 8, "b": 1, "c": 4, "d": 1, "e": 1}
    forms.createOrReplaceTempView("_forms")
    sql = "select * from distinct_forms(table(select source_id, sample_id, tid, grid from _forms) partition by source_id order by tid)"
    assert spark.sql(sql).count() == 15
    assert E.augment_samples(df.limit(0)).count() == 0

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators import vectors as V


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(120, 6)).round(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    return vecs, spark.createDataFrame(rows, "id long, vec array<double>").repartition(4).persist()


@pytest.mark.parametrize("max_values", [10**6, 12])
def test_assignment_equals_brute_force(spark, data, max_values):
    vecs, df = data
    book = spark.createDataFrame([(i, [float(x) for x in vecs[i * 7]]) for i in range(9)], "concept_id long, vec array<double>")
    got = V.assign_codebook(df, book, "id", "vec", 6, max_values=max_values, group_rows=25).collect()
    centres = vecs[[i * 7 for i in range(9)]]
    want = ((vecs[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert len(got) == 120
    assert {r.id: r.concept_id for r in got} == dict(enumerate(want.tolist()))


def test_equal_centres_go_to_the_smaller_id(spark, data):
    vecs, df = data
    same = [float(x) for x in vecs[0]]
    book = spark.createDataFrame([(5, same), (2, same)], "concept_id long, vec array<double>")
    for cap in (10**6, 6):
        assert {r.concept_id for r in V.assign_codebook(df, book, "id", "vec", 6, max_values=cap).collect()} == {2}


def test_lsh_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    # a third of the keys and queries share one code
    codes = [3 if i % 3 == 0 else int(rng.integers(0, 16)) for i in range(90)]
    q = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "query_id long, code long")
    b = spark.createDataFrame([(i, c) for i, c in enumerate(codes[::-1])], "key_id long, code long")
    got = {}
    for r in V.lsh_topk(q, b, 4, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.key_id)
    for i, c in enumerate(codes):
        want = sorted((bin(c ^ k).count("1"), j) for j, k in enumerate(codes[::-1]))[:5]
        assert [got[i][r] for r in range(1, 6)] == want


def test_attention_read_equals_numpy(spark):
    rng = np.random.default_rng(2)
    keys = rng.normal(size=(20, 4))
    code = lambda v: int(sum((v[i] > 0) << i for i in range(3)))
    rows = [(i, code(k), [float(x) for x in k]) for i, k in enumerate(keys)]
    q = spark.createDataFrame(rows, "query_id long, code long, vec array<double>")
    b = q.select(F.col("query_id").alias("key_id"), "code", F.col("vec").alias("key_vec"), F.col("vec").alias("value_vec"))
    got = {r.query_id: r.output for r in V.attention_read(q, b, 3, 4, 4).collect()}
    for i, c, v in rows:
        near = sorted((bin(c ^ d).count("1"), j) for j, d, _ in rows)[:4]
        m = keys[[j for _, j in near]]
        s = m @ np.array(v) / 2.0
        w = np.exp(s - s.max())
        assert np.allclose(got[i], (w / w.sum()) @ m)


def test_long_codes_are_refused(spark):
    df = spark.createDataFrame([(1, 1)], "query_id long, code long")
    with pytest.raises(ValueError):
        V.lsh_topk(df, df.withColumnRenamed("query_id", "key_id"), 20)


def test_usage(spark):
    book = spark.range(4).select(F.col("id").alias("concept_id"))
    assigned = spark.createDataFrame([(0,), (0,), (1,)], "concept_id long")
    usage = V.codebook_usage(assigned, book)
    row = V.usage_report(usage).first()
    assert (row.active_codes, row.dead_codes, row.utilization, row.max_usage) == (2, 2, 0.5, 2)
    even = spark.range(4).select(F.col("id").alias("concept_id"), F.lit(3).alias("n"))
    assert abs(V.codebook_perplexity(even).first()[0] - 4) < 1e-6


def test_reset_leaves_active_codes_alone(spark):
    rows = [(0, 10.0, [1.0, 1.0], [0.1, 0.1]), (1, 0.0, [0.0, 0.0], [0.0, 0.0]), (2, 8.0, [2.0, 2.0], [0.25, 0.25])]
    state = spark.createDataFrame(rows, "concept_id long, size double, total array<double>, vec array<double>")
    out = {r.concept_id: r for r in V.reset_dead_codes(state, 2).collect()}
    assert len(out) == 3 and out[1].dead and not out[0].dead
    assert out[0].vec == [0.1, 0.1] and out[1].size == pytest.approx(0.6)
    assert out[1].vec != [0.0, 0.0] and out[1].total == out[1].vec


def test_expand_capsule(spark):
    s = F.array(*[F.array(F.lit(float(i))) for i in range(4)])
    c = F.array(*[F.array(*[F.array(F.lit(10.0 * i + m)) for m in range(2)]) for i in range(4)])
    got = spark.range(4).select("id", V.expand_capsule(s, c, F.col("id").cast("int")).alias("o")).collect()
    want = {0: [0, 1, 1, 2], 1: [0, 10, 11, 2], 2: [0, 1, 20, 21], 3: [0, 1, 2, 30]}
    assert {r.id: [int(x[0]) for x in r.o] for r in got} == want
    single = F.array(*[F.array(F.array(F.lit(9.0))) for _ in range(4)])
    kept = spark.range(1).select(V.expand_capsule(s, single, F.lit(2))).first()[0]
    assert [x[0] for x in kept] == [0, 1, 9, 3]
    none = F.array(*[F.array().cast("array<array<double>>") for _ in range(4)])
    padded = spark.range(1).select(V.expand_capsule(s, none, F.lit(0))).first()[0]
    assert [x[0] for x in padded] == [1, 2, 3, 0]


def test_quantised_storage(spark, data):
    _, df = data
    rows = df.select("vec", V.quantise(F.col("vec")).alias("p")).select("vec", "p", V.dequantise(F.col("p")).alias("back")).collect()
    for r in rows:
        assert np.abs(np.array(r.vec) - np.array(r.back)).max() <= r.p.scale * 0.5001
    zero = spark.range(1).select(V.quantise(F.array(F.lit(0.0))).alias("p")).first()[0]
    assert zero.q == [0]


def test_phrases(spark):
    assigned = spark.createDataFrame([(1, 0, 7), (1, 1, 7), (2, 0, 7), (2, 1, 8)], "sample_id long, k int, concept_id long")
    texts = spark.createDataFrame([(1, "b x y a"), (2, "y a c d")], "sample_id long, text string")
    first = {r.concept_id: r.phrase for r in V.representative_phrases(assigned, texts, 2).collect()}
    assert first == {7: "b x", 8: "c d"}
    common = {r.concept_id: r.phrase for r in V.representative_phrases(assigned, texts, 2, most_common=True).collect()}
    assert common[7] == "y a"


def test_kmeans_repeats_and_settles(spark, data):
    """Same result however the rows lie, and every concept is the rounded mean of the vectors nearest to it."""
    vecs, df = data
    runs = []
    for parts in (1, 7):
        assigned, book = V.kmeans_concepts(df.repartition(parts), "id", "vec", 6, k=5, max_iter=50)
        runs.append(({r.id: r.concept_id for r in assigned.collect()}, {r.concept_id: r.vec for r in book.collect()}))
    assert runs[0] == runs[1]
    found, book = runs[0]
    grains = np.floor(vecs * V.GRAIN)
    centres = np.array([book[i] for i in range(5)]) * V.GRAIN
    want = ((grains[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert found == dict(enumerate(want.tolist()))
    for i in range(5):
        mine = grains[want == i]
        assert (centres[i] == np.floor((2 * mine.sum(0) + len(mine)) / (2 * len(mine)))).all()


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(8, 4)) * 20
    # One group holds a third of the rows.
    group = [0 if i % 3 == 0 else i % 8 for i in range(400)]
    rows = [(i, [float(x) for x in middles[g] + rng.normal(size=4) * 0.1]) for i, g in enumerate(group)]
    assigned, _ = V.kmeans_concepts(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec", 4, k=8)
    pairs = {(group[r.id], r.concept_id) for r in assigned.collect()}
    assert len(pairs) == 8 == len({c for _, c in pairs})


def test_kmeans_of_few_vectors(spark):
    schema = "id long, vec array<double>"
    same = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(6)] + [(9, None)], schema)
    assigned, book = V.kmeans_concepts(same, "id", "vec", 2, k=4)
    assert book.count() == 2 and assigned.count() == 6
    assert len({(r.id % 2, r.concept_id) for r in assigned.collect()}) == 2
    assigned, book = V.kmeans_concepts(spark.createDataFrame([], schema), "id", "vec", 2, k=4)
    assert assigned.count() == 0 and book.count() == 0


@pytest.mark.parametrize("max_values", [10**7, 3000])
def test_vector_sums(spark, max_values):
    """1024 dimensions, a hot key, a null key; every task sends one row a key, or flushes when it holds too many."""
    rng = np.random.default_rng(4)
    vecs = rng.integers(-50, 50, size=(90, 1024))
    keys = [None if i % 10 == 0 else "hot" if i % 3 == 0 else f"k{i % 7}" for i in range(90)]
    rows = [(k, [float(x) for x in v]) for k, v in zip(keys, vecs)] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, vec array<float>").repartition(5)
    got = {r.k: (r.n, r.total) for r in V.vector_sums(df, "k", "vec", 1024, max_values).collect()}
    assert set(got) == set(keys)
    for k in set(keys):
        mine = vecs[[x == k for x in keys]]
        assert got[k] == (len(mine), mine.sum(0).tolist())


def test_memory_policy(spark):
    df = spark.createDataFrame([(i, 0.4 if i % 2 else 0.9) for i in range(10)], "seq long, reward double")
    kept = V.write_memory(df, 3)
    assert sorted(r.seq for r in kept.collect()) == [4, 6, 8]
    reads = spark.createDataFrame([(8,), (8,), (5,)], "seq long")
    row = V.memory_report(kept, reads, 4).first()
    assert (row.total_accesses, row.active_slots, row.utilization) == (2, 1, 0.25)

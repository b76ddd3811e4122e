"""Vector analytics: codebooks, hashing, retrieval and capsules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.functions import numeric as N
from gridlake.functions import text as X
from gridlake.functions.arrays import let, upto
from gridlake.plans.bounds import broadcast_if_small, cut_lineage
from gridlake.plans.ordered import hash_number, hash_order, last_rows

CAPTURED_VALUES = 8_000_000  # numbers a task may hold as a codebook: 64 MB in double precision
ASSIGNED = T.StructType(
    [T.StructField("concept_id", T.LongType()), T.StructField("distance", T.DoubleType())]
)


# --- codebooks ----------------------------------------------------------------------------------


def _nearest(vectors: np.ndarray, ids: np.ndarray, centres: np.ndarray):
    """First nearest centre of each vector and its squared distance."""
    d = (vectors**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * vectors @ centres.T
    best = d.argmin(1)
    return ids[best], d[np.arange(len(vectors)), best]


def assign_codebook(
    df: DataFrame,
    codebook: DataFrame,
    key: str,
    vec: str,
    dim: int,
    max_values: int = CAPTURED_VALUES,
    group_rows: int = 50_000,
) -> DataFrame:
    """Nearest centre of every vector, the smaller id on a tie: adds ``concept_id, distance``.

    ``codebook(concept_id, vec)``.  A codebook within ``max_values`` numbers travels with the tasks
    and nothing is shuffled.  A larger one is cut into blocks; each vector meets every block once and
    the partial minima are aggregated.
    """
    fits = max(1, max_values // dim)
    rows = codebook.limit(fits + 1).collect()
    if len(rows) <= fits:
        rows.sort(key=lambda r: r["concept_id"])
        ids = np.array([r["concept_id"] for r in rows], dtype=np.int64)
        centres = np.array([r["vec"] for r in rows], dtype=np.float64)

        @F.pandas_udf(ASSIGNED)
        def nearest(vectors: pd.Series) -> pd.DataFrame:
            if len(vectors) == 0:
                return pd.DataFrame({"concept_id": [], "distance": []})
            found, distance = _nearest(np.stack(vectors.to_numpy()).astype(np.float64), ids, centres)
            return pd.DataFrame({"concept_id": found, "distance": distance})

        scored = df.withColumn("_a", nearest(F.col(vec)))
        return scored.withColumn("concept_id", F.col("_a.concept_id")).withColumn("distance", F.col("_a.distance")).drop("_a")
    blocks = -(-codebook.count() // fits)
    groups = max(1, -(-df.count() // group_rows))
    left = df.select(
        key,
        F.col(vec).alias("_v"),
        F.pmod(F.xxhash64(key), F.lit(groups)).alias("_g"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"),
    )
    right = codebook.select(
        "concept_id",
        F.col("vec").alias("_c"),
        F.pmod(F.xxhash64("concept_id"), F.lit(blocks)).cast("int").alias("_b"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")).alias("_g"),
    )

    def block(vectors: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or centres.empty:
            return pd.DataFrame({key: [], "concept_id": [], "distance": []})
        centres = centres.sort_values("concept_id")
        found, distance = _nearest(
            np.stack(vectors["_v"].to_numpy()).astype(np.float64),
            centres["concept_id"].to_numpy(),
            np.stack(centres["_c"].to_numpy()).astype(np.float64),
        )
        return pd.DataFrame({key: vectors[key].to_numpy(), "concept_id": found, "distance": distance})

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *ASSIGNED.fields])
    partial = left.groupBy("_b", "_g").cogroup(right.groupBy("_b", "_g")).applyInPandas(block, schema)
    best = partial.groupBy(key).agg(F.min(F.struct("distance", "concept_id")).alias("_m"))
    return df.join(
        best.select(key, F.col("_m.concept_id").alias("concept_id"), F.col("_m.distance").alias("distance")), key
    )


def codebook_usage(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    """Rows per concept, with zero for unused ones."""
    counts = assigned.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
    return codebook.select("concept_id").join(counts, "concept_id", "left").fillna(0, ["n"])


def usage_report(usage: DataFrame, value: str = "n") -> DataFrame:
    """Active and dead codes, utilisation and spread of the usage; dead is under 1% of the mean."""
    u = F.col(value)
    joined = usage.withColumn("_mean", usage.agg(F.avg(value)).scalar())
    limit = F.col("_mean") * F.lit(0.01)
    return joined.agg(
        F.count_if(u > limit).alias("active_codes"),
        F.count_if(u < limit).alias("dead_codes"),
        F.avg((u > 0).cast("int")).alias("utilization"),
        F.max(u).alias("max_usage"),
        F.avg(u).alias("mean_usage"),
        F.min(u).alias("min_usage"),
        F.stddev_samp(u).alias("std_usage"),
    )


def normalised_usage(usage: DataFrame, value: str = "n") -> DataFrame:
    """Share of each concept in the whole usage."""
    return usage.withColumn("share", F.try_divide(F.col(value), usage.agg(F.sum(value)).scalar()))


def codebook_perplexity(usage: DataFrame, value: str = "n") -> DataFrame:
    """``exp(-sum p ln(p + 1e-10))`` over the concepts."""
    p = F.col("share")
    return normalised_usage(usage, value).agg(F.exp(-F.sum(p * F.ln(p + F.lit(1e-10)))).alias("perplexity"))


def vector_sums(df: DataFrame, key: str, vec: str, dim: int, max_values: int = CAPTURED_VALUES) -> DataFrame:
    """(key, n, total): number and sum of the vectors of each key, of any dimension; null vectors are left out.

    Every task adds up what it reads of a key before anything is shuffled, and the totals then meet by
    key and dimension, so a hot key is spread over ``dim`` groups.  A task holds at most ``max_values`` numbers.
    """
    whole = df.where(F.col(vec).isNotNull()).select(key, vec)
    schema = T.StructType([df.schema[key], T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))])
    most = max(1, max_values // dim)

    def flushed(sums: dict) -> pd.DataFrame:
        return pd.DataFrame({key: list(sums), "n": [n for n, _ in sums.values()], "total": [t for _, t in sums.values()]}).astype({key: object})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            codes, keys = pd.factorize(batch[key].astype(object).where(batch[key].notna(), None), use_na_sentinel=False)
            order = np.argsort(codes, kind="stable")
            counts = np.bincount(codes, minlength=len(keys))
            totals = np.add.reduceat(np.stack(batch[vec].to_numpy())[order].astype(np.float64), np.cumsum(counts) - counts)
            for k, n, t in zip(keys, counts.tolist(), totals):
                before = sums.get(k, (0, 0.0))
                sums[k] = (before[0] + n, before[1] + t)
            if len(sums) > most:
                yield flushed(sums)
                sums = {}
        if sums:
            yield flushed(sums)

    parts = whole.mapInPandas(add, schema).select(key, "n", F.posexplode("total").alias("_at", "_x"))
    cells = parts.groupBy(key, "_at").agg(F.sum("n").alias("n"), F.sum("_x").alias("_x"))
    by_key = cells.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_c"))
    return by_key.select(key, "n", F.transform("_c", lambda c: c["_x"]).alias("total"))


def update_codebook(
    state: DataFrame, assigned: DataFrame, vec: str, dim: int, decay: float = 0.99
) -> DataFrame:
    """Moving-average codebook step with smoothed cluster sizes.

    ``state(concept_id, size, total)`` holds the averages so far.  Counts and sums come from
    ``vector_sums``, so the shuffle carries one row per task, concept and dimension.
    """
    batch = vector_sums(assigned, "concept_id", vec, dim).select("concept_id", F.col("n").alias("_n"), F.col("total").alias("_sum"))
    joined = state.join(batch, "concept_id", "left")
    keep, add = F.lit(decay), F.lit(1 - decay)
    moved = joined.select(
        "concept_id",
        (keep * F.col("size") + add * F.coalesce("_n", F.lit(0))).alias("_size"),
        F.when(F.col("_sum").isNull(), F.transform("total", lambda t: keep * t))
        .otherwise(F.zip_with("total", "_sum", lambda t, s: keep * t + add * s))
        .alias("total"),
    )
    eps = F.lit(1e-5)
    whole = moved.agg(F.struct(F.sum("_size").alias("all"), F.count(F.lit(1)).alias("k")).alias("w"))
    smooth = (F.col("_size") + eps) / (F.col("_w.all") + F.col("_w.k") * eps) * F.col("_w.all")
    return (
        moved.withColumn("_w", whole.scalar())
        .withColumn("size", smooth)
        .withColumn("vec", F.transform("total", lambda t: t / F.col("size")))
        .select("concept_id", "size", "total", "vec")
    )


def _gauss(*parts: Column | str | int) -> Column:
    """Standard normal number from the hash of its parts."""
    digest = hash_order(*parts)
    u1 = (hash_number(digest) + 1) / F.lit(2.0**32 + 1)
    u2 = hash_number(digest, 9) / F.lit(2.0**32)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * np.pi) * u2)


def reset_dead_codes(state: DataFrame, dim: int, min_usage: float = 0.01, seed: int = 42) -> DataFrame:
    """Replace codes under ``min_usage`` of the mean size by a noisy copy of an active one.

    ``state(concept_id, size, total, vec)``.  The copy's source and the noise (0.1 standard normal)
    are read from hashes; a reset code starts with a tenth of the mean size.
    """
    # The state is read several times below, and it is small next to the vectors behind it.
    state = cut_lineage(state)
    flagged = state.withColumn("_mean", state.agg(F.avg("size")).scalar()).withColumn(
        "dead", F.col("size") < F.col("_mean") * F.lit(min_usage)
    )
    # The codebook is the bounded side of every assignment, so ranking its codes fits one task.
    rank = F.row_number().over(Window.orderBy("concept_id")) - 1
    active = flagged.where("not dead").withColumn("_at", rank).select("_at", F.col("vec").alias("_src"))
    n_active = active.agg(F.count(F.lit(1))).scalar()
    pick = F.pmod(hash_number(hash_order(F.col("concept_id"), seed)), n_active)
    dead = flagged.where("dead").withColumn("_at", pick).join(active, "_at")
    noise = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: _gauss(F.col("concept_id"), i, seed) * F.lit(0.1)
    )
    fresh = F.zip_with("_src", noise, lambda v, e: v + e)
    reborn = dead.withColumn("vec", fresh).select(
        "concept_id", (F.col("_mean") * F.lit(0.1)).alias("size"), F.col("vec").alias("total"), "vec", "dead"
    )
    alive = flagged.join(dead.select("concept_id"), "concept_id", "left_anti")
    return alive.select("concept_id", "size", "total", "vec", "dead").unionByName(reborn)


def commitment_loss(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mean squared difference over all vectors and dimensions."""
    return pairs.agg(F.avg(N.mse(F.col(a), F.col(b))).alias("commitment"))


def lookup(requests: DataFrame, codebook: DataFrame, concept: str = "concept_id") -> DataFrame:
    """Vectors of the requested concepts; each request keeps its own position column."""
    book = codebook.select(F.col("concept_id").alias(concept), F.col("vec").alias("looked_up"))
    return requests.join(broadcast_if_small(book), concept)


GRAIN = 1 << 16  # steps per unit that k-means reads a component in, so its sums are whole numbers


def _seed_candidates(data: DataFrame, dim: int, k: int, rounds: int, seed: int) -> DataFrame:
    """(concept_id, vec, weight): about 2 k vectors a round, drawn far from those drawn before.

    A vector is drawn by a hash of its key, with a chance in proportion to its squared distance to the nearest
    candidate (k-means||); its weight is the number of vectors nearest to it.
    """
    draw = lambda r: hash_number(hash_order(F.col("concept_id"), seed, r))
    book = cut_lineage(data.orderBy(draw(0), "concept_id").limit(1))
    for r in range(1, rounds + 1):
        far = assign_codebook(data.withColumnRenamed("concept_id", "_id"), book, "_id", "vec", dim).select(F.col("_id").alias("concept_id"), "vec", "distance")
        far = cut_lineage(far)
        cost = float(far.agg(F.sum("distance")).first()[0] or 0.0)
        drawn = far.where(draw(r).cast("double") * F.lit(cost) < F.lit(2.0 * k * 2.0**32) * F.col("distance"))
        book = cut_lineage(book.unionByName(drawn.select("concept_id", "vec")))
    near = assign_codebook(data.withColumnRenamed("concept_id", "_id"), book, "_id", "vec", dim)
    return book.join(near.groupBy("concept_id").agg(F.count("*").alias("weight")), "concept_id")


def _spread_out(candidates: DataFrame, k: int) -> list[list[float]]:
    """The heaviest candidate, then the one with the most weight times squared distance to those taken, k in all.

    Ties go to the smaller id.  There are some 2 k candidates a round, however many vectors there are.
    """
    rows = sorted(candidates.collect(), key=lambda r: r["concept_id"])
    vectors = np.array([r["vec"] for r in rows], np.float64)
    weight = np.array([r["weight"] for r in rows], np.float64)
    taken, gap = [], np.ones(len(rows))
    while len(taken) < k and (weight * gap).max(initial=0.0) > 0:
        best = int((weight * gap).argmax())
        distance = ((vectors - vectors[best]) ** 2).sum(1)
        gap = np.minimum(gap, distance) if taken else distance
        taken.append(best)
    return [vectors[i].tolist() for i in taken]


def kmeans_concepts(df: DataFrame, key: str, vec: str, dim: int, k: int = 2048, seed: int = 42, max_iter: int = 20, rounds: int = 3):
    """Cluster vectors into concepts: ``(assigned, codebook)``; runs repeat exactly.

    Components are read in steps of 1 / ``GRAIN`` and centres are rounded to them, so sums and distances
    are whole numbers that doubles hold exactly, in whatever order tasks add them (components up to 64
    at 1024 dimensions).  Starts are read from hashes; ties go to the smaller concept, and a concept that loses
    all vectors keeps its centre.  ``key`` is unique.  Null vectors take no part; with fewer different vectors
    than ``k`` there are fewer concepts.
    """
    grains = F.transform(vec, lambda x: F.floor(x.cast("double") * GRAIN).cast("double"))
    data = cut_lineage(df.where(F.col(vec).isNotNull()).select(F.col(key).alias("concept_id"), grains.alias("vec")))
    centres = _spread_out(_seed_candidates(data, dim, k, rounds, seed), k)
    spark = df.sparkSession
    points = data.withColumnRenamed("concept_id", "_id")
    book = lambda rows, unit: spark.createDataFrame([(i, [x / unit for x in c]) for i, c in enumerate(rows)], "concept_id long, vec array<double>")
    for _ in range(max_iter if centres else 0):
        near = assign_codebook(points, book(centres, 1), "_id", "vec", dim)
        middle = F.transform("total", lambda t: F.floor((2 * t + F.col("n")) / (2 * F.col("n"))).cast("double"))
        # One row per concept, which the codebook of every assignment holds anyway.
        moved = {r["concept_id"]: list(r["vec"]) for r in vector_sums(near, "concept_id", "vec", dim).select("concept_id", middle.alias("vec")).collect()}
        after = [moved.get(i, c) for i, c in enumerate(centres)]
        if after == centres:
            break
        centres = after
    assigned = assign_codebook(points, book(centres, 1), "_id", "vec", dim) if centres else points.withColumn("concept_id", F.lit(None).cast("long"))
    return assigned.select(F.col("_id").alias(key), "concept_id"), book(centres, GRAIN)


def representative_phrases(
    assigned: DataFrame, texts: DataFrame, slices: int, most_common: bool = False
) -> DataFrame:
    """Phrase of each concept: the word slice of its first capsule, or its most common one.

    ``assigned(sample_id, k, concept_id)`` and ``texts(sample_id, text)``.
    """
    used = texts.join(assigned.select("sample_id").distinct(), "sample_id", "left_semi")
    parts = used.select("sample_id", F.posexplode(X.even_slices(F.col("text"), slices)).alias("k", "phrase"))
    joined = assigned.join(parts, ["sample_id", "k"])
    if most_common:
        counted = joined.groupBy("concept_id", "phrase").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("sample_id", "k")).alias("first")
        )
        best = F.max_by("phrase", F.struct("n", F.expr("-first.sample_id"), F.expr("-first.k")))
        return counted.groupBy("concept_id").agg(best.alias("phrase"))
    return joined.groupBy("concept_id").agg(F.min_by("phrase", F.struct("sample_id", "k")).alias("phrase"))


# --- hashing and retrieval ----------------------------------------------------------------------


def sign_projection(dim: int, bits: int) -> np.ndarray:
    """Fixed projection of +1 and -1 entries."""
    d, h = np.meshgrid(np.arange(dim), np.arange(bits), indexing="ij")
    return np.where((d * 7919 + h * 104729) % 7 < 3, 1.0, -1.0)


def _project(vectors: pd.Series, projection: np.ndarray) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) @ projection > 0


def simhash(vec: Column, projection: np.ndarray) -> Column:
    """Bit string of the signs of the projections."""
    @F.pandas_udf("string")
    def bits(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=str)
        marks = _project(vectors, projection)
        return pd.Series(["".join("1" if b else "0" for b in row) for row in marks])

    return bits(vec)


def lsh_code(vec: Column, projections: np.ndarray) -> Column:
    """Integer code with one bit per hash: the sign of the summed projection.

    ``projections`` has shape (hashes, dim, size); the sum over ``size`` is taken once, up front.
    """
    summed = projections.sum(axis=2).T

    @F.pandas_udf("long")
    def code(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype="int64")
        marks = _project(vectors, summed)
        return pd.Series(marks @ (1 << np.arange(marks.shape[1], dtype=np.int64)))

    return code(vec)


MAX_CODE_BITS = 12


def _code_candidates(queries: DataFrame, bank: DataFrame, bits: int, k: int) -> DataFrame:
    """The k bank keys nearest to each distinct query code, by Hamming distance and key id."""
    if bits > MAX_CODE_BITS:
        raise ValueError(f"codes of more than {MAX_CODE_BITS} bits are not supported")
    # Keys with one code are at one distance from a query, so the k smallest ids per code suffice.
    per_code = Window.partitionBy("code").orderBy("key_id")
    heads = (
        bank.select("key_id", "code")
        .withColumn("_r", F.row_number().over(per_code))
        .where(F.col("_r") <= k)
        .drop("_r")
    )
    masks = queries.select(F.col("code").alias("query_code")).distinct().select(
        "query_code", F.explode(F.sequence(F.lit(0), F.lit(2**bits - 1)).cast("array<bigint>")).alias("_m")
    )
    near = masks.select(
        "query_code",
        F.col("query_code").bitwiseXOR(F.col("_m")).alias("code"),
        F.bit_count("_m").alias("distance"),
    )
    ranked = Window.partitionBy("query_code").orderBy("distance", "key_id")
    return (
        near.join(heads, "code")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_code", "key_id", "distance", "rank")
    )


def lsh_topk(queries: DataFrame, bank: DataFrame, bits: int, k: int = 32) -> DataFrame:
    """The k bank keys nearest to each query by Hamming distance of their codes.

    ``queries(query_id, code)``, ``bank(key_id, code)``.  Queries with one code share their answer,
    so the search runs over distinct codes and is joined back to the queries.
    """
    found = _code_candidates(queries, bank, bits, k)
    return queries.join(broadcast_if_small(found), queries["code"] == F.col("query_code")).select(
        "query_id", "key_id", "distance", "rank"
    )


def attention_read(queries: DataFrame, bank: DataFrame, bits: int, k: int, dim: int) -> DataFrame:
    """Softmax-weighted sum of the values of the k nearest keys: ``query_id, output``.

    ``queries(query_id, code, vec)``, ``bank(key_id, code, key_vec, value_vec)``.
    """
    found = _code_candidates(queries, bank, bits, k)
    loaded = found.join(bank.select("key_id", "key_vec", "value_vec"), "key_id")
    memory = loaded.groupBy("query_code").agg(
        F.array_sort(F.collect_list(F.struct("rank", "key_vec", "value_vec"))).alias("_m")
    )
    # Few codes, but each with k vectors: whether they may be broadcast is a matter of bytes.
    joined = queries.join(broadcast_if_small(cut_lineage(memory)), queries["code"] == F.col("query_code"))
    scores = F.transform("_m", lambda m: N.dot(F.col("vec"), m["key_vec"]) / F.lit(float(dim) ** 0.5))
    weighted = joined.withColumn("_w", N.softmax(scores))
    zeros = F.array_repeat(F.lit(0.0), dim)
    pairs = F.zip_with("_w", "_m", lambda w, m: F.struct(w.alias("w"), m["value_vec"].alias("v")))
    output = F.aggregate(
        pairs, zeros, lambda acc, p: F.zip_with(acc, p["v"], lambda a, v: a + p["w"] * v.cast("double"))
    )
    return weighted.select("query_id", output.alias("output"))


def write_memory(
    df: DataFrame, capacity: int, seq: str = "seq", reward: str = "reward", threshold: float = 0.5
) -> DataFrame:
    """Rows worth remembering: reward above the threshold, the last ``capacity`` of them."""
    return last_rows(df.where(F.col(reward) > threshold), seq, capacity)


def memory_report(memory: DataFrame, accesses: DataFrame, capacity: int, key: str = "seq") -> DataFrame:
    """Accesses, slots in use and utilisation; ``accesses(key)`` has one row per read."""
    used = accesses.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return memory.join(used, key, "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_accesses"),
        F.count("_n").alias("active_slots"),
        (F.count("_n") / F.lit(capacity)).alias("utilization"),
    )


# --- capsules -----------------------------------------------------------------------------------


def split_capsules(vec: Column, k: int, size: int) -> Column:
    """``k`` consecutive sketches of ``size`` numbers."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: N.doubles(F.slice(vec, i * size + 1, F.lit(size)))
    )


def mean_vector(vectors: Column) -> Column:
    """Element-wise mean of a small array of vectors."""
    first = F.get(vectors, F.lit(0))
    zeros = F.transform(first, lambda _: F.lit(0.0))
    summed = F.aggregate(vectors, zeros, lambda acc, v: F.zip_with(acc, v, lambda a, x: a + x))
    return F.transform(summed, lambda x: x / F.size(vectors))


def capsule_similarity(a: Column, b: Column) -> Column:
    """Mean, min and (unbiased) std of the cosine similarities of paired capsules."""
    sims = F.zip_with(a, b, lambda x, y: N.cosine(x, y))

    def stats(s: Column) -> Column:
        mu = N.mean(s)
        var = let(mu, lambda m: N.total(F.transform(s, lambda x: (x - m) * (x - m)))) / (F.size(s) - 1)
        return F.struct(
            mu.alias("mean"), F.array_min(s).alias("min"), F.sqrt(var).alias("std"), s.alias("per_capsule")
        )

    return let(sims, stats)


def expansion_errors(sketches: Column, children: Column) -> Column:
    """``1 - cosine`` between each sketch and the mean of its children."""
    return F.zip_with(sketches, children, lambda s, c: 1 - N.cosine(mean_vector(c), s))


def should_expand(errors: Column, threshold: float = 0.1) -> Column:
    return F.exists(errors, lambda e: e > threshold)


def cycle_loss(sketches: Column, children: Column) -> Column:
    """Mean squared difference between the sketches and their pooled children."""
    return N.mean(F.zip_with(sketches, children, lambda s, c: N.mse(mean_vector(c), s)))


def reconstructability(checksums: Column, threshold: float = 0.5) -> Column:
    """Number of checksums with a norm above the threshold, and the bonus of a tenth each."""
    n = F.size(F.filter(checksums, lambda c: N.norm(c) > threshold))
    return F.struct(n.alias("n"), (n * F.lit(0.1)).alias("bonus"))


def expand_capsule(sketches: Column, children: Column, at: Column) -> Column:
    """Replace one sketch by its children; the length stays, by cutting or by zero vectors."""
    k = F.size(sketches)
    spliced = F.concat(
        F.slice(sketches, F.lit(1), at),
        F.get(children, at),
        F.slice(sketches, at + 2, F.greatest(k - at - 1, F.lit(0))),
    )
    zero = F.transform(F.get(sketches, F.lit(0)), lambda x: x * 0)
    padded = F.concat(spliced, F.transform(upto(k - F.size(spliced)), lambda _: zero))
    return F.slice(padded, F.lit(1), k)


def attention_pool(
    features: DataFrame, keys: list[str], logit: str, vec: str, dim: int
) -> DataFrame:
    """Softmax over the positions of each key, the weighted vector sum and the entropy.

    The softmax is built from two grouped aggregates, so a key with very many positions is still
    reduced in parallel: the maximum first, then all weighted sums at once.
    """
    top = features.groupBy(*keys).agg(F.max(logit).alias("_top"))
    shifted = features.join(top, keys).withColumn("_z", F.col(logit) - F.col("_top"))
    e = F.exp("_z")
    sums = shifted.groupBy(*keys).agg(
        F.sum(e).alias("_s"),
        *[F.sum(e * F.get(vec, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dim)],
    )
    pooled = F.array(*[F.col(f"_{i}") / F.col("_s") for i in range(dim)])
    p = e / F.col("_s")
    spread = (
        shifted.join(sums.select(*keys, "_s"), keys)
        .groupBy(*keys)
        .agg((-F.sum(p * F.ln(p + F.lit(1e-8)))).alias("entropy"))
    )
    return sums.select(*keys, pooled.alias("pooled")).join(spread, keys)


def top_children(weights: DataFrame, keys: list[str], weight: str, pos: str, m: int = 4) -> DataFrame:
    """The m positions with the largest weight per key; ties go to the earlier position."""
    order = Window.partitionBy(*keys).orderBy(F.desc(weight), pos)
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m)


# --- storage ------------------------------------------------------------------------------------


def quantise(vec: Column, levels: int = 127) -> Column:
    """``(scale, q)`` with one signed byte per number."""
    peak = F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))

    def pack(scale: Column) -> Column:
        q = F.transform(
            vec, lambda x: F.when(scale > 0, F.rint(x.cast("double") / scale)).otherwise(0.0).cast("tinyint")
        )
        return F.struct(scale.alias("scale"), q.alias("q"))

    return let(peak / levels, pack)


def dequantise(packed: Column) -> Column:
    return F.transform(packed["q"], lambda q: q * packed["scale"])

"""Exact nearest codes by Hamming distance for codes of any length, by multi-index hashing.

A code is an array of sub-codes of ``size`` bits. Two codes at a distance of at most m (s + 1) - 1 have
one of their m sub-codes at a distance of at most s, so keys are indexed under each sub-code and looked
up under all values at distance 0, 1, 2, ... of the query's sub-codes. A query is done as soon as its
kth distance is that certain. A look-up is a row that is shuffled and joined, a comparison a few machine
operations on packed codes that moves nothing: when the next radius would cost more than comparing, or
would move more rows than a few per code and key, the queries left are compared with all codes. Packs of
queries meet the blocks of keys one by one and keep their k nearest as they go, so what is written grows
with the queries and the keys, not with their pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.plans.bounds import broadcast_if_small, cut_lineage

#: Sub-codes are whole numbers of a column of int.
MAX_SIZE = 30
#: Query codes and keys that one comparison of blocks holds.
QUERY_BLOCK, KEY_BLOCK = 512, 8192
#: Comparisons of two codes in a block that cost about as much as one row of a look-up.
LOOKUP_COST = 64
#: So many rows of look-ups, or pairs of a query code and a key, are made without weighing them.
FEW_MEETINGS = 1_000_000
#: Beyond that, a radius may make so many of them per code and key; each is a row on disk.
MOVED = 16
#: Keys that one task holds while packs of codes pass by, and pairs that are compared in one task.
KEYS_AT_ONCE, TASK_PAIRS = 2_000_000, 4_000_000_000
#: Distances worked out at once.
TILE = 1 << 18


def sign_code(vec: Column, projection: np.ndarray, size: int) -> Column:
    """Sub-codes of ``size`` signs of the projections each, the first one in the lowest bit."""
    if not 0 < size <= MAX_SIZE or projection.shape[1] % size:
        raise ValueError(f"the bits must be whole sub-codes of at most {MAX_SIZE}")
    weights = (1 << np.arange(size)).astype(np.int64)

    @F.pandas_udf("array<int>")
    def code(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=object)
        marks = np.stack(vectors.to_numpy()).astype(np.float64) @ projection > 1e-12
        return pd.Series(list((marks.reshape(len(vectors), -1, size) @ weights).astype(np.int32)))

    return code(vec)


def nearest_first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_code").orderBy("distance", "key_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def gathered(found: DataFrame) -> DataFrame:
    """(query_code, found): the keys of each code in one row, the nearest first."""
    return found.groupBy("query_code").agg(F.array_sort(F.collect_list(F.struct("distance", "key_id"))).alias("found"))


def looked_up(codes: DataFrame, size: int, radius: int) -> DataFrame:
    """(query_code, at, value): all values at exactly ``radius`` from each sub-code of each code."""
    masks = [sum(1 << i for i in bits) for bits in itertools.combinations(range(size), radius)]
    looked = codes.select("query_code", F.posexplode("query_code").alias("at", "value"))
    return looked.select("query_code", "at", F.explode(F.transform(F.lit(masks).cast("array<int>"), lambda x: F.col("value").bitwiseXOR(x))).alias("value"))


def meetings(looked: DataFrame, index: DataFrame) -> int:
    """How many pairs of a query code and a key the look-up would make."""
    asked = looked.groupBy("at", "value").agg(F.count(F.lit(1)).alias("asked"))
    held = index.groupBy("at", "value").agg(F.count(F.lit(1)).alias("held"))
    return asked.join(held.hint("merge"), ["at", "value"]).agg(F.sum(F.col("asked") * F.col("held"))).first()[0] or 0


def probed(looked: DataFrame, index: DataFrame, reach: int | None = None) -> DataFrame:
    """Keys that have one of the values looked up, with their whole distance; of those within ``reach`` if given.

    A pair may meet under several sub-codes and at several radii. It counts where its sub-codes are
    nearest, the first time, which shows in the two codes, so pairs needn't travel to be made distinct.
    Spark sizes exploded rows like the rows they come from, so that without the hint it would broadcast them.
    """
    met = looked.join(index.hint("merge"), ["at", "value"])
    met = met.withColumn("parts", F.zip_with("query_code", "code", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")))
    met = met.where(F.array_position("parts", F.array_min("parts")) == F.col("at") + 1)
    found = met.select("query_code", "key_id", F.aggregate("parts", F.lit(0), lambda n, x: n + x).alias("distance"))
    return found if reach is None else found.where(F.col("distance") <= reach)


def packed(flat: np.ndarray, size: int) -> np.ndarray:
    """Sub-codes of a code side by side in as few words of 64 bits as they need; one row per word."""
    each = 64 // size
    shift = (np.arange(each) * size).astype(np.uint64)
    cut = [flat[:, j : j + each].astype(np.uint64) for j in range(0, flat.shape[1], each)]
    return np.stack([np.bitwise_or.reduce(x << shift[: x.shape[1]], axis=1) for x in cut])


def unpacked(words: np.ndarray, m: int, size: int) -> np.ndarray:
    """The sub-codes that ``packed`` put side by side; one row per code."""
    each, mask = 64 // size, np.uint64((1 << size) - 1)
    return np.stack([words[j // each] >> np.uint64(j % each * size) & mask for j in range(m)], axis=1).astype(np.int32)


def in_blocks(rows: DataFrame, most: int, size: int) -> DataFrame:
    """(ids, words): up to ``most`` rows of ``rows(id, code)`` of a partition at a time, with packed codes."""

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, words, n = [], [], 0
        for batch in batches:
            for a in range(0, len(batch), most):
                part = batch.iloc[a : a + most]
                ids.append(part["id"].to_numpy(np.int64))
                words.append(packed(np.stack(part["code"].to_list()).astype(np.int64), size))
                n += len(part)
                if n >= most:
                    flat, held = np.concatenate(ids), np.concatenate(words, axis=1)
                    yield pd.DataFrame({"ids": [flat[:most].tobytes()], "words": [held[:, :most].tobytes()]})
                    ids, words, n = [flat[most:]], [held[:, most:]], n - most
        if n:
            yield pd.DataFrame({"ids": [np.concatenate(ids).tobytes()], "words": [np.concatenate(words, axis=1).tobytes()]})

    return rows.mapInPandas(block, "ids binary, words binary")


class Nearest:
    """The k nearest keys so far of each code of a pack."""

    def __init__(self, words: np.ndarray, k: int, bits: int):
        self.words, self.k, self.kind = words, k, np.uint8 if bits < 255 else np.int32
        self.none = np.iinfo(self.kind).max
        self.apart = np.full((words.shape[1], k), self.none, self.kind)
        self.ids = np.zeros((words.shape[1], k), np.int64)

    def meet(self, ids: np.ndarray, held: np.ndarray) -> None:
        step = max(1, TILE // len(ids))
        for a in range(0, self.words.shape[1], step):
            q = self.words[:, a : a + step]
            apart = np.zeros((q.shape[1], len(ids)), self.kind)
            for x, y in zip(q, held):
                apart += np.bitwise_count(x[:, None] ^ y[None, :])
            worst = self.apart[a : a + step, -1]
            if len(ids) > self.k and (worst == self.none).any():
                worst = np.minimum(worst, np.partition(apart, self.k - 1, axis=1)[:, self.k - 1])
            at, key = np.nonzero(apart <= worst[:, None])
            if len(at):
                self.merge(a, at, apart[at, key], ids[key])

    def merge(self, a: int, at: np.ndarray, apart: np.ndarray, ids: np.ndarray) -> None:
        rows, place = np.unique(at, return_inverse=True)
        at = np.concatenate((np.repeat(np.arange(len(rows)), self.k), place))
        apart = np.concatenate((self.apart[a + rows].ravel(), apart))
        ids = np.concatenate((self.ids[a + rows].ravel(), ids))
        order = np.lexsort((ids, apart, at))
        starts = np.searchsorted(at[order], np.arange(len(rows)))
        kept = order[(starts[:, None] + np.arange(self.k)[None, :]).ravel()]
        self.apart[a + rows] = apart[kept].reshape(-1, self.k)
        self.ids[a + rows] = ids[kept].reshape(-1, self.k)

    def result(self, m: int, size: int) -> pd.DataFrame:
        sizes = (self.apart < self.none).sum(axis=1)
        ids, apart = [[x[:n] for x, n in zip(part, sizes)] for part in (self.ids, self.apart.astype(np.int32))]
        return pd.DataFrame({"query_code": list(unpacked(self.words, m, size)), "ids": ids, "distances": apart})


def compared(codes: DataFrame, keys: DataFrame, keys_count: int, m: int, size: int, k: int) -> DataFrame:
    """(query_code, found): the k nearest keys of each code; every pack of codes meets every block of keys once.

    Packs pass by the blocks of a partition of keys within one task (a Cartesian product, nothing of which
    is shuffled) and only leave with their k nearest. Beyond ``KEYS_AT_ONCE`` keys these meet once more.
    """
    n, cores = codes.count(), codes.sparkSession.sparkContext.defaultParallelism
    packs = max(1, math.ceil(n / QUERY_BLOCK))
    tasks = min(packs, max(cores, math.ceil(n * keys_count / TASK_PAIRS)))
    parts = math.ceil(keys_count / KEYS_AT_ONCE)
    pack = in_blocks(codes.select(F.lit(0).cast("long").alias("id"), F.col("query_code").alias("code")).repartition(tasks), QUERY_BLOCK, size)
    held = keys.select(F.col("key_id").alias("id"), "code").coalesce(max(1, math.ceil(keys_count / KEY_BLOCK)))
    block = cut_lineage(in_blocks(held, KEY_BLOCK, size)).coalesce(max(1, parts))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, best = None, None
        for batch in batches:
            for words, ids, flat in zip(batch["codes"], batch["ids"], batch["words"]):
                if words != now:
                    if best is not None:
                        yield best.result(m, size)
                    now, best = words, Nearest(np.frombuffer(words, np.uint64).reshape(math.ceil(m / (64 // size)), -1), k, m * size)
                ids = np.frombuffer(ids, np.int64)
                best.meet(ids, np.frombuffer(flat, np.uint64).reshape(-1, len(ids)))
        if best is not None:
            yield best.result(m, size)

    pairs = pack.select(F.col("words").alias("codes")).join(block.hint("shuffle_replicate_nl"))
    met = pairs.mapInPandas(meet, "query_code array<int>, ids array<long>, distances array<int>")
    found = met.select("query_code", F.transform(F.arrays_zip("distances", "ids"), lambda x: F.struct(x["distances"].alias("distance"), x["ids"].alias("key_id"))).alias("found"))
    if parts <= 1:
        return found
    return found.groupBy("query_code").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def nearest_codes(queries: DataFrame, bank: DataFrame, size: int, k: int = 32) -> DataFrame:
    """(query_id, key_id, distance, rank): the k keys of ``bank(key_id, code)`` nearest to each of ``queries(query_id, code)``.

    Ties go to the smaller key_id; fewer than k keys are all returned. Queries of one code share their
    search, and of the keys of one code only the k smallest ids take part, so copies of a code cost
    nothing. Rows without a code take no part.
    """
    queries, bank = queries.where("code is not null"), bank.where("code is not null")
    first = Window.partitionBy("code").orderBy("key_id")
    keys = cut_lineage(bank.select(F.col("key_id").cast("long").alias("key_id"), "code").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r"))
    left = cut_lineage(queries.select(F.col("code").alias("query_code")).distinct())
    n, sample = keys.count(), keys.first()
    if sample is None:
        return queries.select("query_id").limit(0).selectExpr("query_id", "0L as key_id", "0 as distance", "0 as rank")
    m = len(sample["code"])
    index = keys.select("key_id", "code", F.posexplode("code").alias("at", "value"))
    best, parts, radius, asked = None, [], 0, left.count()
    few = max(FEW_MEETINGS, MOVED * (n + asked))
    weighed = [s for s in range(size + 1) if m * math.comb(size, s) * LOOKUP_COST <= n]
    reach = m * (max(weighed, default=0) + 1) - 1
    while radius in weighed and asked * m * math.comb(size, radius) <= few:
        looked = looked_up(left, size, radius)
        if meetings(looked, index) > max(FEW_MEETINGS, min(few, asked * n // LOOKUP_COST)):
            break
        more = probed(looked, index, None if radius == size else reach)
        if best is not None:
            more = more.union(best.join(left, "query_code", "left_semi").select("query_code", "key_id", "distance"))
        best = cut_lineage(nearest_first(more, k))
        sure = best.groupBy("query_code").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("worst"))
        certain = (F.col("n") == k) & (F.col("worst") <= m * (radius + 1) - 1) | F.lit(radius == size)
        done = cut_lineage(sure.where(certain).select("query_code"))
        parts.append(gathered(best.join(done, "query_code", "left_semi")))
        left = cut_lineage(left.join(done, "query_code", "left_anti"))
        radius, asked = radius + 1, left.count()
    if asked:
        parts.append(compared(left, keys, n, m, size, k))
    if not parts:
        return queries.select("query_id").limit(0).selectExpr("query_id", "0L as key_id", "0 as distance", "0 as rank")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    answers = cut_lineage(found)
    met = queries.join(broadcast_if_small(answers), F.col("code") == F.col("query_code")).select("query_id", F.posexplode("found").alias("at", "near"))
    return met.select("query_id", "near.key_id", "near.distance", (F.col("at") + 1).alias("rank"))

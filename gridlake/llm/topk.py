"""Exact top-k search with block-at-a-time pruning.

Vectors are documents, their components the terms. The documents are put in an order that keeps those
of the same leading terms together and cut into ranges, the blocks; a block has a forward index (its
rows of weights) and the largest and smallest weight of every term. A query sums its terms' maxima to
a bound for each block, takes the blocks in descending order of the bounds, scores through the
forward index, and stops where the bounds fall below its kth score. Queries meet the index in packs:
every pack of queries is a row and every segment of blocks is one, so that a task holds one of each.
Before a pack travels, its queries are bounded by the maxima of whole segments, a few hundred segments
at a time, and only queries that a segment may serve are sent to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.llm.common import table, written

BLOCK_ROWS = 64
SEGMENT_ROWS = 4096
QUERY_ROWS = 512
#: Segments whose maxima share a row when queries are bounded.
GROUP_SEGMENTS = 256
#: Below every score; its negative is a number too.
LOWEST = np.iinfo(np.int64).min + 1


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def quantized(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def bisected(m: np.ndarray, block_rows: int) -> np.ndarray:
    """An order of the rows in which every ``block_rows`` of them lie close together.

    The rows are halved along the component that varies most, at a multiple of the block size, until
    a block is left.
    """
    done, open_ = [], [np.arange(len(m))]
    while open_:
        rows = open_.pop()
        if len(rows) <= block_rows or not m.shape[1]:
            done.append(rows)
            continue
        part = m[rows].astype(np.float64)
        values = part[:, np.argmax(part.var(axis=0))]
        half = max(1, len(rows) // (2 * block_rows)) * block_rows
        order = np.argsort(values, kind="stable")
        # The lower half is taken up next, so that blocks come out in order.
        open_ += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(done) if done else np.arange(0)


def segments(vectors: DataFrame, parts: int, k: int, block_rows: int) -> DataFrame:
    """One row per segment (id, ids, forward index) and query packs beside it, from (vec_id, v, is_query).

    Rows of pack = null are segments. The others are the queries found in the segment, each with the kth
    score it reaches within the segment: no score below that can be among its best.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        ids = rows["vec_id"].to_numpy(np.int64)
        width = max(map(len, rows["v"]))
        m = matrix(rows["v"].tolist(), width)
        order = bisected(m, block_rows)
        ids, m, rows = ids[order], m[order], rows.iloc[order]
        ends = {"high": [m.max(axis=0).tobytes()], "low": [m.min(axis=0).tobytes()]}
        yield pd.DataFrame({"segment": [part], "is_query": [False], "ids": [ids.tobytes()], "floors": [b""], "width": [width], "weights": [m.tobytes()], **ends})
        asked = np.flatnonzero(rows["is_query"].to_numpy(bool))
        for a in range(0, len(asked), QUERY_ROWS):
            at = asked[a : a + QUERY_ROWS]
            scores = products(m[at], m)
            scores[np.arange(len(at)), at] = LOWEST
            floors = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(at), LOWEST)
            yield pd.DataFrame({"segment": [part], "is_query": [True], "ids": [ids[at].tobytes()], "floors": [floors.tobytes()], "width": [width], "weights": [m[at].tobytes()], "high": [b""], "low": [b""]})

    schema = "segment long, is_query boolean, ids binary, floors binary, width int, weights binary, high binary, low binary"
    lead = F.transform(F.col("v"), lambda x: F.abs(x))
    first = F.array_position(lead, F.array_max(lead))
    keys = vectors.withColumn("__lead", F.coalesce(first * 2 + (F.element_at("v", F.greatest(first, F.lit(1)).cast("int")) > 0).cast("long"), F.lit(0))).withColumn("__top", F.coalesce(F.array_max(lead), F.lit(0)))
    return keys.repartitionByRange(parts, "__lead", "__top", "vec_id").sortWithinPartitions("__lead", "__top", "vec_id").select("vec_id", "v", "is_query").mapInPandas(pack, schema)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; floating point is used only where it is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def search_segment(q: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, m: np.ndarray, ids: np.ndarray, k: int, block_rows: int):
    """(query row, vec_id, score) of up to k best per query in one segment, none below the query's floor.

    The last value is the number of blocks scored, over all queries.
    """
    scored = 0
    width = max(q.shape[1], m.shape[1])
    q, m = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, m))
    cuts = np.arange(0, len(m), block_rows)
    high, low = np.maximum.reduceat(m, cuts, axis=0), np.minimum.reduceat(m, cuts, axis=0)
    # Summed term maxima; a negative weight has its maximum at the smallest component.
    bounds = products(np.maximum(q, 0), high) + products(np.minimum(q, 0), low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = np.full((len(q), k), LOWEST)
    best_ids = np.full((len(q), k), np.iinfo(np.int64).max)
    for step in range(len(cuts)):
        block = order[:, step]
        least = np.maximum(best[:, -1], floors)
        active = np.flatnonzero(bounds[np.arange(len(q)), block] >= least)
        if not len(active):
            break
        scored += len(active)
        by_block = active[np.argsort(block[active], kind="stable")]
        for group in np.split(by_block, np.flatnonzero(np.diff(block[by_block])) + 1):
            at = cuts[block[group[0]]]
            rows = slice(at, at + block_rows)
            scores = products(q[group], m[rows])
            scores[q_ids[group][:, None] == ids[rows][None, :]] = LOWEST
            all_scores = np.concatenate((best[group], scores), axis=1)
            all_ids = np.concatenate((best_ids[group], np.broadcast_to(ids[rows], scores.shape)), axis=1)
            keep = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[group] = np.take_along_axis(all_scores, keep, axis=1)
            best_ids[group] = np.take_along_axis(all_ids, keep, axis=1)
    row, place = np.nonzero((best > LOWEST) & (best >= floors[:, None]))
    return row, best_ids[row, place], best[row, place], scored


def bounded_pairs(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(segment, q_ids, floors, q_width, q_weights): per segment the queries of a pack that it may serve.

    A query whose summed term maxima over a whole segment stay below its floor has nothing to find there.
    """
    ends = index.select("segment", "width", "high", "low").withColumn("__group", F.floor(F.col("segment") / GROUP_SEGMENTS))
    groups = ends.groupBy("__group").agg(*[F.collect_list(c).alias(c) for c in ("segment", "width", "high", "low")])
    last = index.agg(F.max("segment")).first()[0]
    # Without a segment the only group has no partner.
    numbers = F.sequence(F.lit(0).cast("long"), F.lit((last or 0) // GROUP_SEGMENTS).cast("long"))
    pairs = asked.withColumn("__group", F.explode(numbers)).join(groups, "__group")

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, floors = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.floors, np.int64)
                width = max(r.q_width, max(r.width))
                q = np.pad(np.frombuffer(r.q_weights, np.int64).reshape(len(ids), r.q_width), ((0, 0), (0, width - r.q_width)))
                high, low = (matrix([np.frombuffer(x, np.int64) for x in c], width) for c in (r.high, r.low))
                bounds = products(np.maximum(q, 0), high) + products(np.minimum(q, 0), low)
                for column, segment in enumerate(r.segment):
                    at = np.flatnonzero(bounds[:, column] >= floors)
                    if len(at):
                        yield pd.DataFrame({"segment": [segment], "q_ids": [ids[at].tobytes()], "floors": [floors[at].tobytes()], "q_width": [width], "q_weights": [q[at].tobytes()]})

    return pairs.select("q_ids", "floors", "q_width", "q_weights", "segment", "width", "high", "low").mapInPandas(bound, "segment long, q_ids binary, floors binary, q_width int, q_weights binary")


def searched(vectors: DataFrame, queries: Column, k: int, id_column: str, vector: str, segment_rows: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, score, scored) of every segment's best, and the segments and packs themselves.

    Rows without a query_id tell how many blocks a segment scored for a pack.
    """
    v = F.col(vector)
    rows = vectors.where(F.col(id_column).isNotNull() & usable(v)).select(F.col(id_column).cast("long").alias("vec_id"), quantized(v).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = written(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query")))
    parts = max(1, -(-rows.count() // segment_rows))
    packs = written(segments(rows, parts, k, block_rows))
    index = packs.where("not is_query").select("segment", "ids", "width", "weights", "high", "low")
    asked = packs.where("is_query").select(F.col("ids").alias("q_ids"), F.col("floors"), F.col("width").alias("q_width"), F.col("weights").alias("q_weights"))
    pairs = bounded_pairs(asked, index).join(index.drop("high", "low"), "segment")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q = np.frombuffer(r.q_weights, np.int64).reshape(len(q_ids), r.q_width)
                m = np.frombuffer(r.weights, np.int64).reshape(len(ids), r.width)
                row, found, score, scored = search_segment(q, q_ids, np.frombuffer(r.floors, np.int64), m, ids, k, block_rows)
                yield pd.DataFrame({"query_id": pd.array(q_ids[row], dtype="Int64"), "vec_id": found, "score": score, "scored": 0})
                yield pd.DataFrame({"query_id": pd.array([None], dtype="Int64"), "vec_id": [0], "score": [0], "scored": [scored]})

    found = pairs.select("q_ids", "floors", "q_width", "q_weights", "ids", "width", "weights").mapInPandas(search, "query_id long, vec_id long, score long, scored long")
    return found, packs


def search_effort(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", segment_rows: int = SEGMENT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row: blocks there are for all queries together, blocks scored, and their share (null without any)."""
    found, packs = searched(vectors, queries, k, id_column, vector, segment_rows, block_rows)
    size = F.octet_length("ids") / 8
    there = packs.agg(
        F.coalesce(F.sum(F.when(F.col("is_query"), size)), F.lit(0)).cast("long").alias("queries"),
        F.coalesce(F.sum(F.when(~F.col("is_query"), F.ceil(size / block_rows))), F.lit(0)).cast("long").alias("per_query"),
    )
    blocks = F.col("queries") * F.col("per_query")
    scored = found.agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("scored")).scalar()
    return there.select(blocks.alias("blocks"), scored.alias("scored"), (scored / F.nullif(blocks, F.lit(0))).alias("share"))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", segment_rows: int = SEGMENT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query with all other rows.

    Components are floor(256 * x). Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part. Missing components of shorter vectors count as zero. Ties go to the
    smaller id; fewer than k other rows give fewer results. Rows that repeat an id are one row, the
    smallest in the order of arrays. An empty table, or no query, gives no rows.
    """
    found, _ = searched(vectors, queries, k, id_column, vector, segment_rows, block_rows)
    found = found.where("query_id is not null")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best of every row whose vec_id is divisible by 50, against all rows."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id != c.vec_id
  where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 5
"""

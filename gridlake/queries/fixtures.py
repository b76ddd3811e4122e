"""Inputs derived from the given tables, each as a DataFrame and as the same CTE in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions import grid as G
from gridlake.plans.bounds import spread
from gridlake.queries.registry import table

SIDE = 8


# --- grids --------------------------------------------------------------------------------------


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as an 8 x 8 grid of values 0..9."""
    emb = spread(table(spark, sf_dir, "embeddings"))

    def quantise(x: Column) -> Column:
        level = F.floor((x.cast("double") + 0.5) * 10).cast("int")
        return F.least(F.lit(9), F.greatest(F.lit(0), level))

    rows = F.transform(
        F.sequence(F.lit(0), F.lit(SIDE - 1)),
        lambda r: F.transform(F.slice("embedding", r * SIDE + 1, F.lit(SIDE)), quantise),
    )
    return emb.select(F.col("vec_id").alias("grid_id"), rows.alias("grid"))


CELLS = f"""
cells as (
  select vec_id as grid_id, (p // {SIDE})::int as r, (p % {SIDE})::int as c,
         least(9, greatest(0, floor((embedding[p + 1]::double + 0.5) * 10)))::int as v
  from embeddings, range({SIDE * SIDE}) t(p))"""


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grids cut to 3..8 rows and columns depending on their id."""
    h = (F.pmod("grid_id", F.lit(6)) + 3).cast("int")
    w = (F.pmod(F.floor(F.col("grid_id") / 6), F.lit(6)) + 3).cast("int")
    cut = G.crop(F.col("grid"), 0, 0, h, w)
    return grids(spark, sf_dir).select("grid_id", cut.alias("grid"))


RAGGED = (
    CELLS
    + """,
ragged as (
  select grid_id, r, c, v, (3 + grid_id % 6)::int as h, (3 + (grid_id // 6) % 6)::int as w
  from cells where r < 3 + grid_id % 6 and c < 3 + (grid_id // 6) % 6)"""
)


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged grids with two colours: 1 where the value is above 4, else 0."""
    two = F.transform(
        "grid", lambda row: F.transform(row, lambda v: F.when(v > 4, 1).otherwise(0))
    )
    return ragged(spark, sf_dir).select("grid_id", two.alias("grid"))


BINARY = (
    RAGGED
    + """,
two_tone as (select grid_id, r, c, (case when v > 4 then 1 else 0 end)::int as v, h, w from ragged)"""
)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive ragged grids as input and output of one example."""
    rows = ragged(spark, sf_dir)
    even = F.pmod("grid_id", F.lit(2)) == 0
    return (
        rows.groupBy(F.floor(F.col("grid_id") / 2).alias("pair_id"))
        .agg(
            F.first(F.when(even, F.col("grid")), ignorenulls=True).alias("input"),
            F.first(F.when(~even, F.col("grid")), ignorenulls=True).alias("output"),
        )
        .where(F.col("input").isNotNull() & F.col("output").isNotNull())
    )


PAIRS = (
    RAGGED
    + """,
pin as (select grid_id // 2 as pair_id, r, c, v, h, w from ragged where grid_id % 2 = 0),
pout as (select grid_id // 2 as pair_id, r, c, v, h, w from ragged where grid_id % 2 = 1)"""
)


def text_sql(source: str, keys: str = "grid_id") -> str:
    """SQL of the grid texts of a cell relation."""
    return (
        f"select {keys}, string_agg(line, ' | ' order by r) as grid from (select {keys}, r, "
        f"string_agg(v::varchar, ' ' order by c) as line from {source} group by {keys}, r) "
        f"group by {keys}"
    )


def colour_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ragged grid and colour, with the colour's cells as an object."""
    from gridlake.functions import objects as O

    rows = ragged(spark, sf_dir).withColumn("obj", F.explode(O.partition(F.col("grid"))))
    return rows.select("grid_id", O.color(F.col("obj")).alias("v"), "obj", "grid")


# --- hierarchy, predictions, tokens -------------------------------------------------------------


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puzzles (orders) of groups (customers) with their number of examples (lines)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size"))
    return orders.join(sizes, orders.o_orderkey == sizes.l_orderkey).select(
        F.col("o_orderpriority").alias("set_name"),
        F.col("o_custkey").alias("group_id"),
        F.col("o_orderkey").alias("puzzle_id"),
        "size",
    )


HIERARCHY = """
puzzles as (
  select o_orderpriority as set_name, o_custkey as group_id, o_orderkey as puzzle_id, count(*) as size
  from orders join lineitem on o_orderkey = l_orderkey group by all)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes per (name, input): predicted class, number of votes, quality, first sequence number."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.pmod("l_suppkey", F.lit(50)).alias("name"),
        F.pmod(F.col("l_linenumber").cast("long"), F.lit(3)).alias("input_hash"),
        F.pmod(F.col("l_quantity").cast("long"), F.lit(7)).alias("pred_hash"),
        F.col("l_discount").alias("q"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )


PREDICTIONS = """
predictions as (
  select l_suppkey % 50 as name, (l_linenumber % 3)::bigint as input_hash,
         trunc(l_quantity)::bigint % 7 as pred_hash, l_discount as q,
         l_orderkey * 100 + l_linenumber as seq
  from lineitem)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First ten embedding values as class scores of a labelled row."""
    scores = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", scores.alias("logits"))


LOGITS = """
logits as (
  select vec_id, label, list_transform(embedding[1:10], lambda x: x::double) as logits from embeddings),
scores as (select vec_id, label, i as cls, logits[i + 1] as x from logits, range(10) t(i))"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """54 token positions per embedding; the label of every fifth one is ignored."""
    emb = spread(table(spark, sf_dir, "embeddings"))
    rows = emb.select(
        "vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(53))).alias("pos")
    )
    scores = F.transform(F.slice("embedding", F.col("pos") + 1, F.lit(10)), lambda x: x.cast("double"))
    label = F.when(F.col("pos") % 5 == 0, F.lit(-100)).otherwise((F.col("label") + F.col("pos")) % 10)
    return rows.select("vec_id", "pos", label.alias("label"), scores.alias("logits"))


TOKENS = """
tokens as (
  select vec_id, p::int as pos, case when p % 5 = 0 then -100 else (label + p) % 10 end::int as label,
         list_transform(embedding[p + 1:p + 10], lambda x: x::double) as logits
  from embeddings, range(54) t(p)),
token_scores as (select vec_id, pos, label, i::int as cls, logits[i + 1] as x from tokens, range(10) t(i))"""

"""Example-level quality: difficulty, validity, rule verification and balancing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import grid as G
from gridlake.functions import objects as O
from gridlake.functions.arrays import let
from gridlake.plans.ordered import with_position

GridRule = Callable[[Column], Column]

GROUP_LIMIT = 1000  # largest rank limit that Spark pushes below the shuffle by default


def filter_low_quality(df: DataFrame, score: str = "solvability", threshold: float = 0.3) -> DataFrame:
    """Keep rows at or above the threshold; a missing score counts as 1."""
    return df.where(F.coalesce(F.col(score), F.lit(1.0)) >= threshold)


def non_degenerate(a: Column, b: Column) -> Column:
    """Whether output differs from input, in values or in shape."""
    return a != b


def pso_difficulty(a: Column, b: Column) -> Column:
    """Mean of pixel share, colour share and object density of an example."""
    area_a, area_b = G.height(a) * G.width(a), G.height(b) * G.width(b)
    colours = F.size(F.array_union(G.palette(a), G.palette(b)))
    n_a = F.size(O.objects(a, univalued=True, diagonal=False, without_bg=False))
    n_b = F.size(O.objects(b, univalued=True, diagonal=False, without_bg=False))
    # Two full grids have 1800 cells, and there are ten colours.
    pixels = (area_a + area_b) / F.lit(1800.0)
    density = (n_a / area_a + n_b / area_b) / 2
    return (pixels + colours / F.lit(10.0) + density) / 3


def verify_rule(examples: DataFrame, rule: GridRule, keys: list[str]) -> DataFrame:
    """Share of examples per key whose output the rule reproduces; ``solved`` when all are."""
    hit = F.coalesce(rule(F.col("input")) == F.col("output"), F.lit(False))
    return (
        examples.withColumn("hit", hit)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("hit").alias("n_ok"),
            F.avg(F.col("hit").cast("double")).alias("share"),
            F.bool_and("hit").alias("solved"),
        )
    )


def first_of_each_input(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Keep the first example per key and input grid.

    Map-side aggregation shrinks every group of copies before the shuffle, and the surviving rows are
    found again by their unique sequence number.
    """
    hashed = df.withColumn("_hash", G.grid_hash(F.col("input")))
    firsts = hashed.groupBy(*keys, "_hash").agg(F.min(seq).alias(seq)).select(*keys, seq)
    return df.join(firsts, [*keys, seq], "left_semi")


def verified_examples(
    examples: DataFrame, rule: GridRule, keys: list[str], seq: str, cap: int | None = None
) -> DataFrame:
    """Valid, rule-conforming, non-degenerate, unseen examples, at most ``cap`` per key."""
    good = examples.where(_checks(rule)["kept"])
    unique = first_of_each_input(good, keys, seq)
    if cap is None:
        return unique
    if cap <= GROUP_LIMIT:
        # A small constant rank limit is applied in every task before the shuffle.
        order = Window.partitionBy(*keys).orderBy(seq)
        return unique.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cap).drop("_rank")
    numbered = with_position(unique, keys, [seq], "_rank")
    return numbered.where(F.col("_rank") < cap).drop("_rank")


def _checks(rule: GridRule) -> dict[str, Column]:
    a, b = F.col("input"), F.col("output")
    valid = G.is_valid(a) & G.is_valid(b)
    holds = F.coalesce(rule(a) == b, F.lit(False))
    return {"valid": valid, "holds": valid & holds, "kept": valid & holds & non_degenerate(a, b)}


def verification_funnel(examples: DataFrame, rule: GridRule, keys: list[str], seq: str) -> DataFrame:
    """Per key: examples generated, valid, verified, non-degenerate and unique."""
    checks = _checks(rule)
    flagged = examples.select(
        *keys, F.col(seq), G.grid_hash(F.col("input")).alias("_hash"), *[c.alias(k) for k, c in checks.items()]
    )
    # Two-level count: per input first, so a hot input never reaches the second shuffle as rows.
    per_input = flagged.groupBy(*keys, "_hash").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(k).alias(k) for k in checks]
    )
    return per_input.groupBy(*keys).agg(
        F.sum("n").alias("generated"),
        F.sum("valid").alias("valid"),
        F.sum("holds").alias("verified"),
        F.sum("kept").alias("non_degenerate"),
        F.count_if(F.col("kept") > 0).alias("unique_inputs"),
    )


def patch_cells(grids: DataFrame, patches: DataFrame, key: str = "grid_id") -> DataFrame:
    """Overwrite the listed cells; of several values for one cell the smallest is taken.

    ``patches(key, r, c, v)``.
    """
    # One value per cell first, so no grid collects more entries than it has cells.
    per_cell = patches.groupBy(key, "r", "c").agg(F.min("v").alias("v"))
    per_grid = per_cell.groupBy(key).agg(
        F.collect_list(F.struct("v", "r", "c")).alias("_patch")
    )
    joined = grids.join(per_grid, key, "left")
    fixed = F.when(F.col("_patch").isNull(), F.col("grid")).otherwise(
        O.paint(F.col("grid"), F.col("_patch"))
    )
    return joined.withColumn("grid", fixed).drop("_patch")


def difficulty_bucket(score: Column, easy: float, hard: float) -> Column:
    return F.when(score < easy, "easy").when(score < hard, "medium").otherwise("hard")


# Target shares of a balanced set.
BALANCE = {"easy": 0.25, "medium": 0.50, "hard": 0.25}


def balance_by_difficulty(
    df: DataFrame, score: str, easy: float, hard: float, hash_col: str, total: int | None = None
) -> DataFrame:
    """Down-sample the difficulty buckets to 25/50/25 of ``total`` rows, in hash order."""
    bucketed = df.withColumn("bucket", difficulty_bucket(F.col(score), easy, hard))
    size = total if total is not None else bucketed.count()
    quota = F.lit(0).cast("long")
    for name, share in BALANCE.items():
        quota = F.when(F.col("bucket") == name, F.lit(int(size * share))).otherwise(quota)
    ranked = with_position(bucketed, ["bucket"], [hash_col], "_rank")
    return ranked.where(F.col("_rank") < quota).drop("_rank")


def difficulty_slices(df: DataFrame, keys: list[str], score: str, tie: str, n: int) -> DataFrame:
    """Easy rows ``[n, 2n)`` and hard rows ``[8n, 9n)`` of each key, sorted by difficulty."""
    ranked = with_position(df, keys, [score, tie], "rank")
    part = (
        F.when(F.col("rank").between(n, 2 * n - 1), "easy")
        .when(F.col("rank").between(8 * n, 9 * n - 1), "hard")
    )
    return ranked.withColumn("slice", part).where(F.col("slice").isNotNull())


def augment_dihedral(
    df: DataFrame, grid: str = "grid", label: str | None = None, transform_label: bool = False
) -> DataFrame:
    """Each row and its seven symmetric copies, ids ending in ``_aug1`` .. ``_aug7``.

    The eight forms are exploded inside the row, so nothing is shuffled.
    """
    out = df.withColumn("tid", F.explode(F.array(*[F.lit(i) for i in range(8)])))
    moved = out.withColumn(grid, G.dihedral(F.col(grid), F.col("tid")))
    if label is not None and transform_label:
        moved = moved.withColumn(label, G.dihedral(F.col(label), F.col("tid")))
    suffix = F.when(F.col("tid") == 0, F.lit("")).otherwise(F.concat(F.lit("_aug"), F.col("tid")))
    return moved.withColumn("sample_id", F.concat(F.col("sample_id").cast("string"), suffix))


# The augmentations that move one side of an example, with their symmetry id.
PROBLEM_TRANSFORMS = [
    ("rotate_90", 1),
    ("rotate_180", 2),
    ("rotate_270", 3),
    ("flip_h", 4),
    ("flip_v", 5),
]


def augment_problem(df: DataFrame, seed: int = 42, probability: float = 0.5) -> DataFrame:
    """Copies of grid and maze samples with the input *or* the label transformed.

    Whether, how and which side is read from one md5 of the id, so every run draws the same copies.
    """
    digest = F.md5(F.concat_ws("|", F.col("sample_id").cast("string"), F.lit(str(seed))))

    def draw(start: int, n: int) -> Column:
        return F.conv(F.substring(digest, start, n), 16, 10).cast("long")

    names = F.array(*[F.lit(name) for name, _ in PROBLEM_TRANSFORMS])
    tids = F.array(*[F.lit(tid) for _, tid in PROBLEM_TRANSFORMS])
    pick = F.pmod(draw(9, 8), F.lit(len(PROBLEM_TRANSFORMS))).cast("int")
    drawn = (
        df.where(F.col("modality").isin("grid", "maze"))
        .where(draw(1, 8) < int(probability * 2**32))
        .withColumn("_name", F.get(names, pick))
        .withColumn("_tid", F.get(tids, pick))
        .withColumn("_input", F.pmod(draw(17, 8), F.lit(2)) == 0)
    )
    side = F.when(F.col("_input"), F.lit("True")).otherwise(F.lit("False"))
    moved = drawn.withColumn(
        "grid", F.when(F.col("_input"), G.dihedral(F.col("grid"), F.col("_tid"))).otherwise(F.col("grid"))
    ).withColumn(
        "label",
        F.when(~F.col("_input"), G.dihedral(F.col("label"), F.col("_tid"))).otherwise(F.col("label")),
    )
    return (
        moved.withColumn(
            "sample_id", F.concat_ws("_", F.col("sample_id"), F.lit("probaug"), F.col("_name"), side)
        )
        .withColumn("problem_aug", F.col("_name"))
        .withColumn("aug_input", F.col("_input"))
        .drop("_name", "_tid", "_input")
    )


def object_bounds(obj: Column) -> Column:
    """Size, colour and bounding box of an object."""
    return let(
        O.bbox(obj),
        lambda b: F.struct(
            F.size(obj).alias("n"), O.color(obj).alias("v"), b["t"].alias("t"), b["l"].alias("l"),
            b["b"].alias("b"), b["r"].alias("r"),
        ),
    )

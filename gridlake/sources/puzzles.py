"""Puzzle sources: JSON puzzle files and CSV grids, as sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.plans.ordered import with_position
from gridlake.plans.storage import exists
from gridlake.schemas import LABEL, PUZZLE_FILE, SOLUTION_FILE
from gridlake.sources.entries import read_json_entries


def _label_grid(grid: Column) -> Column:
    empty = F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("bigint").alias("i"), grid.alias("grid"))
    return F.when(grid.isNotNull(), empty.cast(LABEL))


def _grid_samples(df: DataFrame, metadata: Column, modality: str = "grid") -> DataFrame:
    return df.select(
        "sample_id",
        F.lit(modality).alias("modality"),
        "grid",
        _label_grid(F.col("output")).alias("label"),
        metadata.alias("metadata"),
    )


def _entries(*pairs: tuple[str, Column]) -> Column:
    return F.create_map(*[x for key, value in pairs for x in (F.lit(key), value)])


def parse_puzzles(texts: DataFrame, value: str = "value") -> DataFrame:
    """Pairs of puzzle files: ``puzzle_id, split, idx, input, output``."""
    puzzles = texts.select(F.explode(F.from_json(value, PUZZLE_FILE)).alias("puzzle_id", "p"))
    # A record that is not an object becomes a puzzle with neither split, so it contributes no rows.
    splits = puzzles.select(
        "puzzle_id",
        F.explode(
            F.array(
                F.struct(F.lit("train").alias("split"), F.col("p.train").alias("pairs")),
                F.struct(F.lit("test").alias("split"), F.col("p.test").alias("pairs")),
            )
        ).alias("s"),
    )
    pairs = splits.select("puzzle_id", "s.split", F.posexplode("s.pairs").alias("idx", "pair"))
    return pairs.select("puzzle_id", "split", "idx", "pair.input", "pair.output")


def puzzle_samples(texts: DataFrame, kind: str = "puzzle", value: str = "value") -> DataFrame:
    """Samples of single-file puzzles; a pair without output is its own label."""
    pairs = parse_puzzles(texts, value)
    named = pairs.select(
        F.concat_ws("_", "puzzle_id", "split", "idx").alias("sample_id"),
        F.col("input").alias("grid"),
        F.coalesce("output", "input").alias("output"),
        "puzzle_id",
        "split",
    )
    meta = _entries(("puzzle_id", F.col("puzzle_id")), ("split", F.col("split")), ("type", F.lit(kind)))
    return _grid_samples(named, meta)


def challenge_samples(challenges: DataFrame, solutions: DataFrame, value: str = "value") -> DataFrame:
    """Samples of challenge files with separate solutions.

    Training pairs carry their output; test pairs get the solution of their task at their ordinal.
    Tasks without any solution are skipped.
    """
    solved = solutions.select(F.explode(F.from_json(value, SOLUTION_FILE)).alias("puzzle_id", "grids"))
    answers = solved.select("puzzle_id", F.posexplode("grids").alias("idx", "answer"))
    pairs = parse_puzzles(challenges, value)
    known = pairs.join(solved.select("puzzle_id"), "puzzle_id", "left_semi")
    train = known.where("split = 'train'")
    test = known.where("split = 'test'").drop("output").join(answers, ["puzzle_id", "idx"])
    joined = train.unionByName(test.withColumnRenamed("answer", "output"))
    named = joined.select(
        F.concat_ws("_", "puzzle_id", "split", "idx").alias("sample_id"),
        F.col("input").alias("grid"),
        "output",
        "puzzle_id",
        "split",
    )
    meta = _entries(("task_id", F.col("puzzle_id")), ("split", F.col("split")))
    return _grid_samples(named, meta)


def read_puzzle_json(spark: SparkSession, path: str, kind: str = "puzzle") -> DataFrame:
    """Samples of JSON puzzle files, each read in many tasks."""
    return puzzle_samples(read_json_entries(spark, path), kind)


# Names of the challenge and solution files of a folder, training before evaluation.
CHALLENGE_FILES = [
    ("arc-agi_training_challenges.json", "arc-agi_training_solutions.json"),
    ("arc-agi_evaluation_challenges.json", "arc-agi_evaluation_solutions.json"),
]


def read_challenges(spark: SparkSession, folder: str) -> DataFrame:
    """Challenges of a folder; the evaluation files are used where there are no training files."""
    for challenge, solution in CHALLENGE_FILES:
        first, second = f"{folder.rstrip('/')}/{challenge}", f"{folder.rstrip('/')}/{solution}"
        if exists(spark, first) and exists(spark, second):
            return challenge_samples(read_json_entries(spark, first), read_json_entries(spark, second, "]"))
    raise FileNotFoundError(f"no challenge files in {folder}")


# --- CSV ----------------------------------------------------------------------------------------


def square_bytes(text: Column) -> Column:
    """Square grid of the byte values of a text; the side is the rounded-down root of its length."""
    side = F.floor(F.sqrt(F.length(text))).cast("int")
    codes = F.transform(F.split(text, ""), lambda ch: F.ascii(ch))
    row = lambda i: F.slice(codes, i * side + 1, side)
    return F.when(side * side == F.length(text), F.transform(F.sequence(F.lit(0), side - 1), row))


def digit_grid(text: Column, side: int = 9) -> Column:
    """side x side grid of the digits of a text."""
    digits = F.transform(F.split(text, ""), lambda ch: ch.try_cast("int"))
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.slice(digits, i * side + 1, F.lit(side))
    )
    good = F.regexp_like(text, F.lit(rf"^[0-9]{{{side * side}}}$"))
    return F.when(good, grid)


def maze_samples(rows: DataFrame, kind: str = "maze") -> DataFrame:
    """``rows(idx, source, grid, solution)``; rows without all three fields are dropped."""
    whole = rows.where(F.col("source").isNotNull() & F.col("grid").isNotNull() & F.col("solution").isNotNull())
    named = whole.select(
        F.concat_ws("_", F.lit(kind), "idx").alias("sample_id"),
        square_bytes(F.col("grid")).alias("grid"),
        square_bytes(F.col("solution")).alias("output"),
        "source",
    )
    return _grid_samples(named, _entries(("type", F.lit(kind)), ("source", F.col("source"))), "maze")


def sudoku_samples(rows: DataFrame, source: str = "sudoku") -> DataFrame:
    """``rows(idx, quiz, solution)`` with 81 digits each."""
    whole = rows.where(F.col("quiz").isNotNull() & F.col("solution").isNotNull())
    named = whole.select(
        F.concat_ws("_", F.lit("sudoku"), "idx").alias("sample_id"),
        digit_grid(F.col("quiz")).alias("grid"),
        digit_grid(F.col("solution")).alias("output"),
    )
    return _grid_samples(named, _entries(("type", F.lit("sudoku")), ("source", F.lit(source))))


def read_numbered_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header and the 0-based row number inside its file as ``idx``.

    Files are read in splits; the split offset and the order inside the split give the row number.
    """
    schema = ", ".join(f"{c} string" for c in columns)
    raw = spark.read.schema(schema).option("header", True).csv(path)
    placed = raw.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return with_position(placed, ["_file"], ["_start", "_row"], "idx").drop("_file", "_start", "_row")


def read_maze_csv(spark: SparkSession, path: str, kind: str = "maze") -> DataFrame:
    return maze_samples(read_numbered_csv(spark, path, ["source", "grid", "solution"]), kind)


def read_sudoku_csv(spark: SparkSession, path: str) -> DataFrame:
    return sudoku_samples(read_numbered_csv(spark, path, ["quiz", "solution"]), path)

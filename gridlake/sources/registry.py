"""The built-in sources by the type that ``source_type`` detects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions import text as X
from gridlake.operators import quality as Q
from gridlake.plans.build import clean
from gridlake.plans.registry import SOURCES, register_source, register_transform
from gridlake.plans.storage import exists
from gridlake.sources import files, puzzles

register_source("puzzlevqa")(files.read_puzzle_vqa)
register_source("mathv")(files.read_math_vision)
register_source("raven")(lambda spark, path: files.raven_samples(files.catalogue(spark, path)))
register_source("arc_json")(puzzles.read_challenges)
register_source("maze_csv")(puzzles.read_maze_csv)
register_source("sudoku_grid")(puzzles.read_sudoku_csv)
register_source("text_file")(files.read_word_chunks)
register_source("image_dir")(lambda spark, path: files.image_samples(files.catalogue(spark, path)))
register_source("local")(lambda spark, path: files.file_samples(files.catalogue(spark, path)))

register_transform("preprocess_sample")(clean)
register_transform("augment_sample")(Q.augment_dihedral)


def detect(spark: SparkSession, path: str) -> str:
    """Source type of a path."""
    there = exists(spark, path)
    is_dir = False
    if there:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        is_dir = target.getFileSystem(conf).getFileStatus(target).isDirectory()
    kind = X.source_type(F.lit(path), F.lit(is_dir), F.lit(there))
    return spark.range(1).select(kind).first()[0]


def load(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a path, read by its detected type."""
    kind = detect(spark, path)
    if kind not in SOURCES:
        raise ValueError(f"{path}: sources of type {kind!r} are not read from storage")
    return SOURCES[kind](spark, path)

"""One-to-many transforms as table functions, for SQL and DataFrames alike.

``register(spark)`` makes them callable in SQL: ``augment_sample`` laterally, one call a row, and
``distinct_forms`` over a table ``PARTITION BY sample_id ORDER BY tid``, one call a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

FORMS = "sample_id string, tid int, grid array<array<int>>"


class AugmentSample:
    """A sample and its seven symmetric copies, ids ending in ``_aug1`` .. ``_aug7``; a null grid stays null."""

    def eval(self, sample_id: str, grid: list) -> Iterator[tuple]:
        across = None if grid is None else [list(column) for column in zip(*grid)]
        for tid in range(8):
            name = sample_id if tid == 0 or sample_id is None else f"{sample_id}_aug{tid}"
            if grid is None:
                yield name, tid, None
                continue
            # Quarter turns and the two diagonals start from the transposed grid.
            rows = across if tid in (1, 3, 6, 7) else grid
            if tid in (2, 3, 4, 7):
                rows = [row[::-1] for row in rows]
            yield name, tid, rows[::-1] if tid in (1, 2, 5, 7) else rows


class DistinctForms:
    """The forms of one sample that differ from all earlier ones; a sample has eight, so its state is small."""

    def __init__(self) -> None:
        self.seen: set = set()

    def eval(self, form: Row) -> Iterator[tuple]:
        shape = None if form["grid"] is None else tuple(map(tuple, form["grid"]))
        if shape not in self.seen:
            self.seen.add(shape)
            yield form["sample_id"], form["tid"], form["grid"]


def augment_function() -> UserDefinedTableFunction:
    return F.udtf(AugmentSample, returnType=FORMS)


def distinct_function() -> UserDefinedTableFunction:
    return F.udtf(DistinctForms, returnType=FORMS)


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL under their names."""
    spark.udtf.register("augment_sample", augment_function())
    spark.udtf.register("distinct_forms", distinct_function())


def augment_samples(df: DataFrame) -> DataFrame:
    """``sample_id, tid, grid`` of the eight forms of every row of df(sample_id, grid); nothing is shuffled."""
    given = df.select(F.col("sample_id").cast("string").alias("_id"), F.col("grid").alias("_grid"))
    return given.lateralJoin(augment_function()(F.col("_id").outer(), F.col("_grid").outer())).drop("_id", "_grid")


def distinct_forms(forms: DataFrame, sample: str = "source_id") -> DataFrame:
    """The first of equal forms of each sample; ``forms(sample, sample_id, tid, grid)``, one partition a sample."""
    rows = forms.select(sample, "sample_id", "tid", "grid")
    return distinct_function()(rows.asTable().partitionBy(sample).orderBy("tid"))

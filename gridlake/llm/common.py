"""Helpers of the training-data operators: words, bounded slices, written intermediate tables, one-row facts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.plans.bounds import cut_lineage
from gridlake.queries.registry import table

__all__ = ["WORD", "bounded_batches", "cut_lineage", "labelled_sample", "lower_ascii", "scalars", "slices", "table", "written"]

# Fixed value: a word is a run of code points other than the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

SLICE_CHARS = 1_000_000
#: Longest text, in characters, that a classifier is fitted on; with the size of the sample it bounds what reaches the driver.
LONGEST = 200_000
BATCH_BYTES = 8 << 20


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def slices(texts, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most about ``limit`` characters together (one longer text stands alone)."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(texts):
        yield start, len(texts)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python by bytes, so that batches of very long texts stay small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def written(df: DataFrame) -> DataFrame:
    """The table, written as compressed Parquet in the shared checkpoint folder and read back.

    Like ``checkpoint()`` it cuts the lineage on storage that survives a lost executor, in less space.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridlake-tables-"))
    path = os.path.join(context.getCheckpointDir(), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scalars(df: DataFrame) -> dict:
    """The one row of a global aggregate as a dict."""
    return df.first().asDict()


def labelled_sample(labels: DataFrame, column: str, classes: list, most: int, seed: int) -> DataFrame:
    """(doc_id, label): at most ``most`` documents of each class, in the order of a hash of their ids.

    The bound makes the sample small enough to broadcast. A document with several labels has the last
    of them in the order of the classes.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(column))
    one = labels.where("doc_id is not null").where(rank > 0).groupBy("doc_id").agg(F.max_by(column, rank).alias("label"))
    one = cut_lineage(one.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id")))
    parts = [one.where(F.col("label") == c).orderBy("__h", "doc_id").limit(most) for c in classes]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select("doc_id", "label")

"""Size checks before anything is broadcast or captured, and lineage cuts on shared storage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_ROWS = 200_000
SMALL_BYTES = 64 << 20


def small_limit(df: DataFrame) -> int:
    """Rows a broadcast side may have; ``gridlake.broadcast.maxRows`` overrides it."""
    return int(df.sparkSession.conf.get("gridlake.broadcast.maxRows", str(SMALL_ROWS)))


def small_bytes(df: DataFrame) -> int:
    """Bytes a broadcast side may have; ``gridlake.broadcast.maxBytes`` overrides it."""
    return int(df.sparkSession.conf.get("gridlake.broadcast.maxBytes", str(SMALL_BYTES)))


def value_bytes(col: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes; fixed-size kinds count as one word and aren't read for it."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.ArrayType):
        part = kind.elementType
        if isinstance(part, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            inner = F.aggregate(col, F.lit(0).cast("long"), lambda total, x: total + value_bytes(x, part))
            return F.coalesce(inner, F.lit(0).cast("long")) + 8
        return F.greatest(F.size(col), F.lit(0)).cast("long") * 8 + 8
    if isinstance(kind, T.MapType):
        keys = value_bytes(F.map_keys(col), T.ArrayType(kind.keyType))
        return keys + value_bytes(F.map_values(col), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        total = F.lit(8).cast("long")
        for field in kind.fields:
            total = total + value_bytes(col.getField(field.name), field.dataType)
        return total
    return F.lit(8).cast("long")


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes, by its values."""
    total = F.lit(8).cast("long")
    for field in df.schema.fields:
        total = total + value_bytes(F.col(f"`{field.name}`"), field.dataType)
    return total


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether the table has at most ``limit`` rows and few enough bytes; reads at most ``limit + 1`` rows."""
    limit = limit or small_limit(df)
    head = df.select(row_bytes(df).alias("_bytes")).limit(limit + 1)
    rows, size = head.agg(F.count(F.lit(1)), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    return rows <= limit and size <= small_bytes(df)


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast only for a side whose rows and bytes were checked; else leave the join to Spark."""
    return F.broadcast(df) if is_small(df, limit) else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names (a private folder only where unset)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridlake-ckpt-"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a table read in fewer tasks than there are cores; large tables stay as they are.

    For work that costs far more per row than moving the row, such as grid and vector functions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

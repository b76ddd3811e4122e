"""Order-dependent work that stays parallel when one key holds most of the rows.

A plain window puts a whole key into one task.  Here the largest key is measured first.  If it fits
one task the plain window is used; otherwise the order is cut into blocks of bounded size, every
(key, block) is numbered by itself, and a prefix sum over the block counts gives the offsets.
"""

from __future__ import annotations

import math
import os

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_TASK = 4_000_000
MAX_BLOCKS = 10_000


def rows_per_task(df: DataFrame) -> int:
    """Rows one window task may hold; ``gridlake.window.rowsPerTask`` overrides it."""
    return int(df.sparkSession.conf.get("gridlake.window.rowsPerTask", str(ROWS_PER_TASK)))


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows of the largest key, rows of the table)."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return int(row[0] or 0), int(row[1] or 0)


LEVELS = 4


def order_keys(df: DataFrame, order: list[str]) -> list[Column]:
    """Doubles that never decrease along ``order``; each next one refines ties of those before it.

    Text is read six bytes at a time, after the prefix that its smallest and largest value share and
    with them every value in between.
    """
    keys: list[Column] = []
    for name in order:
        kind, col = df.schema[name].dataType, F.col(name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            keys.append(col.cast("timestamp").cast("double"))
        elif isinstance(kind, T.StringType):
            ends = [x.encode() for x in df.agg(F.min(name), F.max(name)).first() if x is not None]
            shared = len(os.path.commonprefix(ends)) if ends else 0
            for start in (shared + 1, shared + 7):
                part = F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), start, 6)), 12, "0")
                keys.append(F.conv(part, 16, 10).cast("double"))
        elif isinstance(kind, T.NumericType):
            keys.append(col.cast("double"))
        else:
            break  # no number stands for this type; rows tied so far share a block
        if len(keys) >= LEVELS:
            break
    return keys[:LEVELS]


def _bucket(df: DataFrame, key: Column, out: str, blocks: int) -> tuple[DataFrame, list[float]]:
    """Add the range bucket of ``key``; also return values that fill more than one bucket."""
    probs = [i / blocks for i in range(1, blocks)]
    cuts = df.agg(F.percentile_approx(key, probs, max(10_000, 10 * blocks))).first()[0] or []
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    heavy = sorted({c for c in cuts if cuts.count(c) > 1}) if len(set(cuts)) < len(cuts) else []
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0)), heavy
    bucketizer = Bucketizer(splits=splits, inputCol="_ord", outputCol=out, handleInvalid="keep")
    return bucketizer.transform(df.withColumn("_ord", key)).drop("_ord"), heavy


def with_block(df: DataFrame, order: list[str], total: int, rows: int, out: str = "_blk") -> DataFrame:
    """Cut the table into order-preserving blocks of about ``rows`` rows.

    Equal values of the first order key share a block, unless they alone fill several blocks: such
    values are cut again by the next key.
    """
    blocks = min(MAX_BLOCKS, max(2, math.ceil(total / rows)))
    cut, parts, tied = df, [], F.lit(True)
    keys = order_keys(df, order) or [F.lit(0.0)]
    for i, key in enumerate(keys):
        cut, heavy = _bucket(cut, key, f"_b{i}", blocks)
        # A bucket that starts at a heavy value may hold larger values too; they sort after it.
        parts.append(F.when(tied, F.col(f"_b{i}")).otherwise(F.lit(float(MAX_BLOCKS + 1))).alias(f"l{i}"))
        if not heavy:
            break
        tied = tied & key.isin(heavy)
    return cut.withColumn(out, F.struct(*parts)).drop(*[f"_b{i}" for i in range(len(parts))])


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    inclusive: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Running sums per key in ``order``, with the row itself or of the rows before it only.

    ``order`` must be a total order inside a key.
    """
    limit = limit or rows_per_task(df)
    largest, total = group_sizes(df, keys)
    last = 0 if inclusive else -1

    def running(window) -> dict[str, Column]:
        frame = window.rowsBetween(Window.unboundedPreceding, last)
        return {out: F.coalesce(F.sum(value).over(frame), F.lit(0)) for out, value in sums.items()}

    if largest <= limit:
        return df.withColumns(running(Window.partitionBy(*keys).orderBy(*order)))
    blocked = with_block(df, order, total, limit)
    per_block = blocked.groupBy(*keys, "_blk").agg(*[F.sum(v).alias(f"_t_{o}") for o, v in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_blk").alias("_kb"),
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in sums],
    )
    match = F.col("_blk") == F.col("_kb")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = running(Window.partitionBy(*keys, "_blk").orderBy(*order))
    summed = blocked.withColumns(inside).join(offsets, match)
    whole = summed.withColumns({o: F.col(f"_off_{o}") + F.col(o) for o in sums})
    return whole.drop("_blk", "_kb", *[f"_off_{o}" for o in sums], *[f"_k{i}" for i in range(len(keys))])


def with_position(
    df: DataFrame, keys: list[str], order: list[str], out: str = "pos", limit: int | None = None
) -> DataFrame:
    """0-based dense position of each row inside its key; ``order`` must be a total order."""
    one = F.lit(1).cast("long")
    return prefix_sums(df, keys, order, {out: one}, inclusive=False, limit=limit)


def bounded_window(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    before: int = 0,
    after: int = 0,
    position: str | None = None,
    limit: int | None = None,
):
    """Layout for frames that look at most ``before`` rows back and ``after`` rows ahead.

    Returns ``(df, window, core)``: evaluate the frame over ``window`` and keep the rows where
    ``core`` holds.  A key too large for one task is cut into chunks of its dense positions, and the
    few rows at a chunk border are copied into the neighbour, so frames stay exact.  ``position``
    names a column for the 0-based dense position inside the key.
    """
    limit = limit or rows_per_task(df)
    largest, _ = group_sizes(df, keys)
    if largest <= limit:
        window = Window.partitionBy(*keys).orderBy(*order)
        if position:
            df = df.withColumn(position, F.row_number().over(window).cast("long") - 1)
        return df, window, F.lit(True)
    span = max(limit, before + after + 1)
    numbered = with_position(df, keys, order, "_pos", limit)
    if position:
        numbered = numbered.withColumn(position, F.col("_pos"))
    first = F.floor(F.greatest(F.col("_pos") - after, F.lit(0)) / span)
    last = F.floor((F.col("_pos") + before) / span)
    chunked = numbered.withColumn("_chunk", F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    return chunked, window, F.col("_chunk") == F.floor(F.col("_pos") / span)


def drop_layout(df: DataFrame) -> DataFrame:
    """Remove the helper columns of ``bounded_window``."""
    return df.drop("_pos", "_chunk")


def hash_order(*parts: Column | str | int) -> Column:
    """Text that orders rows at random but always alike; equal parts give equal text."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash_number(digest: Column, start: int = 1) -> Column:
    """32-bit integer from eight hexadecimal digits of a digest."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")


TOP_ROWS = 100_000


def last_rows(df: DataFrame, seq: str, n: int, limit: int | None = None) -> DataFrame:
    """The ``n`` rows with the largest unique ``seq``.

    For a small ``n`` each task keeps its own best sequence numbers and only those meet; beyond that
    the rows are numbered block by block.
    """
    if n <= 0:
        return df.limit(0)
    if n <= TOP_ROWS:
        cut = df.select(seq).orderBy(F.desc(seq)).limit(n).agg(F.min(seq))
        return df.where(F.col(seq) >= cut.scalar())
    total = df.count()
    numbered = with_position(df, [], [seq], "_from", limit)
    return numbered.where(F.col("_from") >= total - n).drop("_from")


def late_position(df: DataFrame, order: list[str], out: str = "pos", limit: int | None = None) -> DataFrame:
    """Like ``with_position`` over the whole table, without moving whole rows through a sort.

    Only the order columns, a total order, are numbered; the numbers then meet their rows by a
    shuffle on those columns, which spreads the rows evenly as no two share their key.
    """
    slim = with_position(df.select(*order), [], order, out, limit)
    return join_by(df, slim, order)


def join_by(df: DataFrame, numbers: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``df`` with the other columns of ``numbers``; both are unique in ``order``, nulls included."""
    if set(df.columns) == set(order):
        return numbers.select(*df.columns, *[c for c in numbers.columns if c not in order])
    keys = {c: f"_k{i}" for i, c in enumerate(order)}
    match = F.lit(True)
    for c, k in keys.items():
        match = match & F.col(c).eqNullSafe(F.col(k))
    return df.join(numbers.withColumnsRenamed(keys), match).drop(*keys.values())


def rows_from(df: DataFrame, order: list[str], start: int, stop: int | None = None, limit: int | None = None) -> DataFrame:
    """The rows at positions ``start <= position < stop`` of a total order.

    The order columns alone are searched for the values at the two ends; the rows are then filtered
    where they are, without a shuffle.
    """

    def value_at(n: int) -> Column:
        slim = df.select(F.struct(*order).alias("_o"), *order)
        if n < TOP_ROWS:
            ends = slim.orderBy(*order).limit(n + 1).agg(F.max("_o").alias("_o"), F.count(F.lit(1)).alias("_n"))
            return ends.select(F.when(F.col("_n") > n, F.col("_o"))).scalar()
        return with_position(df.select(*order), [], order, "_at", limit).where(F.col("_at") == n).agg(F.min(F.struct(*order))).scalar()

    if stop is not None and stop <= max(start, 0):
        return df.limit(0)
    here = F.struct(*order)
    kept = df if start <= 0 else df.where(here >= value_at(start))
    # No row at the upper end: the table ends before it.
    return kept if stop is None else kept.where(F.coalesce(here < value_at(stop), F.lit(True)))


def first_rows(df: DataFrame, order: Column | list[Column], n: int, limit: int | None = None) -> DataFrame:
    """The ``n`` rows that come first in a total order."""
    parts = order if isinstance(order, list) else [order]
    names = [f"_o{i}" for i in range(len(parts))]
    ordered = df.withColumns(dict(zip(names, parts)))
    if n <= TOP_ROWS:
        return ordered.orderBy(*names).limit(max(n, 0)).drop(*names)
    numbered = with_position(ordered, [], names, "_from", limit)
    return numbered.where(F.col("_from") < n).drop("_from", *names)

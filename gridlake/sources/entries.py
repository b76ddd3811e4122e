"""Top-level entries of JSON files that are larger than a task.

Spark reads the file in splits, cut after every closing bracket of one kind.  Whether a piece begins inside
a string, and how deep, depends on everything before it; both are running sums over slim rows: the quotes
before it, then the brackets outside strings.  Where a piece ends one level deep, outside a string, an entry
of the file is complete, so the pieces between two such places are put together and parsed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.plans.bounds import broadcast_if_small, cut_lineage
from gridlake.plans.ordered import prefix_sums

PLACE = ["file", "start", "row"]


def read_pieces(spark: SparkSession, path: str, close: str) -> DataFrame:
    """Pieces of files between closing brackets, with their place: ``file, start, row, line``."""
    raw = spark.read.option("lineSep", close).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def _outside(text: Column) -> Column:
    """What is left of a text without its strings; the last one may be open."""
    return F.regexp_replace(text, r'"[^"]*+("|\z)', "")


def _deeper(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    return (F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))).cast("long")


def _scanned(pieces: DataFrame) -> DataFrame:
    """Per piece the quotes that open or close a string, and its brackets if it begins outside or inside one."""
    bare = F.regexp_replace("line", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    return pieces.select(
        *PLACE,
        F.substring(F.regexp_replace("line", r"^[\s\x{FEFF}]+", ""), 1, 1).alias("head"),
        quotes.cast("long").alias("quotes"),
        _deeper(_outside(bare)).alias("if_out"),
        _deeper(_outside(F.concat(F.lit('"'), bare))).alias("if_in"),
    )


def _levels(pieces: DataFrame) -> DataFrame:
    """Per piece its entry, whether it is the last of the file, and whether its closing bracket belongs to it."""
    scanned = cut_lineage(_scanned(pieces))
    quoted = prefix_sums(scanned, ["file"], ["start", "row"], {"before": F.col("quotes")}, inclusive=False)
    inside = F.col("before") % 2 == 1
    open_ = (F.col("before") + F.col("quotes")) % 2 == 1
    chosen = quoted.select(
        *PLACE, "head", open_.alias("open"), F.when(inside, F.col("if_in")).otherwise(F.col("if_out")).alias("delta")
    )
    # The closing bracket that ends a piece counts unless it stands in a string.
    step = F.col("delta") - F.when(F.col("open"), 0).otherwise(1)
    deep = prefix_sums(cut_lineage(chosen), ["file"], ["start", "row"], {"depth": step}, inclusive=False)
    at_close = F.col("depth") + F.col("delta")
    over = ~F.col("open") & (at_close == 0)
    after = at_close - 1
    # Only the first piece begins at level 0; after the end there is nothing but white space.
    first = F.min(F.struct("start", "row"))
    firsts = scanned.groupBy("file").agg(first.alias("first"), F.min_by("head", F.struct("start", "row")).alias("top"))
    judged = cut_lineage(deep.join(broadcast_if_small(firsts), "file")).where(
        (F.col("depth") > 0) | (F.struct("start", "row") == F.col("first"))
    )
    ends = judged.select(
        *PLACE,
        "top",
        (over | (~F.col("open") & (after == 0))).alias("last"),
        (~over).alias("closed"),
        (~F.col("open") & ~over & (after == 1)).cast("long").alias("done"),
    )
    return prefix_sums(ends, ["file"], ["start", "row"], {"entry": F.col("done")}, inclusive=False)


def json_entries(pieces: DataFrame, close: str) -> DataFrame:
    """``file, entry, top, value``: JSON texts that together hold all top-level entries of each file.

    ``pieces(file, start, row, line)`` are the texts between closing brackets ``close``, in the order of
    ``start, row``.  ``top`` is the bracket that the file begins with, and each ``value`` is an object or
    array of that kind with one entry; entries that hold no ``close`` themselves are read with the next one that
    does.  One entry must fit a row, a file need not.  Of a file that breaks off, the whole entries are
    read.  Empty files and empty objects have no entry.
    """
    kept = cut_lineage(pieces.where("line is not null"))
    levels = cut_lineage(_levels(kept))
    joined = kept.join(levels, PLACE)
    text = F.when(F.col("closed"), F.concat("line", F.lit(close))).otherwise(F.regexp_replace("line", r"\s+\z", ""))
    whole = F.when(F.col("last"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    grouped = joined.groupBy("file", "entry").agg(
        F.first("top").alias("top"), F.array_sort(F.collect_list(F.struct("start", "row", whole.alias("t")))).alias("parts")
    )
    body = F.array_join(F.transform("parts", lambda p: p["t"]), "")
    # The first entry follows the bracket of the file, each other one a comma.
    bare = F.regexp_replace(body, r"^[\s\x{FEFF}]*", "")
    rows = grouped.select("file", "entry", "top", F.when(F.col("entry") == 0, F.substring(bare, F.lit(2), F.length(bare))).otherwise(F.regexp_replace(bare, "^,", "")).alias("body"))
    end = F.when(F.col("top") == "{", "}").otherwise("]")
    return rows.where(F.regexp_like("body", F.lit(r"\S"))).select("file", "entry", "top", F.concat("top", "body", end).alias("value"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that hold one JSON array of them; a file with a single object is one record."""
    entries = read_json_entries(spark, path)
    inner = F.substring("value", F.lit(2), F.length("value") - 2)
    single = entries.where("top = '{'").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("entry", inner.alias("t")))).alias("parts"))
    single = single.select(F.concat(F.lit("{"), F.array_join(F.transform("parts", lambda p: p["t"]), ","), F.lit("}")).alias("value"))
    values = entries.where("top = '['").select("value").unionByName(single)
    fields = ", ".join(x.strip().replace(" ", ": ", 1) for x in schema.split(","))
    return values.select(F.inline(F.from_json("value", f"array<struct<{fields}>>")))


def read_json_entries(spark: SparkSession, path: str, close: str = "}") -> DataFrame:
    """Entries of JSON files; ``close`` is the bracket that entries end with."""
    return json_entries(read_pieces(spark, path, close), close)

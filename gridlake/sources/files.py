"""File sources: folders of mixed files, text files, annotated images, and indexed tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.functions import text as X
from gridlake.plans.bounds import broadcast_if_small, cut_lineage
from gridlake.plans.ordered import prefix_sums, rows_per_task, with_position
from gridlake.sources.entries import read_records

# File extensions of each modality.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "bmp"]
STREAMED_IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "webp"]
TEXT_EXTENSIONS = ["txt", "md"]
GRID_EXTENSIONS = ["npy"]
DOCUMENT_EXTENSIONS = ["pdf"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def parent(path: Column) -> Column:
    """Name of the folder a file lies in."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def file_modality(
    path: Column, include_images: bool = True, include_text: bool = True, include_grids: bool = True
) -> Column:
    """Modality by extension; null for unknown or excluded files."""
    ext = extension(path)
    return (
        F.when(ext.isin(IMAGE_EXTENSIONS) & F.lit(include_images), "image")
        .when(ext.isin(TEXT_EXTENSIONS + DOCUMENT_EXTENSIONS) & F.lit(include_text), "text")
        .when(ext.isin(GRID_EXTENSIONS) & F.lit(include_grids), "grid")
    )


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a folder; the content is read only where it is selected."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def file_samples(files: DataFrame, **include: bool) -> DataFrame:
    """Samples of catalogued files: text is decoded, every other payload stays binary."""
    path = F.col("path")
    plain = extension(path).isin(TEXT_EXTENSIONS)
    kept = files.withColumn("modality", file_modality(path, **include)).where(F.col("modality").isNotNull())
    return kept.select(
        path.alias("sample_id"),
        "modality",
        F.when(plain, F.decode("content", "UTF-8")).alias("text"),
        F.when(~plain, F.col("content")).alias("payload"),
        F.create_map(F.lit("source"), path).alias("metadata"),
    )


def image_samples(files: DataFrame) -> DataFrame:
    """Image files, numbered in path order; only their paths are put in order, not their bytes."""
    images = files.where(extension(F.col("path")).isin(STREAMED_IMAGE_EXTENSIONS))
    numbers = with_position(images.select("path"), [], ["path"], "_at")
    return images.join(broadcast_if_small(numbers), "path").select(
        F.concat_ws("_", F.lit("img"), stem(F.col("path")), "_at").alias("sample_id"),
        F.lit("image").alias("modality"),
        F.col("content").alias("payload"),
        F.create_map(F.lit("source"), F.col("path")).alias("metadata"),
    )


# --- text ---------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: ``file, start, row, line``; carriage returns are left in them."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
        F.col("_metadata.file_size").alias("file_size"),
    )


#: Characters of lines that one task puts in order, about.
PLACED_CHARS = 32_000_000


def placed_lines(lines: DataFrame) -> DataFrame:
    """(file, _at, _t): the text of each line with its line end, and its offset in the file in characters.

    Any line end becomes a line feed.
    """
    bytes_ = lines.groupBy("file").agg(
        (F.max("file_size") >= F.sum(F.octet_length("line") + 1)).alias("_ends"),
        F.max(F.struct("start", "row")).alias("_last"),
    )
    joined = lines.join(broadcast_if_small(bytes_), "file")
    # The last line keeps its line end only if the file has one.
    final = F.struct("start", "row") == F.col("_last")
    full = F.when(final & ~F.col("_ends"), F.col("line")).otherwise(F.concat("line", F.lit("\n")))
    texts = joined.select("file", "start", "row", F.regexp_replace(full, "\r\n?", "\n").alias("_t"))
    measured = texts.withColumn("_n", F.length("_t").cast("long"))
    # The texts travel with their offsets, so a task is bounded by their characters as well as by rows.
    rows, chars = measured.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    limit = max(1, min(rows_per_task(lines), rows * PLACED_CHARS // max(1, chars)))
    placed = prefix_sums(measured, ["file"], ["start", "row"], {"_at": F.col("_n")}, inclusive=False, limit=limit)
    return placed.where("_n > 0").select("file", "_at", "_t")


def glued_ranges(pieces: DataFrame, size: int, ahead: int = 0) -> DataFrame:
    """(file, _c, chunk): the characters from ``_c * size`` on, ``size + ahead`` of them, of each file that reaches so far."""
    first = F.floor(F.greatest(F.col("_at") - ahead, F.lit(0)) / size)
    last = F.floor((F.col("_at") + F.length("_t") - 1) / size)
    spread = pieces.select("file", "_at", "_t", F.explode(F.sequence(first, last)).alias("_c"))
    begin = F.greatest(F.col("_c") * size - F.col("_at"), F.lit(0))
    end = F.least((F.col("_c") + 1) * size + ahead - F.col("_at"), F.length("_t").cast("long"))
    part = F.substr("_t", (begin + 1).cast("int"), (end - begin).cast("int"))
    return (
        spread.select("file", "_c", F.struct("_at", part.alias("p")).alias("s"))
        .groupBy("file", "_c")
        .agg(F.array_sort(F.collect_list("s")).alias("_s"))
        .select("file", "_c", F.array_join(F.transform("_s", lambda s: s["p"]), "").alias("chunk"))
    )


def chunk_lines(lines: DataFrame, size: int = 1000) -> DataFrame:
    """Fixed-size character chunks of whole files: ``file, idx, chunk``.

    A file need not fit a task: running sums of the line lengths give each line its offset, lines are
    cut at the chunk borders, and a chunk is put together from at most ``size`` pieces.  Blank chunks
    are dropped before numbering.
    """
    kept = glued_ranges(placed_lines(lines), size).where(F.regexp_replace("chunk", X.SPACE, "") != "")
    return with_position(kept, ["file"], ["_c"], "idx").drop("_c")


#: Characters of a block of a file that is cut at spaces, and blocks whose maps are put together at once.
WORD_BLOCK, FAN = 1_000_000, 64


def _following(text: str, size: int, total: int):
    """The cut after each of an array of cuts, by the last space of every stretch; positions are the block's own."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.arange(len(codes))
    last = np.maximum.accumulate(np.where(codes == 32, at, -1)) if len(codes) else at

    def step(p: np.ndarray) -> np.ndarray:
        space = last[np.minimum(p + size - 1, len(codes) - 1)]
        inside = np.where(space > p, space, np.minimum(p + size, total))
        return np.where(total - p < size, total, inside)

    return step


def _exits(text: str, size: int, block: int, total: int) -> np.ndarray:
    """Where in the next block the first cut lies, for every place of the first cut in this one."""
    step, p = _following(text, size, total), np.arange(size)
    while True:
        inside = np.flatnonzero(p < min(block, total))
        if not len(inside):
            return np.maximum(p - block, 0)
        p[inside] = step(p[inside])


def _pieces(text: str, size: int, block: int, total: int, entry: int) -> list[tuple[int, str]]:
    """The pieces that begin in a block, given the first cut in it."""
    step, p, out = _following(text, size, total), np.array([entry]), []
    while p[0] < min(block, total):
        after = step(p)
        out.append((int(p[0]), text[p[0] : after[0]]))
        p = after
    return out


def block_entries(maps: DataFrame, fan: int = FAN) -> DataFrame:
    """(file, _c, entry): the first cut of each block, from maps(file, _c, exits) of every block.

    The maps of neighbouring blocks are put together to the map of a larger block, level by level, until
    a file has few; from there the entries are handed down again.
    """
    schema = "file string, _c long, exits array<int>"
    levels = [cut_lineage(maps)]
    while (levels[-1].agg(F.max("_c")).first()[0] or 0) >= fan:

        def compose(batch: pd.DataFrame) -> pd.DataFrame:
            batch = batch.sort_values("_c")
            whole = None
            for exits in batch["exits"]:
                whole = np.asarray(exits) if whole is None else np.asarray(exits)[whole]
            return pd.DataFrame({"file": batch["file"].iloc[:1], "_c": [batch["_c"].iloc[0] // fan], "exits": [whole]})

        levels.append(cut_lineage(levels[-1].groupBy("file", F.expr(f"_c div {fan}")).applyInPandas(compose, schema)))

    def hand_down(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("_c")
        at, out = int(batch["entry"].iloc[0]), []
        for exits in batch["exits"]:
            out.append(at)
            at = int(exits[at])
        return batch[["file", "_c"]].assign(entry=out)

    entries = levels[-1].select("file", F.lit(0).cast("long").alias("_g"), F.lit(0).alias("entry")).distinct()
    for level in reversed(levels):
        below = level.withColumn("_g", F.expr(f"_c div {fan}")).join(entries, ["file", "_g"])
        found = below.groupBy("file", "_g").applyInPandas(hand_down, "file string, _c long, entry int")
        entries = cut_lineage(found.withColumnRenamed("_c", "_g"))
    return entries.withColumnRenamed("_g", "_c")


def chunk_words(lines: DataFrame, size: int = 1000, block: int = WORD_BLOCK, fan: int = FAN) -> DataFrame:
    """Pieces of whole files that end before a space, each stripped: ``file, idx, chunk``.

    The pieces are those of ``word_chunks`` over the whole text, of which each cut depends on the one
    before. A file need not fit a task: for each block of it, the first cut of the next block is worked
    out for all ``size`` places that its own first cut may have; these maps are put together, and every
    block is then cut from its true first place on.
    """
    if not 1 < size <= block:
        raise ValueError("pieces have two characters or more and are no longer than a block")
    placed = cut_lineage(placed_lines(lines))
    totals = placed.groupBy("file").agg(F.max(F.col("_at") + F.length("_t")).alias("_total"))
    blocks = glued_ranges(placed, block, size).join(broadcast_if_small(totals), "file")
    blocks = cut_lineage(blocks.select("file", "_c", F.col("chunk").alias("text"), (F.col("_total") - F.col("_c") * block).alias("total")).where("total > 0"))

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_exits(t, size, block, n).astype(np.int32) for t, n in zip(batch["text"], batch["total"].tolist())]
            yield pd.DataFrame({"file": batch["file"].tolist(), "_c": batch["_c"].to_numpy(), "exits": pd.Series(found, dtype=object)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[["text", "total", "entry"]].itertuples(index=False, name=None)
            yield batch[["file", "_c", "entry"]].assign(n=[len(_pieces(text, size, block, total, entry)) for text, total, entry in rows])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, text, total, entry, first in batch[["file", "text", "total", "entry", "first"]].itertuples(index=False, name=None):
                found = _pieces(text, size, block, total, entry)
                if found:
                    yield pd.DataFrame({"file": [file] * len(found), "idx": range(first, first + len(found)), "chunk": [x for _, x in found]})

    maps = blocks.mapInPandas(exits, "file string, _c long, exits array<int>")
    entered = blocks.join(block_entries(maps, fan), ["file", "_c"])
    # Pieces are numbered by their block's count, so none of them has to be moved for it.
    counts = cut_lineage(entered.mapInPandas(count, "file string, _c long, entry int, n long"))
    numbered = prefix_sums(counts, ["file"], ["_c"], {"first": F.col("n")}, inclusive=False).drop("n")
    pieces = blocks.join(numbered, ["file", "_c"]).mapInPandas(cut, "file string, idx long, chunk string")
    return pieces.select("file", "idx", X.strip(F.col("chunk")).alias("chunk"))


def _text_samples(chunks: DataFrame, name: Column) -> DataFrame:
    return chunks.select(
        name.alias("sample_id"),
        F.lit("text").alias("modality"),
        F.col("chunk").alias("text"),
        F.create_map(F.lit("type"), F.lit("text"), F.lit("source"), F.col("file")).alias("metadata"),
    )


def read_text_chunks(spark: SparkSession, path: str, size: int = 1000) -> DataFrame:
    """Samples of ``size`` characters each, ids ``text_{idx}``."""
    chunks = chunk_lines(read_lines(spark, path), size)
    return _text_samples(chunks, F.concat_ws("_", F.lit("text"), "idx"))


def read_word_chunks(spark: SparkSession, path: str, size: int = 1000) -> DataFrame:
    """Samples cut at spaces, ids ``text_{stem}_{idx}``; a file may be larger than a task."""
    chunks = chunk_words(read_lines(spark, path), size)
    return _text_samples(chunks, F.concat_ws("_", F.lit("text"), stem(F.col("file")), "idx"))


# --- annotated images ---------------------------------------------------------------------------


def puzzle_vqa_samples(annotations: DataFrame, files: DataFrame) -> DataFrame:
    """Annotated puzzles whose image exists: ``annotations(id, image, question, answer, concept)``."""
    images = files.select(F.regexp_extract("path", r"/images/(.*)$", 1).alias("image"), F.col("content").alias("payload"))
    return annotations.join(images, "image").select(
        F.concat_ws("_", F.lit("puzzlevqa"), "id").alias("sample_id"),
        F.lit("image").alias("modality"),
        F.coalesce("question", F.lit("")).alias("text"),
        "payload",
        F.col("answer").alias("label"),
        F.create_map(F.lit("concept"), F.col("concept"), F.lit("source"), F.lit("puzzlevqa")).alias("metadata"),
    )


VQA_SCHEMA = "id string, image string, question string, answer string, concept string"
MATH_SCHEMA = "pid string, image string, question string, answer string, subject string, level string"


def read_puzzle_vqa(spark: SparkSession, folder: str) -> DataFrame:
    base = folder.rstrip("/")
    annotations = read_records(spark, f"{base}/annotations.json", VQA_SCHEMA)
    return puzzle_vqa_samples(annotations, catalogue(spark, f"{base}/images"))


def math_vision_samples(problems: DataFrame, files: DataFrame) -> DataFrame:
    """Problems with an embedded image, an image file or none.

    ``problems(pid, image, question, answer, subject, level)``, ``files(name, payload)`` with the
    image path relative to the problem folder.
    """
    embedded = F.startswith("image", F.lit("data:image"))
    decoded = F.expr("try_to_binary(get(split(image, ','), 1), 'base64')")
    named = files.select(F.col("name").alias("image"), F.col("payload").alias("_file"))
    joined = problems.join(named, "image", "left")
    payload = F.when(embedded, decoded).otherwise(F.col("_file"))
    return joined.withColumn("payload", payload).select(
        F.concat_ws("_", F.lit("mathv"), "pid").alias("sample_id"),
        F.when(F.col("payload").isNotNull(), "multimodal").otherwise("text").alias("modality"),
        F.coalesce("question", F.lit("")).alias("text"),
        "payload",
        F.col("answer").alias("label"),
        F.create_map(
            F.lit("subject"), F.col("subject"), F.lit("level"), F.col("level"), F.lit("source"), F.lit("math-v")
        ).alias("metadata"),
    )


def read_math_vision(spark: SparkSession, folder: str) -> DataFrame:
    base = folder.rstrip("/")
    problems = read_records(spark, f"{base}/*.json", MATH_SCHEMA)
    files = catalogue(spark, base)
    inside = F.regexp_extract("path", r"/" + base.rsplit("/", 1)[-1] + r"/(.*)$", 1)
    return math_vision_samples(problems, files.select(inside.alias("name"), F.col("content").alias("payload")))


def raven_samples(files: DataFrame, per_config: int | None = None) -> DataFrame:
    """Panel archives in one folder per configuration, optionally the first few of each."""
    archives = files.where(extension(F.col("path")) == "npz").withColumn("config", parent(F.col("path")))
    if per_config is not None:
        order = Window.partitionBy("config").orderBy("path")
        archives = archives.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_config).drop("_r")
    return archives.select(
        F.concat_ws("_", F.lit("raven"), "config", stem(F.col("path"))).alias("sample_id"),
        F.lit("image").alias("modality"),
        F.col("content").alias("payload"),
        F.create_map(F.lit("config"), F.col("config"), F.lit("source"), F.lit("raven")).alias("metadata"),
    )


# --- generic records ----------------------------------------------------------------------------

# Columns tried for each field, in order.
RECORD_FIELDS = {"text": ["text", "caption", "question"], "image": ["image", "img"], "label": ["label", "answer"]}
STREAMED_RECORD_FIELDS = {
    "text": ["text", "content", "question"],
    "image": ["image"],
    "label": ["label", "answer", "output"],
}


def map_records(df: DataFrame, sample_id: Column, source: str, streamed: bool = False) -> DataFrame:
    """Any table as samples: each field is the first filled one of its candidate columns.

    The eager form skips empty strings and calls everything multimodal; the streamed one takes the
    first column a record has, and calls a record multimodal only if it has an image.
    """
    fields = STREAMED_RECORD_FIELDS if streamed else RECORD_FIELDS

    def pick(field: str) -> Column:
        found = [F.col(c).cast("string") for c in fields[field] if c in df.columns]
        if not streamed:
            found = [X.filled(c) for c in found]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    image = pick("image")
    modality = F.lit("multimodal")
    if streamed:
        modality = F.when(image.isNotNull(), "multimodal").otherwise("text")
    return df.select(
        sample_id.alias("sample_id"),
        modality.alias("modality"),
        pick("text").alias("text"),
        image.alias("image"),
        pick("label").alias("label"),
        F.create_map(F.lit("source"), F.lit(source)).alias("metadata"),
    )


# --- tables by row number -----------------------------------------------------------------------


def with_global_index(df: DataFrame) -> DataFrame:
    """``global_index`` of every row of a Parquet folder: files by name, rows in stored order."""
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    offsets = prefix_sums(counts, [], ["_file"], {"_offset": F.col("_n")}, inclusive=False).drop("_n")
    joined = placed.join(broadcast_if_small(offsets), "_file")
    return joined.withColumn("global_index", F.col("_offset") + F.col("_at")).drop("_file", "_at", "_offset")


def slice_rows(indexed: DataFrame, start: int, stop: int) -> DataFrame:
    return indexed.where(F.col("global_index").between(start, stop - 1))


def gather_rows(indexed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows by index, one per request; ``wanted(pos, global_index)`` keeps the requested order."""
    return wanted.join(indexed, "global_index")


def file_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, offset) of a Parquet folder: rows of each file and the number of its first, files by name.

    No column is read, so the counts come from the footers. The table is small and can be stored beside the files.
    """
    placed = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"))
    counts = cut_lineage(placed.groupBy("file").agg(F.count(F.lit(1)).alias("n")))
    return cut_lineage(prefix_sums(counts, [], ["file"], {"offset": F.col("n")}, inclusive=False))


def locate_rows(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``file`` and ``row``: where the row numbered ``global_index`` is stored; unknown numbers go.

    Numbers and files meet by stretches as long as a file on average, of which there are at most three a file.
    """
    width = F.greatest(F.lit(1), F.ceil(F.coalesce(index.agg(F.avg("n")).scalar(), F.lit(1.0)))).cast("long")
    reach = F.sequence(F.expr("offset div _w"), F.expr("(offset + n - 1) div _w"))
    spans = index.where("n > 0").withColumn("_w", width).select("file", "offset", "n", F.explode(reach).alias("_s"))
    asked = wanted.withColumn("_w", width).withColumn("_s", F.expr("global_index div _w")).drop("_w")
    met = asked.join(broadcast_if_small(spans), "_s").where("global_index >= offset and global_index < offset + n")
    return met.withColumn("row", F.col("global_index") - F.col("offset")).drop("_s", "offset", "n")


def _only_files(spark: SparkSession, path: str, files: DataFrame, most: int) -> DataFrame:
    """The Parquet folder cut to some files; beyond ``most`` of them the whole folder is scanned."""
    whole = spark.read.parquet(path)
    names = [r["file"] for r in files.select("file").distinct().limit(most + 1).collect()]
    if not names:
        return whole.limit(0)
    if len(names) > most:
        return whole
    # File names come encoded as addresses, and paths may hold patterns.
    plain = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(name)) for name in sorted(names)]
    return spark.read.schema(whole.schema).parquet(*plain)


MOST_FILES = 10_000


def read_range(spark: SparkSession, path: str, index: DataFrame, start: int, stop: int, most: int = MOST_FILES) -> DataFrame:
    """Rows ``start`` to ``stop - 1`` with their ``global_index``; only the files that hold them are read."""
    held = cut_lineage(index.where((F.col("offset") < stop) & (F.col("offset") + F.col("n") > start)))
    rows = _only_files(spark, path, held, most)
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("_row"))
    numbered = placed.join(broadcast_if_small(held.select("file", "offset")), "file")
    return slice_rows(numbered.withColumn("global_index", F.col("offset") + F.col("_row")), start, stop).drop("file", "_row", "offset")


def read_wanted(spark: SparkSession, path: str, index: DataFrame, wanted: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """Rows by number, one per request of ``wanted(pos, global_index)``; only the files that hold them are read."""
    located = cut_lineage(locate_rows(index, wanted.select("pos", "global_index")))
    rows = _only_files(spark, path, located, most)
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return broadcast_if_small(located).join(placed, ["file", "row"]).drop("file", "row")

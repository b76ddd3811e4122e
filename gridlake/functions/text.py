"""Text functions; all of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import grid as G
from gridlake.functions.arrays import bound, let, upto
from gridlake.plans.bounds import is_small
from gridlake.plans.ordered import bounded_window, drop_layout

# The characters that count as white space, as in Unicode plus the file separators.
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def words(text: Column) -> Column:
    """Words of a text, empty for a blank one."""
    flat = collapse(text)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def filled(text: Column) -> Column:
    """Null instead of an empty string."""
    return F.when(text != "", text)


# --- cleaning -----------------------------------------------------------------------------------

MAX_TEXT = 10_000  # fixed value: characters kept of a cleaned text


def clean_text(text: Column) -> Column:
    """White space collapsed; longer texts are cut and marked with ``...``."""
    flat = collapse(text)
    return F.when(F.length(flat) > MAX_TEXT, F.concat(F.substring(flat, 1, MAX_TEXT), F.lit("..."))).otherwise(flat)


def preprocess(text: Column, category: Column, difficulty: Column) -> Column:
    """Cleaned text with its category and difficulty, non-empty parts joined by `` | ``."""
    return F.concat_ws(
        " | ",
        filled(clean_text(text)),
        F.concat(F.lit("Category: "), category),
        F.concat(F.lit("Difficulty: "), difficulty),
    )


def crop_tall(g: Column, side: int = G.MAX_SIDE) -> Column:
    """Crop to side x side, but only when there are more than ``side`` rows."""
    return F.when(G.height(g) > side, G.crop(g, 0, 0, side, side)).otherwise(g)


def unified_text(text: Column, image_shape: Column, g: Column) -> Column:
    """Short text of every modality present, joined by `` | ``."""
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Text: "), F.substring(filled(text), 1, 500)),
        F.concat(F.lit("Image: "), image_shape),
        F.concat(F.lit("Grid: "), F.substring(G.to_text(g), 1, 200)),
    )


# Orders in which a sample's modalities are tried.
BUILDER_PRECEDENCE = ("image", "grid", "text")
ENCODER_PRECEDENCE = ("text", "grid", "image")


def primary_modality(precedence: Iterable[str] = BUILDER_PRECEDENCE) -> Column:
    """First modality of the order whose column is filled."""
    out = None
    for name in precedence:
        present = F.col(name).isNotNull()
        if name == "text":
            present = present & (F.col(name) != "")
        out = F.when(present, name) if out is None else out.when(present, name)
    return out


# --- keys ---------------------------------------------------------------------------------------


def cache_key(
    sample_id: Column, has_image: Column, has_grid: Column, text: Column, question: Column, fallback: Column
) -> Column:
    return (
        F.when(has_image, F.concat(F.lit("IMG:"), sample_id))
        .when(has_grid, F.concat(F.lit("GRID:"), sample_id))
        .otherwise(F.coalesce(filled(text), filled(question), fallback))
    )


def content_key(text: Column, width: int = 224, height: int = 224) -> Column:
    return F.sha2(F.concat_ws("_", text, F.lit(str(width)), F.lit(str(height))), 256)


def key_shard(key: Column) -> Column:
    """Two-character prefix under which a key is stored."""
    return F.left(key, F.lit(2))


# --- chunks and slices --------------------------------------------------------------------------


def fixed_chunks(text: Column, size: int = 1000) -> Column:
    """Consecutive pieces of ``size`` characters; blank ones are dropped before numbering."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{size}}})"), 1)
    return F.filter(pieces, lambda p: F.regexp_replace(p, SPACE, "") != "")


def word_chunks(text: Column, size: int = 1000) -> Column:
    """Pieces of at most ``size`` characters that end before a space, each stripped.

    A full piece is cut back to its last space and the next one starts there; a piece with no space
    after its first character stays whole, and the rest of the text is the last piece.  One pass of
    an ordered alternation does what the recurrence asks for, in time linear in the text.
    """
    pattern = rf"(?s)(.{{1,{size - 1}}}\z|.{{1,{size - 1}}}(?= )|.{{1,{size}}})"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), strip)


def even_slices(text: Column, k: int) -> Column:
    """``k`` consecutive word ranges of nearly equal length."""

    def cut(ws: Column) -> Column:
        def part(i: Column) -> Column:
            start = F.floor(i * F.size(ws) / k).cast("int")
            stop = F.floor((i + 1) * F.size(ws) / k).cast("int")
            return F.array_join(F.slice(ws, start + 1, stop - start), " ")

        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), part)

    return let(words(text), cut)


# --- answers and code ---------------------------------------------------------------------------

# Answer patterns in the order they are tried, the last number, and the answer mark.
NUMBER = r"(-?\d+(?:\.\d+)?)"
ANSWER_PATTERNS = [
    rf"(?:answer|result|solution)(?:{SPACE}+is)?(?:{SPACE}|[:=])+" + NUMBER,
    rf"={SPACE}*" + NUMBER,
    rf"therefore(?:{SPACE}|,)+(?:x|y|z|n)?{SPACE}*={SPACE}*" + NUMBER,
    r"\\boxed\{" + NUMBER + r"\}",
]
MARKED_ANSWER = rf"####{SPACE}*" + NUMBER


def _number(text: Column, pattern: str) -> Column:
    return filled(F.regexp_extract(text, pattern, 1)).try_cast("double")


def extract_answer(text: Column) -> Column:
    """Number after an answer phrase, an equals sign or in a box; else the last number."""
    low = F.lower(text)
    every = F.regexp_extract_all(text, F.lit(NUMBER), 1)
    fallback = F.try_element_at(every, F.lit(-1)).try_cast("double")
    return F.coalesce(*[_number(low, p) for p in ANSWER_PATTERNS], fallback)


def extract_marked_answer(text: Column) -> Column:
    """Number after ``####``, else as ``extract_answer``."""
    return F.coalesce(_number(text, MARKED_ANSWER), extract_answer(text))


def answers_equal(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Integral numbers must be equal, others within the tolerance; a null equals nothing."""
    whole = (a == F.floor(a)) & (b == F.floor(b))
    return F.coalesce(
        F.when(whole, a == b).otherwise(F.abs(a - b) <= F.lit(tolerance)), F.lit(False)
    )


# Substrings that mark code.
CODE_MARKERS = [
    "def ", "class ", "import ", "from ",
    "function ", "const ", "let ", "var ",
    "public ", "private ", "void ", "int ",
    "{", "}", ";", "()", "[]",
    "==", "!=", "+=", "->",
]


def code_markers(text: Column) -> Column:
    """Number of markers that occur."""
    total = F.lit(0)
    for marker in CODE_MARKERS:
        total = total + F.contains(text, F.lit(marker)).cast("int")
    return total


def looks_like_code(text: Column) -> Column:
    return code_markers(text) >= 2


def extract_code(text: Column, language: str = "python") -> Column:
    """First fenced block of the language, else the whole text if it looks like a program."""
    fenced = rf"(?s)```{language}\n(.*?)```"
    program = F.contains(text, F.lit("def ")) | F.contains(text, F.lit("import "))
    return (
        F.when(F.regexp_like(text, F.lit(fenced)), strip(F.regexp_extract(text, fenced, 1)))
        .when(program, strip(text))
        .otherwise("")
    )


# --- names --------------------------------------------------------------------------------------


def augmented_name(sample_id: Column, tid: Column) -> Column:
    return F.concat(sample_id, F.lit("_aug"), tid.cast("string"))


def original_name(name: Column) -> Column:
    return F.regexp_replace(name, r"_aug\d+$", "")


def augmentation_id(name: Column) -> Column:
    """Symmetry id at the end of a name, 0 for an original."""
    return F.coalesce(filled(F.regexp_extract(name, r"_aug(\d+)$", 1)).cast("int"), F.lit(0))


def distribution_name(sample_id: Column) -> Column:
    return F.concat(sample_id, F.lit("_distlearn"))


def source_type(path: Column, is_dir: Column, exists: Column) -> Column:
    """Kind of a source, from its path; the first rule that holds decides."""
    low = F.lower(path)

    def has(*parts: str) -> Column:
        out = F.lit(False)
        for part in parts:
            out = out | F.contains(low, F.lit(part))
        return out

    # Rules in the order they are tried.
    return (
        F.when(has("puzzlevqa", "puzzle_vqa"), "puzzlevqa")
        .when(has("math-v", "mathv", "math_vision"), "mathv")
        .when(has("raven") & ~has("craven"), "raven")
        .when(has("arc"), "arc_json")
        .when(has("maze") & F.endswith(low, F.lit(".csv")), "maze_csv")
        .when(has("sudoku"), "sudoku_grid")
        .when(
            F.endswith(low, F.lit(".txt")) | F.endswith(low, F.lit(".md"))
            | has("text", "wikitext", "tinystories"),
            "text_file",
        )
        .when(has("cifar", "imagenet") | is_dir, "image_dir")
        .when(~F.contains(path, F.lit("/")) & ~exists, "hf")
        .otherwise("local")
    )


# Substrings of a dataset name and the short name they stand for, in order.
DATASET_NAMES = [
    (("text-wikitext",), "text"),
    (("text-tinystories", "tinystories"), "text-tiny"),
    (("arc",), "arc"),
    (("code",), "code"),
    (("vision", "cifar", "image"), "vision"),
    (("alpaca",), "alpaca"),
    (("sharegpt",), "sharegpt"),
    (("sudoku",), "sudoku"),
    (("maze",), "maze"),
]


def dataset_name(path: Column) -> Column:
    """Short name of a dataset from the last part of its path."""
    base = F.element_at(F.split(path, "/"), -1)
    out = None
    for parts, name in DATASET_NAMES:
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(base, F.lit(part))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.regexp_replace(base, "[/-]", "_"))


# --- prompts and decoding -----------------------------------------------------------------------

DEFAULT_SYSTEM = "You are a helpful AI assistant."  # fixed value


def prompts(
    messages: DataFrame, system: str = DEFAULT_SYSTEM, history: int = 5, limit: int | None = None
) -> DataFrame:
    """Prompt of every user message: system line, the last messages before it, the message itself.

    ``messages(conv_id, turn, role, text)``.  A conversation too long for one task is cut into
    chunks whose first ``history`` messages are copied from the chunk before.
    """
    src, window, core = bounded_window(messages, ["conv_id"], ["turn"], before=history, limit=limit)
    line = F.concat(
        F.upper(F.left("role", F.lit(1))),
        F.lower(F.substr("role", F.lit(2))),
        F.lit(": "),
        F.col("text"),
        F.lit("\n"),
    )
    past = F.array_join(F.collect_list(line).over(window.rowsBetween(-history, -1)), "")
    framed = src.withColumn("_past", past).where(core & (F.col("role") == "user"))
    prompt = F.concat(
        F.lit(f"System: {system}\n"), F.col("_past"), F.lit("User: "), F.col("text"), F.lit("\nAssistant:")
    )
    return drop_layout(framed.withColumn("prompt", prompt)).select("conv_id", "turn", "prompt")


# Control symbols by their offset from the number of concepts.
CONTROL = {"EXPAND": 0, "STOP": 1, "MERGE": 2, "THOUGHT": 3, "END_THOUGHT": 4}


# Two noncharacters stand for a space token and a merge while a text is put together.
_GAP, _MERGE = "\ufdd0", "\ufdd1"


def _emission(code: Column, expand: Column, tokens: Column, text: Column, concept: Column, shown: bool) -> Column:
    """What one position adds to the text, spaces and merges marked; ``code`` is null for a concept."""
    def spell(token: Column) -> Column:
        return F.when(token == " ", _GAP).otherwise(token)

    marks = (
        F.when(code == CONTROL["MERGE"], _MERGE)
        .when((code == CONTROL["THOUGHT"]) & F.lit(shown), "<THOUGHT>")
        .when((code == CONTROL["END_THOUGHT"]) & F.lit(shown), "<END_THOUGHT>")
        .otherwise("")
    )
    expanded = F.coalesce(F.array_join(F.transform(tokens, spell), ""), F.lit(""))
    plain = F.coalesce(text, F.concat(F.lit("<C"), concept.cast("string"), F.lit(">")))
    return F.when(code.isNotNull(), marks).when(expand != 0, expanded).otherwise(spell(plain))


@bound
def _settle_merges(marked: Column) -> Column:
    """A merge takes back the space before it: matching pairs vanish from the inside out."""
    runs = F.regexp_extract_all(marked, F.lit(f"({_GAP}+)"), 1)
    depth = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    settled = F.aggregate(
        upto(depth), marked, lambda acc, _: F.replace(acc, F.lit(_GAP + _MERGE), F.lit(""))
    )
    return F.replace(F.replace(settled, F.lit(_MERGE), F.lit("")), F.lit(_GAP), F.lit(" "))


def decode_concepts(
    sequences: DataFrame, concepts: DataFrame, num_concepts: int, show_thoughts: bool = True
) -> DataFrame:
    """Text of every concept sequence.

    ``sequences(seq_id, concept_ids, control, expand)`` with one entry per position, and
    ``concepts(concept_id, tokens, text)``.  STOP ends the sequence, MERGE takes back one space
    token, thought marks are shown on request, an expanded concept emits its tokens and any other
    one its text or ``<C{id}>``.

    A concept table of a size that was checked is turned into one array by id and looked up inside
    the row; a larger one is joined position by position.
    """
    n = num_concepts
    stop = F.array_position(
        F.zip_with("concept_ids", "control", lambda c, x: (x != 0) & (c == n + CONTROL["STOP"])), F.lit(True)
    )
    steps = F.arrays_zip("concept_ids", "control", "expand")
    live = F.when(stop > 0, F.slice(steps, F.lit(1), (stop - 1).cast("int"))).otherwise(steps)
    cut = sequences.select("seq_id", live.alias("steps"))
    if is_small(concepts):
        entry = F.struct("tokens", "text")
        by_id = F.map_from_entries(F.collect_list(F.struct("concept_id", entry)))
        book = concepts.where(F.col("concept_id").between(0, n - 1)).agg(by_id.alias("_map")).select(
            F.transform(upto(F.lit(n)), lambda i: F.try_element_at("_map", i))
        )

        def emit(s: Column) -> Column:
            def look_up(e: Column) -> Column:
                code = F.when(s["control"] != 0, s["concept_ids"] - n)
                return _emission(code, s["expand"], e["tokens"], e["text"], s["concept_ids"], show_thoughts)

            return let(F.get("_book", s["concept_ids"]), look_up)

        marked = F.array_join(F.transform("steps", emit), "")
        joined = cut.withColumn("_book", book.scalar())
        return joined.select("seq_id", _settle_merges(marked).alias("text"))
    rows = cut.select("seq_id", F.posexplode_outer("steps").alias("pos", "s"))
    named = rows.withColumn("concept_id", F.col("s.concept_ids")).join(concepts, "concept_id", "left")
    code = F.when(F.col("s.control") != 0, F.col("concept_id") - n)
    piece = _emission(code, F.col("s.expand"), F.col("tokens"), F.col("text"), F.col("concept_id"), show_thoughts)
    # A sequence came from one row, so its pieces fit one group again.
    glued = named.groupBy("seq_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce(piece, F.lit("")).alias("p")))).alias("_p")
    )
    marked = F.array_join(F.transform("_p", lambda s: s["p"]), "")
    return glued.select("seq_id", _settle_merges(marked).alias("text"))


def cut_at_stop(df: DataFrame, keys: list[str], pos: str, is_stop: Column) -> DataFrame:
    """Drop every row of a key at or after its first stop position.

    The stops, one row per key, are the hashed side: the rows stream past them and are never sorted.
    """
    stops = df.where(is_stop).groupBy(*keys).agg(F.min(pos).alias("_stop"))
    joined = df.join(stops.hint("shuffle_hash"), keys, "left")
    return joined.where(F.col("_stop").isNull() | (F.col(pos) < F.col("_stop"))).drop("_stop")


# --- maps as JSON -------------------------------------------------------------------------------


def metadata_to_json(metadata: Column) -> Column:
    return F.to_json(metadata)


def metadata_from_json(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def expansions_to_json(expansions: Column, texts: Column) -> Column:
    """JSON of ``{expansions: {id: tokens}, texts: {id: text}}``; JSON keys are texts."""
    def named(m: Column) -> Column:
        return F.transform_keys(m, lambda k, _: k.cast("string"))

    return F.to_json(F.struct(named(expansions).alias("expansions"), named(texts).alias("texts")))


def expansions_from_json(text: Column) -> Column:
    """Inverse of ``expansions_to_json``, with integer keys again."""
    raw = F.from_json(text, "expansions map<string,array<int>>, texts map<string,string>")

    def numbered(m: Column) -> Column:
        return F.transform_keys(m, lambda k, _: k.cast("int"))

    return F.struct(numbered(raw["expansions"]).alias("expansions"), numbered(raw["texts"]).alias("texts"))

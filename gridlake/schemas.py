"""Schemas of the tables the operators exchange."""

from pyspark.sql import types as T

GRID = T.ArrayType(T.ArrayType(T.IntegerType()))

# A cell of a grid object, and an uncoloured location.
CELL = T.StructType(
    [
        T.StructField("v", T.IntegerType()),
        T.StructField("r", T.IntegerType()),
        T.StructField("c", T.IntegerType()),
    ]
)
LOC = T.StructType([T.StructField("r", T.IntegerType()), T.StructField("c", T.IntegerType())])
OBJECT = T.ArrayType(CELL)
OBJECTS = T.ArrayType(OBJECT)

IMAGE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("h", T.IntegerType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)

# The union-typed label: at most one field is set.
LABEL = T.StructType(
    [
        T.StructField("s", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("grid", GRID),
    ]
)

SAMPLE = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("image", IMAGE),
        T.StructField("grid", GRID),
        T.StructField("label", LABEL),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

MODALITIES = ("text", "image", "maze", "grid", "multimodal")

PAIR = T.StructType([T.StructField("input", GRID), T.StructField("output", GRID)])
PUZZLE = T.StructType(
    [T.StructField("train", T.ArrayType(PAIR)), T.StructField("test", T.ArrayType(PAIR))]
)
PUZZLE_FILE = T.MapType(T.StringType(), PUZZLE)
SOLUTION_FILE = T.MapType(T.StringType(), T.ArrayType(GRID))

TRANSITION = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("state", T.ArrayType(T.FloatType())),
        T.StructField("action", T.IntegerType()),
        T.StructField("reward", T.DoubleType()),
        T.StructField("next_state", T.ArrayType(T.FloatType())),
        T.StructField("done", T.BooleanType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("td_error", T.DoubleType()),
        T.StructField("priority", T.DoubleType()),
    ]
)

DATASET_METADATA = T.StructType(
    [
        T.StructField("pad_id", T.IntegerType()),
        T.StructField("ignore_label_id", T.IntegerType()),
        T.StructField("blank_identifier_id", T.IntegerType()),
        T.StructField("vocab_size", T.IntegerType()),
        T.StructField("seq_len", T.IntegerType()),
        T.StructField("num_puzzle_identifiers", T.LongType()),
        T.StructField("total_groups", T.LongType()),
        T.StructField("mean_puzzle_examples", T.DoubleType()),
        T.StructField("total_puzzles", T.LongType()),
        T.StructField("sets", T.ArrayType(T.StringType())),
    ]
)

# Fixed value: marks a label position that takes no part in any metric.
IGNORE_LABEL_ID = -100

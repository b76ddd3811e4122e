import random

import pytest
from pyspark.sql import functions as F

from gridlake.functions import text as X


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, t string")


def run(df, expr):
    return [r[1] for r in df.select("id", expr).orderBy("id").collect()]


def test_collapse_equals_split(spark):
    cases = ["", "  ", " a\t b\n\nc ", "x y　z ", "\x1c a \x1f", "é  è"]
    assert run(texts(spark, *cases), X.collapse(F.col("t"))) == [" ".join(c.split()) for c in cases]
    assert run(texts(spark, *cases), X.strip(F.col("t"))) == [c.strip() for c in cases]


def test_clean_cut(spark):
    got = run(texts(spark, "a" * 10_000, "a" * 10_001), F.length(X.clean_text(F.col("t"))))
    assert got == [10_000, 10_003]


def word_safe(text, size):
    out, at = [], 0
    while at < len(text):
        piece = text[at : at + size]
        cut = piece.rfind(" ")
        if len(piece) == size and cut > 0:
            piece = piece[:cut]
        out.append(piece.strip())
        at += len(piece)
    return out


@pytest.mark.parametrize("size", [7, 50])
def test_chunks_equal_loops(spark, size):
    rng = random.Random(4)
    cases = ["", " ", "x" * 200, " " * 120, "word " * 60, "a\nb é" * 30]
    cases += ["".join(rng.choice("ab é\n ") for _ in range(rng.randrange(400))) for _ in range(60)]
    df = texts(spark, *cases)
    assert run(df, X.word_chunks(F.col("t"), size)) == [word_safe(c, size) for c in cases]
    fixed = [[c[i : i + size] for i in range(0, len(c), size) if c[i : i + size].strip()] for c in cases]
    assert run(df, X.fixed_chunks(F.col("t"), size)) == fixed


def test_even_slices(spark):
    cases = ["", "a", "a b c d e", "a b c d e f g h i"]
    want = []
    for c in cases:
        w = c.split()
        want.append([" ".join(w[k * len(w) // 4 : (k + 1) * len(w) // 4]) for k in range(4)])
    assert run(texts(spark, *cases), X.even_slices(F.col("t"), 4)) == want


def test_answers(spark):
    cases = {
        "The answer is 42.": 42.0,
        "Result: -3.5 and more": -3.5,
        "so x = 7, then 9": 7.0,
        "therefore, y =12": 12.0,
        r"we get \boxed{7}": 7.0,
        "1 then 2 then -3": -3.0,
        "nothing": None,
        "": None,
        "SOLUTION 8": 8.0,
    }
    assert run(texts(spark, *cases), X.extract_answer(F.col("t"))) == list(cases.values())
    marked = {"####  -3.50": -3.5, "answer is 4 #### 5": 5.0, "answer is 4": 4.0}
    assert run(texts(spark, *marked), X.extract_marked_answer(F.col("t"))) == list(marked.values())


def test_answer_equality(spark):
    rows = spark.createDataFrame(
        [(0, 3.0, 3.0), (1, 3.0, 4.0), (2, 3.005, 3.0), (3, 3.02, 3.0), (4, None, 3.0), (5, None, None)], "id long, a double, b double"
    )
    assert run(rows, X.answers_equal(F.col("a"), F.col("b"))) == [True, False, True, False, False, False]


def test_code(spark):
    cases = ["x ```python\nprint(1)\n``` y", "import os", " def f(): ", "plain", "```python no newline```"]
    assert run(texts(spark, *cases), X.extract_code(F.col("t"))) == ["print(1)", "import os", "def f():", "", ""]
    marks = ["a { b ;", "only {", "def class "]
    assert run(texts(spark, *marks), X.looks_like_code(F.col("t"))) == [True, False, True]


def decode(spark, ids, control, expand, concepts, n, **options):
    seqs = spark.createDataFrame([(1, ids, control, expand)], "seq_id long, concept_ids array<int>, control array<int>, expand array<int>")
    table = spark.createDataFrame(concepts, "concept_id int, tokens array<string>, text string")
    return X.decode_concepts(seqs, table, n, **options).first()["text"]


WORDS = [(0, ["he", " "], "hello"), (1, [" ", " "], "world"), (2, None, " ")]


@pytest.mark.parametrize("limit", ["1", "1000"])
def test_decoding(spark, limit):
    spark.conf.set("gridlake.broadcast.maxRows", limit)
    try:
        none = [0, 0, 0, 0, 0]
        ids, control = [0, 13, 1, 14, 0], [0, 1, 0, 1, 0]
        assert decode(spark, ids, control, none, WORDS, 10) == "hello<THOUGHT>world<END_THOUGHT>hello"
        assert decode(spark, ids, control, none, WORDS, 10, show_thoughts=False) == "helloworldhello"
        assert decode(spark, [0, 11, 1], [0, 1, 0], [0, 0, 0], WORDS, 10) == "hello"
        assert decode(spark, [11, 1], [1, 0], [0, 0], WORDS, 10) == ""
        assert decode(spark, [5, 0], [0, 0], [0, 0], WORDS, 10) == "<C5>hello"
        # expansion, a merge that takes a space back, one with nothing to take, and nested ones
        assert decode(spark, [0, 12, 12, 0], [0, 1, 1, 0], [1, 0, 0, 0], WORDS, 10) == "hehello"
        assert decode(spark, [0, 1, 12, 12, 12, 12, 0], [0, 0, 1, 1, 1, 1, 0], [0, 1, 0, 0, 0, 0, 0], WORDS, 10) == "hellohello"
        assert decode(spark, [1, 12, 2, 12, 0], [0, 1, 0, 1, 0], [1, 0, 0, 0, 0], WORDS, 10) == " hello"
    finally:
        spark.conf.unset("gridlake.broadcast.maxRows")


def test_prompt(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r.prompt for r in X.prompts(df, "Sys", limit=3).collect()}
    assert got[0] == "System: Sys\nUser: m0\nAssistant:"
    assert got[8].startswith("System: Sys\nAssistant: m3\nUser: m4\n")
    assert got[8].endswith("Assistant: m7\nUser: m8\nAssistant:")
    assert set(got) == {0, 2, 4, 6, 8}


def test_names(spark):
    names = ["p_aug3", "p", "q_aug12"]
    df = texts(spark, *names)
    assert run(df, X.original_name(F.col("t"))) == ["p", "p", "q"]
    assert run(df, X.augmentation_id(F.col("t"))) == [3, 0, 12]


def test_cut_at_stop(spark):
    rows = [("a", 0, False), ("a", 1, True), ("a", 2, False), ("b", 0, False)]
    df = spark.createDataFrame(rows, "k string, pos int, stop boolean")
    kept = X.cut_at_stop(df, ["k"], "pos", F.col("stop"))
    assert sorted((r.k, r.pos) for r in kept.collect()) == [("a", 0), ("b", 0)]


def test_cut_at_stop_does_not_sort_the_rows(spark):
    df = spark.range(1000).selectExpr("id % 10 as k", "id as pos", "id % 90 = 77 as stop").localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = X.cut_at_stop(df, ["k"], "pos", F.col("stop"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        got = {(r.k, r.pos) for r in kept.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first = {}
    for i in range(1000):
        if i % 90 == 77:
            first.setdefault(i % 10, i)
    assert got == {(i % 10, i) for i in range(1000) if i < first.get(i % 10, 1000)}
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan

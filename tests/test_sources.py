import base64
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gridlake.functions import grid as G
from gridlake.functions import text as X
from gridlake.operators import manifest as M
from gridlake.plans import build as B
from gridlake.plans import registry as P
from gridlake.sources import conversations as C
from gridlake.sources import entries as J
from gridlake.sources import files as L
from gridlake.sources import puzzles as Z
from gridlake.sources import registry as R
from gridlake.sources import sinks


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_puzzle_json(spark, tmp_path):
    doc = {"p1": {"train": [{"input": [[1, 2]], "output": [[3]]}], "test": [{"input": [[4]]}]}, "p2": {"train": []}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    out = Z.read_puzzle_json(spark, str(tmp_path / "a.json"), "kind")
    got = rows(out, "sample_id", G.to_text(F.col("grid")), G.to_text(F.col("label.grid")), "metadata.type")
    assert got == [("p1_test_0", "4", "4", "kind"), ("p1_train_0", "1 2", "3", "kind")]


HARD = ['plain', 'a "quoted" }', '}}]],[[{{', 'ends in a backslash \\', '\\"} {"x": [1]}', '\n\t},', 'ü€😀}', '', '\\\\"']


def hard_entries(n):
    r = random.Random(n)
    value = lambda: {r.choice(HARD) + str(i): r.choice([HARD, {}, [], [[1, [2]]], {"k": {"]": "}"}}, None, 1.5]) for i in range(r.randrange(4))}
    return [value() for _ in range(n)]


@pytest.mark.parametrize("split", ["40", "1m"])
@pytest.mark.parametrize("tight", [True, False])
def test_json_file_in_many_splits(spark, tmp_path, split, tight, small_tasks):
    """Brackets, quotes and escapes inside strings, entries across splits, and whatever white space."""
    layout = {"separators": (",", ":")} if tight else {"indent": 2}
    items = hard_entries(40)
    named = {f'{i} "}}{{': x for i, x in enumerate(items)}
    texts = {"array": items, "object": named, "grids": {str(i): [[[i, 1], [2]]] * (i % 3) for i in range(30)}, "mixed": [1, "}", {"a": 1}, [2], None, {}], "none": {}, "list": []}
    for name, content in texts.items():
        text = json.dumps(content, ensure_ascii=False, **layout)
        (tmp_path / f"{name}.json").write_text(text if tight else f"\n {text}\n\n", encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        for close in "}]":
            if split == "40" and close == "}":
                assert J.read_pieces(spark, str(tmp_path / "object.json"), close).rdd.getNumPartitions() > 20
            found = J.read_json_entries(spark, str(tmp_path), close).orderBy("file", "entry").collect()
            for name, content in texts.items():
                values = [json.loads(r.value) for r in found if r.file.endswith(f"/{name}.json")]
                if isinstance(content, list):
                    assert [x for v in values for x in v] == content
                else:
                    assert [x for v in values for x in v.items()] == list(content.items())
                if (name, close) in {("object", "}"), ("array", "}")}:
                    assert len(values) == len(content)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_of_arrays_and_of_single_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "x": {"y": {}}, "q": "}"}, {"id": 2}, {"x": [], "q": "]"}]))
    (tmp_path / "b.json").write_text(json.dumps({"x": {"y": {}}, "id": 3, "z": {}, "q": "{"}))
    out = J.read_records(spark, str(tmp_path), "id string, q string")
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [("1", "}"), ("2", None), (None, "]"), ("3", "{")]))


def test_json_file_that_breaks_off(spark, tmp_path):
    (tmp_path / "cut.json").write_text('{"a": {"x": "}"}, "b": {"x": 1}, "c": {"x": ')
    values = [r.value for r in J.read_json_entries(spark, str(tmp_path / "cut.json")).orderBy("entry").collect()]
    assert [json.loads(v) for v in values[:2]] == [{"a": {"x": "}"}}, {"b": {"x": 1}}]


def challenge_folder(tmp_path, kind="training"):
    ch = {"t": {"train": [{"input": [[1]], "output": [[2]]}], "test": [{"input": [[3]]}, {"input": [[5]]}]}, "lost": {"train": [], "test": []}}
    so = {"t": [[[4]], [[6]]], "other": [[[9]]]}
    (tmp_path / f"arc-agi_{kind}_challenges.json").write_text(json.dumps(ch))
    (tmp_path / f"arc-agi_{kind}_solutions.json").write_text(json.dumps(so))


@pytest.mark.parametrize("kind", ["training", "evaluation"])
def test_challenges_join_solutions_by_ordinal(spark, tmp_path, kind):
    challenge_folder(tmp_path, kind)
    out = Z.read_challenges(spark, str(tmp_path))
    got = rows(out, "sample_id", G.to_text(F.col("grid")), G.to_text(F.col("label.grid")), "metadata.split")
    assert got == [("t_test_0", "3", "4", "test"), ("t_test_1", "5", "6", "test"), ("t_train_0", "1", "2", "train")]


def test_csv_sources_number_their_rows(spark, tmp_path):
    lines = ["source,grid,solution"] + [f"s{i},{'#' * 3}{i},...." for i in range(9)] + ["short,row"]
    (tmp_path / "maze.csv").write_text("\n".join(lines))
    out = Z.read_maze_csv(spark, str(tmp_path / "maze.csv"))
    got = {r.sample_id: r.grid for r in out.collect()}
    assert len(got) == 9 and got["maze_4"] == [[35, 35], [35, 52]]
    quiz, solution = "0" * 80 + "1", "123456789" * 9
    (tmp_path / "sudoku.csv").write_text(f"quiz,solution\n{quiz},{solution}\n{quiz},{solution}\n")
    out = Z.read_sudoku_csv(spark, str(tmp_path / "sudoku.csv"))
    assert [r.sample_id for r in out.orderBy("sample_id").collect()] == ["sudoku_0", "sudoku_1"]
    assert out.first().grid[8][8] == 1 and out.first().label.grid[0] == list(range(1, 10))


@pytest.mark.parametrize("end", ["", "\n"])
@pytest.mark.parametrize("split", [None, "64"])
def test_text_chunks_of_a_split_file(spark, tmp_path, end, split, small_tasks):
    rng = random.Random(6)
    text = "\n".join("".join(rng.choice("abé  ") for _ in range(rng.randrange(90))) for _ in range(60))
    text += "\n" * 120 + "tail" + end
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        out = L.read_text_chunks(spark, str(tmp_path / "a.txt"), 50)
        got = {int(r.sample_id.split("_")[1]): r.text for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [text[i : i + 50] for i in range(0, len(text), 50) if text[i : i + 50].strip()]
    assert [got[i] for i in range(len(got))] == want


def test_word_chunks_file(spark, tmp_path):
    (tmp_path / "book.txt").write_bytes("This is a test sample.\r\nAnother line.".encode())
    got = rows(L.read_word_chunks(spark, str(tmp_path / "book.txt")), "sample_id", "text")
    assert got == [("text_book_0", "This is a test sample.\nAnother line.")]


WORDY = ["", "x", " ", "no_space_at_all" * 40, " " * 90, "a b " * 120, "ab\r\ncd\ref  " * 30, "end \n"]


@pytest.mark.parametrize("end", ["", "\n", "\r", "\r\n"])
@pytest.mark.parametrize("block, fan, split", [(64, 3, "64"), (20, 2, "50"), (1000, 64, None)])
def test_word_chunks_of_a_file_in_blocks(spark, tmp_path, end, block, fan, split):
    rng = random.Random(block)
    texts = WORDY + ["".join(rng.choice("abé🙂   \n\r") * rng.randrange(1, 12) for _ in range(160))]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes((text + end).encode())
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {(r.file.rsplit("/", 1)[1], r.idx): r.chunk for r in L.chunk_words(L.read_lines(spark, str(tmp_path)), 20, block, fan).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = spark.createDataFrame([(f"{i}.txt", re.sub("\r\n?", "\n", t + end)) for i, t in enumerate(texts)], "file string, text string")
    want = whole.select("file", F.posexplode(X.word_chunks(F.col("text"), 20)).alias("idx", "chunk")).collect()
    assert got == {(r.file, r.idx): r.chunk for r in want}


def test_word_chunks_bound_tasks_by_characters(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    lines = ["".join(rng.choice("ab ") for _ in range(rng.randrange(400))) for _ in range(300)]
    (tmp_path / "long.txt").write_text("\n".join(lines))
    calls = []
    real = L.prefix_sums

    def watched(df, *args, **named):
        calls.append((set(df.columns), named.get("limit")))
        return real(df, *args, **named)

    monkeypatch.setattr(L, "prefix_sums", watched)
    monkeypatch.setattr(L, "with_position", lambda *args, **named: pytest.fail("pieces put in order with their texts"))
    monkeypatch.setattr(L, "PLACED_CHARS", 5000, raising=False)
    got = {r.idx: r.chunk for r in L.chunk_words(L.read_lines(spark, str(tmp_path)), 100, 2000).collect()}
    whole = spark.createDataFrame([("\n".join(lines),)], "text string")
    want = whole.select(F.posexplode(X.word_chunks(F.col("text"), 100)).alias("idx", "chunk")).collect()
    assert got == {r.idx: r.chunk for r in want}
    chars = sum(map(len, lines))
    texts = [limit for columns, limit in calls if "_t" in columns]
    assert len(texts) == 1 and texts[0] * chars / len(lines) <= 5000
    assert not [columns for columns, _ in calls if columns & {"text", "chunk"}]


def test_folder_catalogue(spark, tmp_path):
    for name in ("a.PNG", "b.txt", "sub/c.md", "d.npy", "e.webp", "f.pdf", "g.zip"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"hello")
    files = L.catalogue(spark, str(tmp_path))
    out = L.file_samples(files)
    got = {r.sample_id.rsplit("/", 1)[1]: (r.modality, r.text, r.payload is not None) for r in out.collect()}
    assert got == {
        "a.PNG": ("image", None, True), "b.txt": ("text", "hello", False), "c.md": ("text", "hello", False),
        "d.npy": ("grid", None, True), "f.pdf": ("text", None, True),
    }
    assert L.file_samples(files, include_images=False, include_text=False).count() == 1
    images = rows(L.image_samples(files), "sample_id")
    assert images == [("img_a_0",), ("img_e_1",)]
    names_only = files.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in names_only


def test_puzzle_vqa_drops_rows_without_image(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "1.png").write_bytes(b"img")
    items = [{"id": 1, "image": "1.png", "question": "q", "answer": "a", "concept": "c"}, {"id": 2, "image": "2.png"}]
    (tmp_path / "annotations.json").write_text(json.dumps(items))
    got = rows(L.read_puzzle_vqa(spark, str(tmp_path)), "sample_id", "text", "label", "metadata.concept")
    assert got == [("puzzlevqa_1", "q", "a", "c")]


def test_math_vision_images(spark, tmp_path):
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics" / "3.png").write_bytes(b"file")
    inline = "data:image/png;base64," + base64.b64encode(b"inline").decode()
    items = [
        {"pid": 1, "image": inline, "question": "q1"}, {"pid": 2, "image": "pics/none.png"}, {"pid": 3, "image": "pics/3.png"},
        {"pid": 4, "question": "q4"}, {"pid": 5, "image": "data:image/png;base64,%%%"},
    ]
    (tmp_path / "test.json").write_text(json.dumps(items))
    out = L.read_math_vision(spark, str(tmp_path))
    got = {r.sample_id: (r.modality, bytes(r.payload) if r.payload else None) for r in out.collect()}
    assert got == {
        "mathv_1": ("multimodal", b"inline"), "mathv_2": ("text", None), "mathv_3": ("multimodal", b"file"),
        "mathv_4": ("text", None), "mathv_5": ("text", None),
    }


def test_raven_cap(spark):
    files = spark.createDataFrame([(f"/r/c{i % 2}/{i}.npz", bytearray(b"x")) for i in range(10)], "path string, content binary")
    assert L.raven_samples(files).count() == 10
    got = rows(L.raven_samples(files, per_config=2), "sample_id")
    assert got == [("raven_c0_0",), ("raven_c0_2",), ("raven_c1_1",), ("raven_c1_3",)]


def test_indexed_table(spark, tmp_path):
    for part in range(3):
        spark.range(part * 10, part * 10 + 4 + part).coalesce(1).write.parquet(str(tmp_path / f"in{part}"))
    names = []
    for part in range(3):
        source = next((tmp_path / f"in{part}").glob("*.parquet"))
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / "t" / f"f{part}.parquet").write_bytes(source.read_bytes())
        names += list(range(part * 10, part * 10 + 4 + part))
    indexed = L.with_global_index(spark.read.parquet(str(tmp_path / "t")).select("id", "_metadata")).drop("_metadata")
    assert [r.id for r in indexed.orderBy("global_index").collect()] == names
    assert rows(L.slice_rows(indexed, 3, 6), "id") == [(3,), (10,), (11,)]
    wanted = spark.createDataFrame([(0, 14), (1, 0), (2, 14)], "pos int, global_index long")
    assert [r.id for r in L.gather_rows(indexed, wanted).orderBy("pos").collect()] == [25, 0, 25]


@pytest.mark.parametrize("most", [100, 1])
def test_lookup_reads_only_its_files(spark, tmp_path, most, small_tasks):
    """Files of very different sizes, names with blanks and patterns; equal to numbering the whole folder."""
    (tmp_path / "t").mkdir()
    for part, n in enumerate([4, 0, 30, 1, 1, 9]):
        spark.range(part * 100, part * 100 + n).coalesce(1).write.parquet(str(tmp_path / f"in{part}"))
        for source in (tmp_path / f"in{part}").glob("*.parquet"):
            (tmp_path / "t" / f"f {part} [a]{{x}}%.parquet").write_bytes(source.read_bytes())
    path = str(tmp_path / "t")
    index = L.file_index(spark, path)
    everything = {r.global_index: r.id for r in L.with_global_index(spark.read.parquet(path).select("id", "_metadata")).collect()}
    assert len(everything) == 45
    for start, stop in [(0, 45), (3, 5), (34, 36), (44, 90), (45, 50), (7, 7)]:
        got = L.read_range(spark, path, index, start, stop, most)
        assert {r.global_index: r.id for r in got.collect()} == {k: v for k, v in everything.items() if start <= k < stop}
    asked = [(0, 34), (1, 0), (2, 34), (3, 44), (4, 99), (5, 33)]
    wanted = spark.createDataFrame(asked, "pos int, global_index long")
    got = L.read_wanted(spark, path, index, wanted, most)
    assert {r.pos: r.id for r in got.collect()} == {p: everything[i] for p, i in asked if i in everything}
    near = L.read_range(spark, path, index, 5, 6, most)
    assert len(near.inputFiles()) == 1
    assert L.read_wanted(spark, path, index, wanted.limit(0), most).count() == 0


def test_record_mapping(spark):
    df = spark.createDataFrame([("", "cap", None, "7"), ("t", "cap", "i", None)], "text string, caption string, img string, answer string")
    got = rows(L.map_records(df, F.lit("x"), "src"), "modality", "text", "image", "label")
    assert got == [("multimodal", "cap", None, "7"), ("multimodal", "t", "i", None)] or got[0][1] == "cap"
    streamed = L.map_records(df, F.lit("x"), "src", streamed=True).collect()
    assert [r.text for r in streamed] == ["", "t"] and all(r.modality == "text" for r in streamed)


def test_conversation_parts(spark):
    msgs = [(1, i, "user", f"m{i}") for i in range(7)] + [(2, 5, "system", 'quote "x"')]
    df = spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string")
    docs = C.export_conversations(df, part_messages=3)
    assert docs.count() == 4 and json.loads(docs.where("conv_id = 2").first().document)["conversation"][0]["content"] == 'quote "x"'
    back = C.import_conversations(docs, part_messages=3)
    assert rows(back, "conv_id", "turn", "text") == [(1, i, f"m{i}") for i in range(7)] + [(2, 0, 'quote "x"')]


def test_integrity(spark):
    content = b"abc"
    sha = hashlib.sha256(content).hexdigest()
    files = spark.createDataFrame([(n, 3, bytearray(content)) for n in "abcde"], "path string, length long, content binary")
    manifest = [("a", sha, 3), ("b", "bad", 3), ("c", sha, 4), ("d", sha, 0), ("z", sha, 3)]
    out = M.verify_files(files, spark.createDataFrame(manifest, "path string, checksum string, size_bytes long"))
    got = {r.path: (r.verdict, r.passed) for r in out.collect()}
    assert got == {
        "a": ("ok", True), "b": ("corrupted", False), "c": ("size_mismatch", False), "d": ("ok", True),
        "e": ("legacy", True), "z": ("missing", False),
    }


@pytest.mark.parametrize("built,chunks", [(0, 0), (99, 0), (100, 1), (250, 2), (435, 4)])
def test_consolidation_plans(spark, built, chunks):
    batches = spark.range(built).select(F.col("id").alias("batch_id"))
    none = spark.createDataFrame([], "chunk_id long, batch_id long")
    plan = M.consolidation_plan(batches, none)
    assert plan.select("chunk_id").distinct().count() == chunks
    assert plan.count() == chunks * 100
    assert M.unconsolidated(batches, plan).count() == built - chunks * 100
    row = M.consolidation_range(batches, none).first()
    assert tuple(row) == (0, chunks * 100, 0)


def test_batches_and_compaction(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("n"))
    path, chunks, mapping = (str(tmp_path / x) for x in ("batches", "chunks", "mapping"))
    sinks.write_batches(df, path, ["n"], batch_size=3)
    stored = spark.read.parquet(path)
    assert stored.count() == 1000 and stored.groupBy("batch_id").count().agg(F.max("count")).first()[0] == 3
    sinks.write_batches(df, path, ["n"], batch_size=3)
    assert spark.read.parquet(path).count() == 1000
    done = sinks.compact(spark, path, chunks, mapping)
    assert done.count() == 300 and spark.read.parquet(chunks).count() == 900
    assert sinks.compact(spark, path, chunks, mapping).count() == 0
    assert spark.read.parquet(mapping).select("batch_id").distinct().count() == 300


def test_corrupt_batch_files_are_skipped(spark, tmp_path):
    path = tmp_path / "batches"
    df = spark.range(600).select(F.col("id").alias("n"))
    sinks.write_batches(df, str(path), ["n"], batch_size=2)
    (path / "batch_group=0" / "broken.parquet").write_bytes(b"PAR1 not really")
    done = sinks.compact(spark, str(path), str(tmp_path / "c"), str(tmp_path / "m"))
    assert done.count() == 300 and spark.read.parquet(str(tmp_path / "c")).count() == 600


def test_dataset_folder(spark, tmp_path):
    df = spark.range(200).select(F.col("id").cast("string").alias("sample_id"))
    sinks.write_dataset(df, str(tmp_path / "out"))
    data = spark.read.parquet(str(tmp_path / "out" / "data"))
    records = {r.split: r for r in spark.read.json(str(tmp_path / "out" / "dataset.json")).collect()}
    assert data.count() == 200 and records["train"].vocab_size == 2052
    assert records["train"].total_groups + records["test"].total_groups == 200


def test_submission_file(spark, tmp_path):
    attempts = spark.createDataFrame([("p", "h1", "a", "b"), ("p", "h2", "b", "b")], "name string, input_hash string, attempt_1 string, attempt_2 string")
    answers = spark.createDataFrame([("a", [[1, 2]]), ("b", [[3]])], "pred_hash string, grid array<array<int>>")
    docs = sinks.submission_documents(attempts, answers)
    assert json.loads(docs.first().document) == {
        "p": [{"attempt_1": [[1, 2]], "attempt_2": [[3]]}, {"attempt_1": [[3]], "attempt_2": [[3]]}]
    }
    sinks.write_submission(docs, str(tmp_path / "sub"))
    assert "attempt_1" in spark.read.text(str(tmp_path / "sub")).first().value


def test_chunk_names(spark):
    df = spark.createDataFrame([("/c/consolidated_010.pt",), ("/c/consolidated_x.pt",), ("/c/batch_1.pt",), ("/c/consolidated_2.parquet",)], "path string")
    assert sorted(r.chunk_id for r in M.chunk_inventory(df).collect()) == [2, 10]


def test_retention_keeps_the_latest(spark):
    df = spark.createDataFrame([("a", i) for i in range(6)] + [("b", 1)], "k string, step int")
    kept = M.retention(df, ["k"], "step", 3)
    assert rows(kept.where("kept"), "k", "step") == [("a", 3), ("a", 4), ("a", 5), ("b", 1)]
    assert kept.count() == 7


def test_progress_after_an_epoch(spark):
    log = [(0, False, 0, 50, 5, 100), (1, False, 1, 100, 5, 100), (2, True, 0, 0, 0, 0), (3, False, 1, 30, 5, 100)]
    df = spark.createDataFrame(log, "seq long, is_marker boolean, chunk_id long, offset long, samples long, chunk_size long")
    got = {r.chunk_id: tuple(r)[1:] for r in M.chunk_progress(df).collect()}
    assert got == {0: (0, 0, False, 1), 1: (5, 30, False, 31)}
    before = {r.chunk_id: r.resume_at for r in M.chunk_progress(df.where("seq < 2")).collect()}
    assert before == {0: 51, 1: 0}
    row = M.training_report(df).first()
    assert (row.epoch, row.total_samples_trained, row.current_chunk, row.current_offset) == (1, 15, 1, 30)


def test_detected_sources_load(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    challenge_folder(tmp_path / "arc")
    assert R.detect(spark, str(tmp_path / "arc")) == "arc_json"
    assert R.load(spark, str(tmp_path / "arc")).count() == 3
    assert R.detect(spark, "plain-name") == "hf"
    with pytest.raises(ValueError):
        R.load(spark, "plain-name")


def test_build_orders_keys_and_skips(spark):
    texts = spark.createDataFrame([("d1", "a  b"), ("d2", "c")], "sample_id string, text string").withColumn("modality", F.lit("text"))
    tiles = spark.createDataFrame([(f"g{i}", [[i]]) for i in range(6)], "sample_id string, grid array<array<int>>").withColumn(
        "modality", F.lit("grid")
    ).withColumn("metadata", F.create_map(F.lit("task_id"), F.lit("t")))
    full = B.build([texts, tiles], probability=1.0)
    kinds = {r.derived: r["count"] for r in full.groupBy("derived").count().collect()}
    assert kinds == {0: 8, 1: 6, 2: 5}
    assert full.where("sample_id = 'd1'").first().text == "a b"
    copy = full.where("derived = 2").first()
    assert copy.label.grid == copy.grid and copy.metadata["task_type"] == "distribution_learning"
    known = full.where("derived = 0").select("content_key")
    assert B.build([texts, tiles], known, probability=1.0).where("derived = 0").count() == 0


def test_transforms_by_name(spark):
    df = B.conform(spark.createDataFrame([("s", "grid", [[1, 2]])], "sample_id string, modality string, grid array<array<int>>"))
    out = P.apply_transforms(df, ["preprocess_sample", "augment_sample"])
    assert sorted(r.sample_id for r in out.collect()) == ["s"] + [f"s_aug{i}" for i in range(1, 8)]

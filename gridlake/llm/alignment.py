"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both token sequences spell the same bytes. An interval of them is divided where both have a token end
near its middle: the end of the first tokenizer's middle token is looked up among the ends of the second
by bisection, then those around it in rings of doubling width, and both halves go on alike. An interval
without a shared end inside is a group. The intervals of all texts of a batch are divided at once, level
by level, so a level is a handful of array operations.

Counts of linked ids over all documents come from a shuffle: documents travel in packs, each with the
distinct pairs of ids found in it, and every pack gets back one number for each of its pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm.common import bounded_batches, slices, table, written

#: Characters worked on at once; a longer text is taken in pieces that end at a shared cut.
PIECE_CHARS = 400_000
#: Distinct chunks, and characters of them, whose tokens a task keeps.
CACHE_CHUNKS, CACHE_CHARS = 300_000, 6_000_000
#: Distinct links of documents, and documents, of one pack.
PACK_LINKS, PACK_DOCS = 400_000, 4_000

# Fixed value: the visible character that stands for a space in the pieces of the second tokenizer.
BLANK = "▁"
ODD = re.compile(r"\s | \s")
BEYOND = re.compile("[^\x00-\u024f]")
#: Chunks that are encoded in one line, and the longest such chunk.
LINE, SHORT = 64, 200


def byte_alphabet() -> dict[str, int]:
    """The printable characters of a byte-level vocabulary: visible Latin-1 characters stand for themselves, the rest follow from 256 on."""
    visible = [x for x in range(256) if chr(x).isprintable() and x != 0x20]
    rest = [x for x in range(256) if x not in visible]
    return {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(rest)}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """The two libraries, the bytes of their tokens, and the decimal ids as they are written down."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, vocab = byte_alphabet(), self.a.get_vocab(with_added_tokens=False)
        self.n_a, self.n_b = max(vocab.values()) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token if c in letters)
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.fast = self.rank_encoder(a_path)
        # No piece goes on after a word: then words are encoded alone as they are within a text.
        self.splits = all(BLANK not in p.lstrip(BLANK) for p in pieces)
        sides = ((self.n_a, b"|"), (self.n_b, b";"))
        self.written = [b"%d%s" % (i, end) for n, last in sides for i in range(n) for end in (b",", last)]

    def rank_encoder(self, path: str):
        """An encoder by ranks for the same vocabulary, which is faster; None if its merges aren't numbered in their order."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        singles = sum(len(x) == 1 for x in self.a_bytes)
        if any(model["vocab"].get(x + y) != singles + i for i, (x, y) in enumerate(merges)) or any(len(x) != 1 for x in self.a_bytes[:singles]):
            return None
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i < singles + len(merges)}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str], quick: bool = False) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of space + text under the first, and of text under the second tokenizer, which adds the space.

        With ``quick``, for texts of short words, those of Latin letters take the faster way: the kinds of
        these letters are the same in every edition of Unicode.
        """
        rest = [i for i, t in enumerate(texts) if not quick or self.fast is None or BEYOND.search(t)]
        a = [[] if x else self.fast.encode_ordinary(" " + t) for x, t in zip(np.isin(np.arange(len(texts)), rest), texts)]
        if rest:
            for i, e in zip(rest, self.a.encode_batch_fast([" " + texts[i] for i in rest], add_special_tokens=False)):
                a[i] = e.ids
        return a, self.b.encode(texts, num_threads=1)

    def agree(self, text: str, a: list[int], b: list[int]) -> bool:
        want = (" " + text).encode("utf-8", "surrogatepass")
        return b"".join([self.a_bytes[i] for i in a]) == want == b"".join([self.b_bytes[i] for i in b])


@lru_cache(maxsize=2)
def tokenizers(a_path: str | None, b_path: str | None) -> Tokenizers:
    """Paths are resolved where the files are opened, in the worker."""
    a, b = default_paths() if a_path is None or b_path is None else (a_path, b_path)
    return Tokenizers(a_path or a, b_path or b)


def chunks(text: str) -> list[str]:
    """The text cut at its single spaces between visible characters, which go; each chunk had or gets one before it."""
    parts = text.split(" ")
    if not ODD.search(text) and parts[0] and parts[-1]:
        return parts
    out, run = [], [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace() and run[-1] and not run[-1][-1].isspace():
            out.append(" ".join(run))
            run = []
        run.append(part)
    return [*out, " ".join(run)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the elements of lists at ``starts``, one list after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def near_cut(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval of a's tokens, the token nearest to the middle that ends where one of b's does, and b's; -1 where there is none."""
    mid = (lo + hi - 2) // 2
    b = np.searchsorted(ends_b, ends_a[mid])
    hit = ends_b[b] == ends_a[mid]
    a, b = np.where(hit, mid, -1), np.where(hit, b, -1)
    room = np.maximum(mid - lo, hi - 2 - mid)
    reach = 1
    left = np.flatnonzero(~hit & (room >= reach))
    while len(left):
        m = mid[left]
        up = np.maximum(np.minimum(m + 2 * reach, hi[left] - 1) - m - reach, 0)
        down = np.maximum(m - reach + 1 - np.maximum(m - 2 * reach + 1, lo[left]), 0)
        owner = np.concatenate((np.repeat(left, up), np.repeat(left, down)))
        at = np.concatenate((ragged(m + reach, up), 2 * np.repeat(m, down) - ragged(m + reach, down)))
        other = np.searchsorted(ends_b, ends_a[at])
        hit = np.flatnonzero(ends_b[other] == ends_a[at])
        # The farthest first: of several hits of an interval the last one written stays.
        hit = hit[np.argsort(-np.abs(at[hit] - mid[owner[hit]]), kind="stable")]
        a[owner[hit]], b[owner[hit]] = at[hit], other[hit]
        reach *= 2
        left = left[(a[left] < 0) & (room[left] >= reach)]
    return a, b


def divide(ends_a: np.ndarray, ends_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each token of a and of b is the last one of a group, for texts of n_a and n_b tokens that follow on each other."""
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    a_hi, b_hi = np.cumsum(n_a), np.cumsum(n_b)
    a_lo, b_lo = a_hi - n_a, b_hi - n_b
    cut_a[a_hi[n_a > 0] - 1] = cut_b[b_hi[n_b > 0] - 1] = True
    while True:
        live = (a_hi - a_lo > 1) & (b_hi - b_lo > 1)
        a_lo, a_hi, b_lo, b_hi = a_lo[live], a_hi[live], b_lo[live], b_hi[live]
        if not len(a_lo):
            return cut_a, cut_b
        a, b = near_cut(ends_a, ends_b, a_lo, a_hi)
        found = a >= 0
        a, b = a[found], b[found]
        cut_a[a] = cut_b[b] = True
        a_lo, a_hi = np.concatenate((a_lo[found], a + 1)), np.concatenate((a + 1, a_hi[found]))
        b_lo, b_hi = np.concatenate((b_lo[found], b + 1)), np.concatenate((b + 1, b_hi[found]))


class Found:
    """What was found in a text so far: counts, the digest of its groups, its distinct links and how often each occurs."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.sha, self.pending, self.links = hashlib.sha256(), b"", []

    def add(self, n_a: int, n_b: int, n_groups: int, groups: bytes, pairs: np.ndarray, counts: np.ndarray) -> None:
        self.n_a, self.n_b, self.n_groups = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups
        self.n_links += int(counts.sum())
        self.sha.update(self.pending + groups[:-1])
        self.pending = groups[-1:]
        self.links.append((pairs, counts))
        if len(self.links) > 1:
            both = [np.concatenate(x) for x in zip(*self.links)]
            pairs, where = np.unique(both[0], return_inverse=True)
            self.links = [(pairs, np.bincount(where, both[1], len(pairs)).astype(np.int64))]

    def row(self) -> tuple:
        return self.n_a, self.n_b, self.n_groups, self.n_links, self.sha.hexdigest() if self.n_a else ""


class Aligner:
    """Tokens of chunks, kept for a partition, and the alignment of whole texts."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        self.t = tokenizers(a_path, b_path)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.ok = np.empty(0, bool)
        self.ids = [np.empty(0, np.int64)] * 2
        self.sizes = [np.empty(0, np.int64)] * 2

    def learn(self, fresh: list[str]) -> None:
        """Encode new chunks: lines of plain ones at once; alone those that are long, have white space at an end or are in a line that isn't spelled byte by byte."""
        plain = [c for c in fresh if self.t.splits and 0 < len(c) <= SHORT and not c[0].isspace() and not c[-1].isspace()]
        lines = [plain[i : i + LINE] for i in range(0, len(plain), LINE)]
        texts = [" ".join(line) for line in lines]
        found = self.t.encode(texts, quick=True)
        good = [k for k, t in enumerate(texts) if self.t.agree(t, found[0][k], found[1][k])]
        whole = [c for k in good for c in lines[k]]
        stops = np.cumsum(np.fromiter((len(c.encode("utf-8", "surrogatepass")) + 1 for c in whole), np.int64, len(whole)))
        sides = []
        for lists, sizes in zip(found, (self.t.a_sizes, self.t.b_sizes)):
            ids = np.array(list(chain.from_iterable(lists[k] for k in good)), np.int64)
            ends = np.cumsum(sizes[ids])
            at = np.searchsorted(ends, stops) + 1
            assert not len(stops) or (ends[at - 1] == stops).all(), "a token goes on after its word"
            sides.append((ids, np.diff(at, prepend=0)))
        self.keep(whole, np.ones(len(whole), bool), sides)
        known = set(whole)
        rest = [c for c in fresh if c not in known]
        if rest:
            found = self.t.encode(rest)
            ok = np.fromiter((self.t.agree(c, a, b) for c, a, b in zip(rest, *found)), bool, len(rest))
            self.keep(rest, ok, [(np.array(list(chain.from_iterable(x)), np.int64), np.fromiter(map(len, x), np.int64, len(x))) for x in found])

    def keep(self, chunks: list[str], ok: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        first = len(self.index)
        self.index.update(zip(chunks, range(first, first + len(chunks))))
        self.chars += sum(map(len, chunks))
        self.ok = np.concatenate((self.ok, ok))
        for side, (ids, sizes) in enumerate(sides):
            self.ids[side], self.sizes[side] = np.concatenate((self.ids[side], ids)), np.concatenate((self.sizes[side], sizes))

    def numbers(self, cut: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the chunks of each list."""
        if len(self.index) > CACHE_CHUNKS or self.chars > CACHE_CHARS:
            self.clear()
        fresh = [c for c in set(chain.from_iterable(cut)) if c not in self.index]
        if fresh:
            self.learn(fresh)
        return [np.fromiter(map(self.index.__getitem__, c), np.int64, len(c)) for c in cut]

    def tokens(self, side: int, which: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the lists of chunks, and their number in each."""
        flat, counts = np.concatenate(which), np.fromiter(map(len, which), np.int64, len(which))
        sizes = self.sizes[side]
        ids = self.ids[side][ragged((np.cumsum(sizes) - sizes)[flat], sizes[flat])]
        ends = np.concatenate(([0], np.cumsum(sizes[flat])))
        return ids, np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])

    def align(self, into: list[Found], a_ids: np.ndarray, n_a: np.ndarray, b_ids: np.ndarray, n_b: np.ndarray) -> None:
        """Divide the sequences of several texts and add what is found to each."""
        if not len(a_ids):
            return
        ends_a, ends_b = np.cumsum(self.t.a_sizes[a_ids]), np.cumsum(self.t.b_sizes[b_ids])
        cut_a, cut_b = divide(ends_a, ends_b, n_a, n_b)
        # A's tokens of a group, then b's: each token goes behind all of its own and of the other's groups so far.
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        last_a, last_b = np.flatnonzero(cut_a) + 1, np.concatenate(([0], np.flatnonzero(cut_b) + 1))
        words = np.empty(len(a_ids) + len(b_ids), np.int64)
        words[np.arange(len(a_ids)) + last_b[group_a]] = 2 * a_ids + cut_a
        words[np.arange(len(b_ids)) + last_a[group_b]] = 2 * (self.t.n_a + b_ids) + cut_b
        # Every stretch between neighbouring ends of either is covered by one token of each.
        ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
        ends = ends[np.concatenate(([True], ends[1:] != ends[:-1]))]
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        text_of = np.repeat(np.arange(len(n_a)), n_a)
        pairs = a_ids[at_a] * self.t.n_b + b_ids[at_b]
        size = self.t.n_a * self.t.n_b
        keys, counts = np.unique(text_of[at_a] * size + pairs, return_counts=True)
        keys, starts = keys % size, np.searchsorted(keys, np.arange(len(n_a) + 1) * size)
        groups = np.bincount(text_of, cut_a, len(n_a)).astype(np.int64)
        stops = np.concatenate(([0], np.cumsum(n_a + n_b)))
        written_as, words = self.t.written, words.tolist()
        for i, found in enumerate(into):
            if n_a[i]:
                s = slice(starts[i], starts[i + 1])
                text = b"".join(map(written_as.__getitem__, words[stops[i] : stops[i + 1]]))
                found.add(int(n_a[i]), int(n_b[i]), int(groups[i]), text, keys[s], counts[s])

    def texts(self, texts: list[str | None]) -> list[Found]:
        out = [Found() for _ in texts]
        for lo, hi in slices(texts, PIECE_CHARS):
            if hi - lo == 1 and len(texts[lo] or "") > PIECE_CHARS:
                out[lo] = self.long(texts[lo])
                continue
            which = [i for i in range(lo, hi) if texts[i]]
            if not which:
                continue
            numbers = self.numbers([chunks(texts[i]) if self.t.splits else [texts[i]] for i in which])
            good = [bool(self.ok[n].all()) for n in numbers]
            for i, fine in zip(which, good):
                if not fine:
                    out[i] = self.whole(texts[i])
            fine = [k for k, x in enumerate(good) if x]
            if fine:
                sides = [x for side in (0, 1) for x in self.tokens(side, [numbers[k] for k in fine])]
                self.align([out[which[k]] for k in fine], *sides)
        return out

    def whole(self, text: str) -> Found:
        """A text with a chunk whose bytes differ: encoded at once, so that the whole of it decides."""
        found, (a, b) = Found(), self.t.encode([text])
        if self.t.agree(text, a[0], b[0]):
            self.align([found], *[x for ids in (a[0], b[0]) for x in (np.array(ids, np.int64), np.array([len(ids)]))])
        return found

    def long(self, text: str) -> Found:
        """A text taken in pieces of whole chunks; a border between chunks is a shared cut."""
        if not self.t.splits:
            return self.whole(text)
        found, cut = Found(), chunks(text)
        for lo, hi in slices(cut, PIECE_CHARS):
            numbers = self.numbers([cut[lo:hi]])
            if not self.ok[numbers[0]].all():
                return self.whole(text)
            self.align([found], *[x for side in (0, 1) for x in self.tokens(side, numbers)])
        return found


def squeezed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype("<i4").tobytes(), 1)


def restored(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<i4").astype(np.int64)


PACK = "pack long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, sizes binary, places binary, times binary, pairs array<long>, docs array<long>"


def packed(number: int, ids: list, found: list[Found]) -> tuple:
    """One row for a pack of documents: their own columns, their links by place in the pack's distinct pairs, these pairs and the documents of each."""
    links = [f.links[0] if f.links else (np.empty(0, np.int64), np.empty(0, np.int64)) for f in found]
    flat = np.concatenate([p for p, _ in links])
    pairs, places, docs = np.unique(flat, return_inverse=True, return_counts=True)
    sizes = np.array([len(p) for p, _ in links])
    # Places go up within a document; steps between them are small.
    steps = np.diff(places, prepend=0)
    columns = [list(x) for x in zip(*[f.row() for f in found])]
    return (number, ids, *columns, squeezed(sizes), squeezed(steps), squeezed(np.concatenate([c for _, c in links])), pairs, docs)


def alignment_packs(docs: DataFrame, a_path: str | None, b_path: str | None) -> DataFrame:
    """One row per pack of documents."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        aligner, ids, found, held, number = Aligner(a_path, b_path), [], [], 0, TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in PACK.split(", ")]
        for batch in batches:
            some = [None if x is None else int(x) for x in batch["doc_id"].tolist()]
            texts = batch["text"].tolist()
            for lo, hi in slices(texts, PIECE_CHARS):
                for doc_id, f in zip(some[lo:hi], aligner.texts(texts[lo:hi])):
                    ids.append(doc_id)
                    found.append(f)
                    held += len(f.links[0][0]) if f.links else 0
                    if held >= PACK_LINKS or len(ids) >= PACK_DOCS:
                        yield pd.DataFrame([packed(number, ids, found)], columns=names)
                        ids, found, held, number = [], [], 0, number + 1
        if ids:
            yield pd.DataFrame([packed(number, ids, found)], columns=names)

    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(pack, PACK)


def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of the packs, from the count of each pair doubled, plus one where it is the highest of its first id."""
    for batch in batches:
        for row in batch.to_dict("records"):
            told = np.asarray(row["told"], np.int64) if row["told"] is not None else np.empty(0, np.int64)
            places, times, sizes = np.cumsum(restored(row["places"])), restored(row["times"]), restored(row["sizes"])
            value = told[places]
            sums = [np.concatenate(([0], np.cumsum(x))) for x in (times * (value & 1), times * (value >> 1))]
            ends = np.cumsum(sizes)
            n_best, count_sum = (s[ends] - s[ends - sizes] for s in sums)
            ids = pd.array([None if x is None or x != x else int(x) for x in row["doc_ids"]], dtype="Int64")
            yield pd.DataFrame({"doc_id": ids, "n_a": row["n_a"], "n_b": row["n_b"], "n_groups": row["n_groups"], "n_links": row["n_links"], "n_best": n_best, "count_sum": count_sum, "groups_sha256": row["sha"]})


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Alignment of both tokenizers on every text of docs(doc_id, text), and how common its links are.

    One row per input row: n_a, n_b (tokens), n_groups, n_links, n_best (links whose id pair is in as many
    documents as any pair of its first id; ties count), count_sum (documents of the pair, summed over links)
    and the digest of the groups. Null and empty texts, and texts that either tokenizer doesn't spell byte
    by byte, have zeros and the empty digest. Repeated rows are documents of their own; a null doc_id stays
    null. Long texts are worked on in pieces; what is kept of one is its distinct links. Other columns of
    docs are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    packs = written(alignment_packs(docs, a_path, b_path))
    n_b = tokenizers(a_path, b_path).n_b
    each = packs.select("pack", F.explode(F.arrays_zip("pairs", "docs")).alias("e")).select("pack", F.col("e.pairs").alias("pair"), F.col("e.docs").alias("docs"))
    counts = written(each.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.call_function("div", F.col("pair"), F.lit(n_b))))
    # One row per id of the first vocabulary, at most.
    highest = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))
    told = counts.join(highest, "a").select("pair", (2 * F.col("n") + (F.col("n") == F.col("most")).cast("long")).alias("value"))
    back = each.join(told, "pair").groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("pair", "value"))).alias("told"))
    back = back.select("pack", F.transform("told", lambda x: x["value"]).alias("told"))
    whole = packs.drop("pairs", "docs").join(back, "pack", "left")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return whole.mapInPandas(unpack, schema)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of all documents under the byte-level and the piece vocabulary."""
    return align(table(spark, sf_dir, "documents"))

"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a slice of a partition lie in one symbol array. An index maps the rank of each
mergeable pair to all positions where that pair stands; the active ranks are taken in ascending order,
all occurrences of a rank are merged together, and only the index lists of the pairs beside them are
extended. Words met before in the partition are looked up.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm.common import bounded_batches, slices, table

# The pre-tokenizer's pattern and the marker that ends a word in the public vocabulary file.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
WORD_END = "</w>"

SEPARATORS = regex.compile(r"[\x1c-\x1f]")
SPACES = regex.compile(r"\p{White_Space}+")
CACHE_CHUNKS = 600_000
#: Characters encoded at once; every active rank costs the same whatever the number of its occurrences.
ENCODE_CHARS = 4_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next letter from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Vocabulary:
    """Symbols, merge ranks and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: s.encode() for s, i in ids.items()} | {i: s.encode() for s, i in self.specials.items()}
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], dtype=np.int64)
        self.final = np.array([ids[c + WORD_END] for c in letters], dtype=np.int64)
        self.base = max(ids.values()) + 2
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in spec["model"]["merges"]]
        self.left, self.right, self.joined = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        codes = self.left * self.base + self.right
        self.rank_of = np.argsort(codes, kind="stable")
        self.codes = codes[self.rank_of]
        escaped = "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        self.special_pattern = regex.compile(f"({escaped})") if escaped else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where the pair doesn't merge."""
        code = np.where((left >= 0) & (right >= 0), left * self.base + right, -1)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.rank_of[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """Positions of each mergeable pair by rank, over many words at once."""

    def __init__(self, vocab: Vocabulary, symbols: np.ndarray):
        """``symbols``: all words' symbols, -1 before, between and after words."""
        self.vocab, self.symbols = vocab, symbols
        n = len(symbols)
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.at: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.add(np.arange(n - 1))

    def add(self, positions: np.ndarray) -> None:
        """Index the pairs that start at these positions."""
        ranks = self.vocab.ranks(self.symbols[positions], self.symbols[self.after[positions]])
        hit = np.flatnonzero(ranks >= 0)
        if not len(hit):
            return
        hit = hit[np.argsort(ranks[hit], kind="stable")]
        sorted_ranks = ranks[hit]
        cuts = np.flatnonzero(np.diff(sorted_ranks)) + 1
        for rank, group in zip(sorted_ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions[hit], cuts)):
            if rank in self.at:
                self.at[rank].append(group)
            else:
                self.at[rank] = [group]
                heapq.heappush(self.active, rank)

    def run(self) -> np.ndarray:
        """Merge until no active rank is left; dead positions hold -2."""
        vocab, symbols, after, before = self.vocab, self.symbols, self.after, self.before
        while self.active:
            rank = heapq.heappop(self.active)
            groups = self.at.pop(rank)
            spots = np.unique(np.concatenate(groups)) if len(groups) > 1 else groups[0]
            a, b = vocab.left[rank], vocab.right[rank]
            spots = spots[(symbols[spots] == a) & (symbols[after[spots]] == b)]
            if a == b and len(spots) > 1:
                spots = self.alternate(np.sort(spots))
            if not len(spots):
                continue
            gone = after[spots]
            symbols[spots], symbols[gone] = vocab.joined[rank], -2
            after[spots] = after[gone]
            before[after[spots]] = spots
            self.add(np.unique(np.concatenate((before[spots], spots))))
        return symbols

    def alternate(self, spots: np.ndarray) -> np.ndarray:
        """Of chained occurrences of a doubled symbol, every second one, from the left."""
        linked = np.concatenate(([False], self.after[spots[:-1]] == spots[1:]))
        head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(spots))))
        return spots[(np.arange(len(spots)) - head) % 2 == 0]


def encode_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and how many each has."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    symbols = np.full(len(raw) + len(words) + 1, -1, np.int64)
    symbols[np.arange(len(raw)) + word + 1] = vocab.inner[raw]
    symbols[ends + np.arange(len(words))] = vocab.final[raw[ends - 1]]
    starts = ends - sizes + np.arange(len(words)) + 1
    symbols = PairIndex(vocab, symbols).run()
    alive = symbols >= 0
    return symbols[alive], np.add.reduceat(alive, starts).astype(np.int64)


class Encoder:
    """Encodes the texts of a partition; space-separated chunks met before are looked up."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.index = {s: k for k, s in enumerate(self.vocab.specials)}
        self.flat = np.array(list(self.vocab.specials.values()), np.int64)
        self.sizes = np.ones(len(self.flat), np.int64)

    def chunks(self, text: str) -> list[str]:
        """Parts between white space, special tokens apart."""
        pattern = self.vocab.special_pattern
        if pattern is not None and any(s in text for s in self.vocab.specials):
            parts = pattern.split(text)
            return [c for k, p in enumerate(parts) for c in ([p] if k % 2 else self.split(p))]
        return self.split(text)

    @staticmethod
    def split(text: str) -> list[str]:
        return [c for c in SPACES.split(text) if c] if SEPARATORS.search(text) else text.split()

    @staticmethod
    def pieces(chunk: str) -> list[bytes]:
        """Composed, lower-cased and cut by the pre-tokenizer's pattern."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return [p.encode("utf-8", "replace") for p in PIECES.findall(chunk.lower())]

    def learn(self, chunks: list[str]) -> None:
        cut = [self.pieces(c) for c in chunks]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        at: dict[bytes, int] = {}
        which = np.fromiter((at.setdefault(p, len(at)) for c in cut for p in c), np.int64, int(counts.sum()))
        ids, sizes = encode_words(self.vocab, list(at))
        flat = ids[ragged(np.cumsum(sizes) - sizes, sizes, which)]
        ends = np.concatenate(([0], np.cumsum(sizes[which])))
        cuts = np.concatenate(([0], np.cumsum(counts)))
        first = len(self.index)
        self.index.update(zip(chunks, range(first, first + len(chunks))))
        self.flat = np.concatenate((self.flat, flat))
        self.sizes = np.concatenate((self.sizes, np.diff(ends[cuts])))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.chunks(t) if t else [] for t in texts]
        if len(self.index) > CACHE_CHUNKS:
            self.clear()
        fresh = [c for c in set(chain.from_iterable(cut)) if c not in self.index]
        if fresh:
            self.learn(fresh)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        ids = self.flat[ragged(np.cumsum(self.sizes) - self.sizes, self.sizes, which)].astype("<u4")
        ends = np.concatenate(([0], np.cumsum(self.sizes[which])))
        cuts = ends[np.concatenate(([0], np.cumsum(counts)))]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def encoded(encoder: Encoder, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Ids of each text, slice by slice."""
    for a, b in slices(texts, ENCODE_CHARS):
        yield from encoder.encode(texts[a:b])


def ragged(starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Positions of the elements of the lists ``which``, one list after the other."""
    n = sizes[which]
    ends = np.cumsum(n)
    return np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def decode_ids(vocab: Vocabulary, ids) -> bytes:
    """The tokens of the ids joined by single spaces, in UTF-8; unknown ids are left out."""
    tokens = vocab.tokens
    return b" ".join([tokens[i] for i in ids if i in tokens])


def encode(text, path: str | None = None):
    """Column: ids of the whole text as an array of int. Null and empty texts give an empty array."""
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(path)
        for texts in batches:
            yield pd.Series([x.astype(np.int32) for x in encoded(encoder, texts.tolist())], dtype=object)

    return ids(text)


def decode(ids, path: str | None = None):
    """Column: text of an array of ids. Null gives null, an empty array the empty text."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        for arrays in batches:
            yield pd.Series([None if x is None else decode_ids(vocab, np.asarray(x).tolist()).decode() for x in arrays], dtype=object)

    return text(ids)


def round_trip(text, path: str | None = None):
    """Column: struct of token count, digest of the ids and digest of the text decoded from those ids."""
    path = path or default_path()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        for texts in batches:
            rows = []
            for ids in encoded(encoder, texts.tolist()):
                decoded = decode_ids(encoder.vocab, ids.tolist())
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; one row per input row, null texts as empty ones.

    Rows with a null or repeated doc_id stay as they are; an empty table gives no rows.
    """
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", round_trip(docs.text).alias("__bpe")).select("doc_id", "__bpe.*")
